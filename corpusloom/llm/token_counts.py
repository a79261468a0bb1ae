"""Exact token-length histogram (operator 2).

Every whole text is encoded once and only its length leaves the Python stage; documents are then
aggregated by length.  All answers (totals, quantiles, truncated totals for any context limit) come
from prefix and suffix sums over the histogram, whose size is the number of distinct lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.token_pieces import encoder
from corpusloom.plans.ranking import with_prefix_sum
from corpusloom.session import stored


def token_lengths(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """One ``n_tokens`` per row of ``docs`` (null or empty text: 0); other columns are not read."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for _, _, bounds in enc.batches(batch, 0):
                yield pa.record_batch([pa.array(np.diff(bounds))], names=["n_tokens"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(lengths, "n_tokens long")


def length_histogram(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """Per distinct length, taken as a context limit: what any limit question needs.

    ``length, n_docs, docs_upto, docs_over, tokens, tokens_upto, total_docs, total_tokens,
    truncated_tokens, quantile``: ``docs_upto`` and ``tokens_upto`` count documents of at most this
    length, ``docs_over`` longer ones; ``truncated_tokens`` is the corpus size when every document is cut at
    this length, ``quantile`` the share of documents not longer.  An empty table gives an empty histogram.
    """
    # Both prefix sums read the histogram twice; the texts are encoded once.
    hist = stored(token_lengths(docs, tokenizer, text_col).groupBy(F.col("n_tokens").alias("length")).agg(F.count(F.lit(1)).alias("n_docs")))
    hist = hist.withColumn("tokens", F.col("length") * F.col("n_docs")).withColumn("_all", F.lit(0)).withColumn("_band", F.expr("length div 256"))
    # docs and tokens are summed together: a limit's count of both is one prefix away.
    docs_before = with_prefix_sum(hist, F.col("n_docs"), ["_all"], "_band", ["length"], "_docs_before", "total_docs")
    both = with_prefix_sum(docs_before, F.col("tokens"), ["_all"], "_band", ["length"], "_tokens_before", "total_tokens")
    upto = F.col("_docs_before") + F.col("n_docs")
    return both.select(
        "length",
        "n_docs",
        upto.alias("docs_upto"),
        (F.col("total_docs") - upto).alias("docs_over"),
        "tokens",
        (F.col("_tokens_before") + F.col("tokens")).alias("tokens_upto"),
        "total_docs",
        "total_tokens",
        (F.col("_tokens_before") + F.col("length") * (F.col("total_docs") - F.col("_docs_before"))).alias("truncated_tokens"),
        (upto / F.col("total_docs")).alias("quantile"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """``context_limit, truncated_tokens, docs_over`` for limits that need not be a length in the histogram."""
    asked = F.explode(F.array(*[F.lit(x).cast("long") for x in limits])).alias("context_limit")
    cut = F.least("length", "context_limit") * F.col("n_docs")
    over = F.when(F.col("length") > F.col("context_limit"), F.col("n_docs")).otherwise(0)
    return histogram.select("length", "n_docs", asked).groupBy("context_limit").agg(F.sum(cut).alias("truncated_tokens"), F.sum(over).alias("docs_over"))


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """``share, length``: the least length that at least this share of the documents does not exceed."""
    asked = F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share")
    return histogram.select("length", "quantile", asked).where("quantile >= share - 1e-12").groupBy("share").agg(F.min("length").alias("length"))
