"""Reading a corpus back: sample ids to windows of tokens, by arithmetic and equality joins.

Sample g of a stream is ``stream[g*seq : g*seq+seq+1]``; as ``seq`` divides the chunk size, it lies in chunk
``g div (C/seq)``.  Within a chunk the samples of an epoch are visited in a permuted order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.plans.ranking import with_prefix_sum


def chunk_layout(chunks: DataFrame, seq: int) -> DataFrame:
    """``chunk_id, samples, cumulative`` of chunks with ``tokens``: (tokens - 1) div seq samples each, summed in two levels."""
    rows = chunks.select("chunk_id", F.expr(f"(tokens - 1) div {seq}").alias("samples")).withColumns({"_all": F.lit(0), "_band": F.expr("chunk_id div 1024")})
    summed = with_prefix_sum(rows, F.col("samples"), ["_all"], "_band", ["chunk_id"], "_before")
    return summed.select("chunk_id", "samples", (F.col("_before") + F.col("samples")).alias("cumulative"))


def permutation_by_hash(layout: DataFrame, seed: int, epoch: int) -> DataFrame:
    """``chunk_id, local, j``: position ``local`` of an epoch shows sample ``j`` of the chunk; order by SHA-256."""
    rows = layout.where("samples > 0").select("chunk_id", F.explode(F.expr("sequence(0L, samples - 1)")).alias("j"))
    mark = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col("chunk_id").cast("string"), F.col("j").cast("string")), 256)
    local = F.row_number().over(Window.partitionBy("chunk_id").orderBy(mark)) - 1
    return rows.withColumn("local", local.cast("long"))


def permutation_pcg64(layout: DataFrame, seed: int, epoch: int) -> DataFrame:
    """The same with a PCG64 permutation seeded by BLAKE2b-64 of ``seed:epoch:chunk``."""

    def permute(rows: pd.DataFrame) -> pd.DataFrame:
        chunk, n = int(rows["chunk_id"].iloc[0]), int(rows["samples"].iloc[0])
        start = int.from_bytes(hashlib.blake2b(f"{seed}:{epoch}:{chunk}".encode(), digest_size=8).digest(), "little")
        order = np.random.Generator(np.random.PCG64(start)).permutation(n)
        return pd.DataFrame({"chunk_id": chunk, "local": np.arange(n, dtype=np.int64), "j": order.astype(np.int64)})

    return layout.where("samples > 0").groupBy("chunk_id").applyInPandas(permute, "chunk_id long, local long, j long")


def range_ids(spark: SparkSession, start: int, rows: int, stride: int = 1) -> DataFrame:
    """``sample_id``: rows of a contiguous or strided read; negatives and booleans are refused."""
    if any(isinstance(x, bool) or x < 0 for x in (start, rows)) or stride < 1:
        raise ValueError("start and rows must be non-negative integers, stride positive")
    return spark.range(start, start + rows * stride, stride).withColumnRenamed("id", "sample_id")


def stream_batches(spark: SparkSession, stream: int, streams: int, batch: int, batches: int, total: int | None = None) -> DataFrame:
    """``batch_no, row_no, sample_id``: batch t of stream d starts at ``d + t*batch*n`` and steps by n.

    With ``total``, ids end there, and the last batch may be short.
    """
    ids = spark.range(batches * batch).select(F.expr(f"id div {batch}").alias("batch_no"), F.pmod("id", F.lit(batch)).alias("row_no"))
    rows = ids.withColumn("sample_id", F.lit(stream) + F.col("batch_no") * (batch * streams) + F.col("row_no") * streams)
    return rows if total is None else rows.where(F.col("sample_id") < total)


def shard_batches(total: Column, shards: DataFrame, per_head: int, samples_per_chunk: int, batch: int) -> DataFrame:
    """Sample range of each ``shard``: ``[s*p*spc, min((s+1)*p*spc, total))`` cut into batches, the last one short."""
    width = per_head * samples_per_chunk
    low, high = F.col("shard") * width, F.least((F.col("shard") + 1) * width, total)
    rows = shards.withColumns({"low": low, "high": high}).where("high > low")
    rows = rows.withColumn("batch_no", F.explode(F.expr(f"sequence(0L, (high - low - 1) div {batch})")))
    first = F.col("low") + F.col("batch_no") * batch
    return rows.select("shard", "batch_no", first.alias("first_sample"), F.least(first + batch, F.col("high")).alias("end_sample"))


def shard_epochs(total: Column, shards: DataFrame, per_head: int, samples_per_chunk: int, batch: int, epochs: int) -> DataFrame:
    """The batches of ``shard_batches`` for so many epochs, one after another: ``shard, epoch, turn, first_sample, end_sample``.

    Sample ids run on through the epochs, ``turn`` through a shard's batches; the last batch of each epoch may be short.
    """
    once = shard_batches(total, shards, per_head, samples_per_chunk, batch)
    width = per_head * samples_per_chunk
    size = F.least((F.col("shard") + 1) * width, total) - F.col("shard") * width
    each = F.ceil(size / batch).cast("long")
    rows = once.withColumn("epoch", F.explode(F.expr(f"sequence(0L, {epochs - 1}L)")))
    return rows.select("shard", "epoch", (F.col("epoch") * each + F.col("batch_no")).alias("turn"), *[(F.col("epoch") * total + F.col(c)).alias(c) for c in ("first_sample", "end_sample")])


def legacy_batch(spark: SparkSession, batch: int, rows: int) -> DataFrame:
    """Sample ids of one batch of a plain contiguous read."""
    return range_ids(spark, batch * rows, rows)


def locate(ids: DataFrame, total: Column, per_chunk: int) -> DataFrame:
    """Absolute sample id to (epoch, chunk, local)."""
    pos = F.pmod("sample_id", total)
    return ids.withColumns({"epoch": F.floor(F.col("sample_id") / total).cast("long"), "chunk_id": F.floor(pos / per_chunk).cast("long"), "local": F.pmod(pos, F.lit(per_chunk))})


def locate_range(positions: DataFrame, layout: DataFrame) -> DataFrame:
    """Position to containing chunk for layouts of uneven chunks: the first whose cumulative count exceeds it.

    Bins as wide as the largest chunk make this an equality join: a chunk lies in two bins at most.
    """
    width = layout.agg(F.max("samples")).first()[0]
    if not width:
        return positions.select("pos", F.lit(None).cast("long").alias("chunk_id")).where("false")
    start = F.col("cumulative") - F.col("samples")
    spans = layout.where("samples > 0").select("chunk_id", start.alias("_from"), F.col("cumulative").alias("_to"))
    spans = spans.withColumn("_bin", F.explode(F.expr(f"sequence(_from div {width}, (_to - 1) div {width})")))
    met = positions.select("pos", F.expr(f"pos div {width}").alias("_pbin")).join(spans, (F.col("_pbin") == F.col("_bin")) & (F.col("pos") >= F.col("_from")) & (F.col("pos") < F.col("_to")))
    return met.select("pos", "chunk_id")


def sample_pieces(stream: DataFrame, seq: int, n: str = "n_tokens") -> DataFrame:
    """Document pieces of samples: ``g, doc_id, pos`` (in the sample), ``from_doc, n_piece``, for documents with ``start_pos``."""
    total = F.expr("(stream_tokens - 1)") if "stream_tokens" in stream.columns else F.lit(1 << 62)
    start, end = F.col("start_pos"), F.col("start_pos") + F.col(n)
    first = F.when((F.pmod(start, F.lit(seq)) == 0) & (start > 0), F.expr(f"start_pos div {seq}") - 1).otherwise(F.expr(f"start_pos div {seq}"))
    out = stream.where(F.col(n) > 0).withColumn("g", F.explode(F.sequence(first, F.expr(f"(start_pos + {n} - 1) div {seq}"))))
    low, high = F.greatest(start, F.col("g") * seq), F.least(end, F.col("g") * seq + seq + 1)
    out = out.withColumns({"pos": low - F.col("g") * seq, "from_doc": low - start, "n_piece": high - low})
    # Samples are whole windows only: the stream's tail that fills none is left out.
    return out.where((F.col("n_piece") > 0) & ((F.col("g") + 1) * seq <= total))


def assemble(pieces: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Samples from pieces with token slices; a sample is ``seq + 1`` tokens, so gathering its pieces is bounded."""
    part = F.slice(tokens, (F.col("from_doc") + 1).cast("int"), F.col("n_piece").cast("int"))
    rows = pieces.select("g", F.struct("pos", part.alias("t")).alias("p")).groupBy("g").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return rows.select("g", F.flatten(F.transform("ps", lambda p: p["t"])).alias("tokens"))


def samples_for_ids(ids: DataFrame, permutation: DataFrame, samples: DataFrame, total: Column, per_chunk: int) -> DataFrame:
    """Requested ids to windows: (epoch, chunk, local) to sample j, then to its window.

    ``permutation`` is of one epoch; ids of other epochs find nothing, so read epoch by epoch.
    """
    placed = locate(ids, total, per_chunk).join(permutation, ["chunk_id", "local"])
    return placed.withColumn("g", F.col("chunk_id") * per_chunk + F.col("j")).join(samples, "g")


def chunk_samples(slices: DataFrame, seq: int) -> DataFrame:
    """Samples ``chunk_id, j, tokens`` of chunks held as ``chunk_id, pos, tokens`` slices; windows that are not whole are left out."""
    n = F.size("tokens")
    low = F.when((F.pmod("pos", F.lit(seq)) == 0) & (F.col("pos") > 0), F.expr(f"pos div {seq}") - 1).otherwise(F.expr(f"pos div {seq}"))
    rows = slices.where(n > 0).withColumn("j", F.explode(F.sequence(low, F.expr(f"(pos + size(tokens) - 1) div {seq}"))))
    first, end = F.greatest(F.col("pos"), F.col("j") * seq), F.least(F.col("pos") + n, F.col("j") * seq + seq + 1)
    part = F.slice("tokens", (first - F.col("pos") + 1).cast("int"), F.greatest(end - first, F.lit(0)).cast("int"))
    grouped = rows.select("chunk_id", "j", F.struct(first.alias("at"), part.alias("t")).alias("p")).groupBy("chunk_id", "j").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return grouped.select("chunk_id", "j", F.flatten(F.transform("ps", lambda p: p["t"])).alias("tokens")).where(F.size("tokens") == seq + 1)
