"""Exact deduplication by skew-safe combining (operator 1, DataFrame functions only).

Three combining stages, each grouping by digest *and* full content:

1. local: partial aggregation inside each input partition;
2. salted: copies of one text meet per (digest, salt), so a text that holds a third of all rows is spread
   over ``salts`` tasks; a row's salt follows from its id, so a task that runs again deals it the same way;
3. global: at most ``salts`` winners of a text meet by digest.

The winners carry no text.  Each goes back to the salts that its text has, and is joined to the rows by (digest, salt),
so no digest is hot there either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of ASCII white space that are not one space already: the same result as replacing every run, with far fewer matches.
SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """Decide, for every row, which row of its group of equal texts stays.

    Texts are equal when identical after each run of ASCII white space became one space;
    null counts as empty.  Result: ``id_col, keep_id, group_size, kept, text_sha256``, one row
    per input row.  A null id is never the smallest while its group has an id; in a group
    without ids, ``keep_id`` is null and its rows stay.  Rows that repeat the smallest id all
    stay, as nothing tells them apart.  Other columns are not read, so their names may clash.
    An empty table gives an empty result; ``salts`` is at most 63.  Should two different texts ever share a digest, the
    job fails and mixes nothing.
    """
    salt = F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int").alias("_salt")
    rows = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_text"))
    salted = rows.select("_id", "_text", F.sha2("_text", 256).alias("_digest"), salt).groupBy("_digest", "_text", "_salt").agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    winners = (
        salted.repartition("_digest")
        .groupBy("_digest", "_text")
        .agg(F.min("_keep").alias("_keep"), F.sum("_n").alias("_n"), F.expr("bit_or(shiftleft(1L, _salt))").alias("_seen"))
        .groupBy("_digest")
        .agg(F.min("_keep").alias("_keep"), F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_texts"), F.bit_or("_seen").alias("_seen"))
        .select(
            F.col("_digest").alias("_wdigest"),
            "_keep",
            F.when(F.col("_texts") == 1, F.col("_n")).otherwise(F.raise_error(F.lit("different texts share one digest"))).alias("_n"),
            F.explode(F.expr(f"filter(sequence(0, {salts - 1}), s -> (_seen & shiftleft(1L, s)) <> 0)")).alias("_wsalt"),
        )
    )
    found = rows.select("_id", F.sha2("_text", 256).alias("_digest"), salt)
    joined = found.join(winners, (F.col("_digest") == F.col("_wdigest")) & (F.col("_salt") == F.col("_wsalt")))
    return joined.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.col("_digest").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """Rows of ``docs`` that stay, with all their columns (rows as ``exact_duplicates`` decides)."""
    kept = exact_duplicates(docs, id_col, text_col, salts).where("kept").select(F.col(id_col).alias("_kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_kept_id"]), "left_semi")
