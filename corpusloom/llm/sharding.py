"""Sharding by a Feistel permutation of global row numbers (operator 8, DataFrame functions only).

Rows get numbers 0..N-1 in the order of a keyed digest, by two-level prefix sums.  A Feistel network
over Z_a x Z_b, with a and b about sqrt(N) and a * b >= N, permutes the numbers; a number that lands
at N or beyond walks on until it falls below N (cycle walking).  The permuted number p gives shard
``p mod shards`` and slot ``p div shards``: shard sizes differ by one row at most, and the place of any
row number can be computed without a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.ranking import hash_bucket, with_prefix_sum

ROUNDS = 6


def feistel(x: Column, a: Column, b: Column, seed: int) -> Column:
    """One pass of the network over 0..a*b-1; the two halves swap roles and moduli each round."""
    start = F.struct(F.expr("cast(0 as bigint)").alias("k"), ((x - F.pmod(x, b)) / b).cast("long").alias("u"), F.pmod(x, b).alias("v"), a.alias("mu"), b.alias("mv"))
    keys = F.array(*[F.lit(seed * 1000003 + i).cast("long") for i in range(ROUNDS)])

    def turn(s: Column, key: Column) -> Column:
        mixed = F.pmod(s["u"] + F.pmod(F.xxhash64(s["v"], key), s["mu"]), s["mu"])
        return F.struct(key.alias("k"), s["v"].alias("u"), mixed.alias("v"), s["mv"].alias("mu"), s["mu"].alias("mv"))

    return F.aggregate(keys, start, turn, lambda s: s["u"] * s["mv"] + s["v"])


def permuted(x: Column, n: Column, seed: int) -> Column:
    """Image of ``x`` under a permutation of 0..n-1.

    At most ``a*b - n`` numbers lie outside, so a walk ends within that many steps more.
    """
    a = F.greatest(F.ceil(F.sqrt(n)), F.lit(1)).cast("long")
    b = F.greatest(F.ceil(n / a), F.lit(1)).cast("long")
    once = feistel(x, a, b, seed)
    steps = F.sequence(F.lit(0).cast("long"), a * b - n)

    def walk(y: Column, _: Column) -> Column:
        return F.when(y < n, y).otherwise(feistel(y, a, b, seed))

    return F.when(once < n, once).otherwise(F.aggregate(steps, once, walk))


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place every row: ``id_col, size, text_crc32, law, shard, slot, grown_shard, row_number``.

    Law ``rows``: counts are at most one apart; slots of a shard run from 0 without gaps.  ``size`` is
    the UTF-8 length plus 1 (null text: 1) and ``grown_shard`` is null under this law.  Null ids are
    placed like others, repeated rows get places of their own, an empty table gives an empty result,
    and other columns are not read.  Reruns agree whatever the partitioning.
    """
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("_order"),
    ).withColumn("_bucket", hash_bucket("_order"))
    rows = rows.withColumn("_all", F.lit(0))
    numbered = with_prefix_sum(rows, F.lit(1), ["_all"], "_bucket", ["_order", "_id", "text_crc32", "size"], "row_number", group_total="_n")
    placed = numbered.withColumn("_p", permuted(F.col("row_number"), F.col("_n"), seed))
    return placed.select(
        F.col("_id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod(F.col("_p"), F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"_p div {shards}").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
