"""Exact prefix sums and ranks over groups of any size, in two levels.

A window over a whole group puts that group into one task.  Here every group is split
into ordered buckets: bucket totals are summed over the buckets (a small table), and the
window runs within one bucket only.  ``bucket`` must not decrease along the wanted order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_prefix_sum(
    df: DataFrame,
    value: Column,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[Column | str],
    name: str = "start",
    group_total: str | None = None,
) -> DataFrame:
    """Add the exclusive prefix sum of ``value`` per ``keys`` in (bucket, order).

    ``keys`` and ``bucket`` must be free of nulls; null values count as 0.  With
    ``group_total``, the sum over the whole group is added under that name.
    """
    valued = df.withColumn("_v", F.coalesce(value.cast("long"), F.lit(0)))
    totals = valued.groupBy(*keys, bucket).agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_t").over(before), F.lit(0)))
    extra = []
    if group_total:
        offsets = offsets.withColumn(group_total, F.sum("_t").over(Window.partitionBy(*keys)))
        extra = [group_total]
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # A merge join by hint: sizes of generated rows are underestimated, and neither side may be broadcast by mistake.
    # The rows lie by (keys, bucket) already, so only the small table of totals moves.
    return (
        valued.withColumn("_in", F.coalesce(F.sum("_v").over(within), F.lit(0)))
        .join(offsets.select(*keys, bucket, "_off", *extra).hint("merge"), [*keys, bucket])
        .withColumn(name, F.col("_off") + F.col("_in"))
        .drop("_v", "_off", "_in")
    )


def value_bucket(x: Column) -> Column:
    """Bucket of a row ordered by a double (NaN last): 4096 for each factor of e, and as fine near 0.

    The logarithm is semi-monotonic by contract, and all else here is exact or monotonic, so buckets never decrease.
    """
    return F.when(F.isnan(x), F.lit(2**63 - 1)).otherwise(F.floor(F.signum(x) * F.log1p(F.abs(x)) * 4096))


def at_ranks(df: DataFrame, keys: Sequence[str], value: str, ranks: Callable[[Column], Column], near: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """Per ``keys``: ``n``, the count of values that are not null, and ``at``, the values at the 0-based ``ranks(n)`` (an array).

    Equal values are counted in the map task already, and ranks come from counts by buckets of values, so no task holds a
    group.  ``near(start, stop, n)`` may rule out, cheaply, rows whose ranks from start to before stop are not asked for.
    """
    valued = df.where(F.col(value).isNotNull()).select(F.struct(*keys).alias("_g"), F.col(value).cast("double").alias("_x"))
    counts = valued.groupBy("_g", "_x").agg(F.count(F.lit(1)).alias("_c")).withColumn("_bucket", value_bucket(F.col("_x")))
    rows = with_prefix_sum(counts, F.col("_c"), ["_g"], "_bucket", ["_x"], "_start", "n")
    stop = F.col("_start") + F.col("_c")
    if near:
        rows = rows.where(near(F.col("_start"), stop, F.col("n")))
    asked = F.transform(ranks(F.col("n")), lambda r, i: F.struct(i.alias("i"), r.alias("r")))
    hits = rows.select("_g", "n", "_x", F.explode(F.filter(asked, lambda a: (a["r"] >= F.col("_start")) & (a["r"] < stop))).alias("_a"))
    at = F.transform(F.array_sort(F.collect_list(F.struct("_a.i", "_x"))), lambda a: a["_x"])
    return hits.groupBy("_g").agg(F.first("n").alias("n"), at.alias("at")).select("_g.*", "n", "at")


def hash_bucket(hexdigest: str, digits: int = 3) -> Column:
    """Bucket of a row ordered by a hex digest: its leading ``digits`` hex digits."""
    return F.conv(F.substring(hexdigest, 1, digits), 16, 10).cast("int")
