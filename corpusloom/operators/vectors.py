"""Reductions of vectors held in an array column."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.scalar import finite
from corpusloom.plans.ranking import at_ranks


def finite_rows(df: DataFrame, vec: str = "embedding") -> DataFrame:
    return df.where(finite(F.col(vec)))


def _gathered(rows: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Elements (``by, pos``) back into one array per group; as long as a vector, so bounded."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", value.alias("v")))).alias("_e")).select(*by, F.transform("_e", lambda e: e["v"]).alias("mean"))


def weighted_vector_mean(df: DataFrame, by: list[str], vec: str = "embedding", weight: Column | None = None) -> DataFrame:
    """Elementwise sum(w*x)/sum(w) per group; rows of weight 0 add nothing, and a group without weight gives nulls."""
    w = (weight if weight is not None else F.lit(1.0)).cast("double")
    long = df.select(*by, w.alias("_w"), F.posexplode(vec).alias("pos", "x"))
    sums = long.groupBy(*by, "pos").agg(F.sum(F.col("_w") * F.col("x").cast("double")).alias("_s"), F.sum("_w").alias("_t"))
    return _gathered(sums, by, F.when(F.col("_t") != 0, F.col("_s") / F.col("_t")))


def delta_update(local: Column, old: Column, new: Column) -> Column:
    return F.zip_with(local, F.zip_with(new, old, lambda n, o: n - o), lambda x, d: x + d)


def sparse_bucket(pos: Column, parts: int) -> Column:
    """Fixed random partition of a position."""
    return F.pmod(F.conv(F.substring(F.md5(pos.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(parts))


def rotating_sparse_mean(df: DataFrame, by: list[str], share: float, round_no: int, size: int, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Only the positions of one partition are averaged within a group; the others stay each vector's own."""
    parts = min(int(np.ceil(1 / share)), size)
    long = df.select(key, *by, F.posexplode(vec).alias("pos", "x"))
    chosen = long.where(sparse_bucket(F.col("pos"), parts) == round_no % parts)
    means = chosen.groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("_m"))
    met = long.join(means, [*by, "pos"], "left")
    return _gathered(met.withColumn("v0", F.coalesce("_m", F.col("x").cast("double"))), [key, *by], F.col("v0"))


def decayed_delta(vector: Column, delta: Column, beta: float, steps: int, second_moment: bool = False) -> Column:
    factor = F.pow(F.lit(beta), F.lit(steps))
    out = F.zip_with(vector, delta, lambda x, d: x + factor * d)
    return F.transform(out, lambda x: F.greatest(F.lit(0.0), x)) if second_moment else out


def split_parts(df: DataFrame, size: int, vec: str = "embedding") -> DataFrame:
    """``part_index, part``: contiguous pieces of at most ``size`` elements."""
    n = F.ceil(F.size(vec) / F.lit(size)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(vec, i * size + 1, F.lit(size)))
    return df.where(F.size(vec) > 0).select(*[c for c in df.columns if c != vec], F.posexplode(pieces).alias("part_index", "part"))


def assign_parts(parts: DataFrame, owners: DataFrame, by: list[str], order: Sequence[str] = ("part_index",)) -> DataFrame:
    """Each part goes to the owner whose range of elements it overlaps most, the first on ties: ``parts`` with ``owner``.

    ``parts``: ``n`` and the columns of ``order``; ``owners``: ``owner, fraction``.  Ranges end at the floor of the cumulative
    fraction of all elements, the last at the end.  A part meets only owners of its own group, as one array: rows are sorted
    once and not multiplied.
    """
    along = Window.partitionBy(*by).orderBy(*order)
    # One order for both frames, so that they share a sort and the buffer of a group.
    p = parts.withColumns({"_end": F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, 0)), "_total": F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    listed = Window.partitionBy(*by).orderBy("owner")
    upto = F.sum("fraction").over(listed.rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.sum("fraction").over(listed.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    last = F.row_number().over(listed) == F.count(F.lit(1)).over(listed.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    o = owners.withColumns({"_c": upto, "_before": before, "_last": last})
    ranges = o.groupBy(*by).agg(F.collect_list(F.struct("owner", "_before", "_c", "_last")).alias("_ranges"))

    def ranked(r: Column) -> Column:
        low = F.greatest(F.col("_end") - F.col("n"), F.floor(r["_before"] * F.col("_total") + 1e-9))
        high = F.least("_end", F.when(r["_last"], F.col("_total")).otherwise(F.floor(r["_c"] * F.col("_total") + 1e-9)))
        return F.struct((-F.greatest(F.lit(0), high - low)).alias("less"), r["owner"].alias("owner"))

    best = F.array_min(F.transform("_ranges", ranked))["owner"]
    return p.join(ranges, by).select(*[F.col(c) for c in parts.columns], best.alias("owner"))


def apportion(scores: DataFrame, total: int, by: list[str], item: str, score: str) -> DataFrame:
    """Floor shares of ``total``, then the remaining seats one by one to the largest ``score/(seats+1)``, first on ties.

    The remaining seats are the largest quotients, so they are one ranking instead of a loop.
    """
    whole = Window.partitionBy(*by)
    rows = scores.withColumn("_sum", F.sum(score).over(whole))
    rows = rows.withColumn("_base", F.floor(F.lit(total) * F.col(score) / F.col("_sum") + 1e-9).cast("long"))
    rows = rows.withColumn("_left", F.lit(total) - F.sum("_base").over(whole))
    quotients = rows.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("_left"), F.lit(1)))))
    rank = F.row_number().over(whole.orderBy((F.col(score) / (F.col("_base") + F.col("_k"))).desc(), item))
    won = quotients.withColumn("_won", (rank <= F.col("_left")).cast("long"))
    return won.groupBy(*by, item, score, "_base").agg(F.sum("_won").alias("_extra")).select(*by, item, score, (F.col("_base") + F.col("_extra")).alias("seats"))


def quantize_uniform8(df: DataFrame, by: list[str], vec: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Codes per element and codebook per group: offset 128 around the mean, 256 steps over six deviations."""
    long = df.select(*by, F.col("vec_id"), F.posexplode(vec).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    stats = long.groupBy(*by).agg(F.avg("x").alias("_mean"), F.stddev_samp("x").alias("_std"))
    step = 6 * F.col("_std") / 256
    code = F.when(step > 0, F.bround((F.col("x") - F.col("_mean")) / step) + 128).otherwise(128)
    codes = long.join(stats, by).withColumn("code", F.least(F.lit(255), F.greatest(F.lit(0), code)).cast("int"))
    book = codes.groupBy(*by, "code").agg(F.avg("x").alias("centre"), F.count(F.lit(1)).alias("n"))
    return codes.select(*by, "vec_id", "pos", "x", "code"), book


def quantile_borders(long: DataFrame, by: list[str], borders: int) -> DataFrame:
    """Per group the interpolated quantiles at k/(borders+1) of ``x`` as ``_b``, exact, by ranks over buckets of values."""
    numbers = F.sequence(F.lit(0), F.lit(borders - 1))
    place = lambda n, k: (n - 1) * ((k + 1) / F.lit(borders + 1))

    def ranks(n: Column) -> Column:
        return F.flatten(F.transform(numbers, lambda k: F.array(F.floor(place(n, k)), F.ceil(place(n, k)))))

    def near(start: Column, stop: Column, n: Column) -> Column:
        """Whether a border lies within two ranks; the others are by far the most."""
        per_rank = F.lit(borders + 1.0) / F.greatest(n - 1, F.lit(1))
        return F.floor((start - 2) * per_rank) < F.floor((stop + 1) * per_rank)

    def border(k: Column) -> Column:
        low, high, h = F.get("at", 2 * k), F.get("at", 2 * k + 1), place(F.col("n"), k)
        return F.when(low == high, low).otherwise((F.ceil(h) - h) * low + (h - F.floor(h)) * high)

    return at_ranks(long, by, "x", ranks, near).select(*by, F.array_sort(F.transform(numbers, border)).alias("_b"))


def quantize_quantile8(df: DataFrame, by: list[str], vec: str = "embedding", borders: int = 255) -> tuple[DataFrame, DataFrame]:
    """As above with interpolated quantiles as borders: a code is the number of borders strictly below the value."""
    long = df.select(*by, F.col("vec_id"), F.posexplode(vec).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    cuts = quantile_borders(long, by, borders)
    codes = long.join(cuts, by).withColumn("code", _borders_below(F.col("x"), borders))
    book = codes.groupBy(*by, "code").agg(F.avg("x").alias("centre"), F.count(F.lit(1)).alias("n"))
    return codes.select(*by, "vec_id", "pos", "x", "code"), book


def even_quantiles(long: DataFrame, by: list[str], n: int) -> DataFrame:
    """Per group the ``n`` interpolated quantiles from the least to the greatest ``x``, as ``_q``, exact, by ranks over buckets of values."""
    numbers = F.sequence(F.lit(0), F.lit(n - 1))
    place = lambda rows, k: (rows - 1) * (k / F.lit(n - 1))
    ranks = lambda rows: F.flatten(F.transform(numbers, lambda k: F.array(F.floor(place(rows, k)), F.ceil(place(rows, k)))))

    def quantile(k: Column) -> Column:
        low, high, h = F.get("at", 2 * k), F.get("at", 2 * k + 1), place(F.col("n"), k)
        return F.when(low == high, low).otherwise((F.ceil(h) - h) * low + (h - F.floor(h)) * high)

    return at_ranks(long, by, "x", ranks).select(*by, F.transform(numbers, quantile).alias("_q"))


def quantize_vectors8(df: DataFrame, key: str = "vec_id", vec: str = "embedding", borders: int = 255, longest: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Codes per element and codebook of each vector by itself, with interpolated quantiles as borders.

    A vector of more than ``longest`` elements is cut into near-equal stretches; its borders are the quantiles of the stretches'
    quantiles.  No task holds a vector's elements together.
    """
    n = F.size(vec).cast("long")
    count = F.expr(f"size({vec}) div {longest}").cast("long")
    width = F.when(n <= longest, n).otherwise(longest + F.floor((F.pmod(n, F.lit(longest)) - 1) / count) + 1)
    long = df.select(key, width.alias("_width"), F.posexplode(vec).alias("pos", "x")).withColumns({"x": F.col("x").cast("double"), "_stretch": F.expr("pos div _width")})
    inner = even_quantiles(long, [key, "_stretch"], borders + 2)
    whole = even_quantiles(inner.select(key, F.explode("_q").alias("x")), [key], borders + 2)
    cuts = whole.select(key, F.slice("_q", 2, borders).alias("_b"))
    codes = long.drop("_width", "_stretch").join(cuts, key).withColumn("code", _borders_below(F.col("x"), borders))
    book = codes.groupBy(key, "code").agg(F.avg("x").alias("centre"), F.count(F.lit(1)).alias("n"))
    return codes.select(key, "pos", "x", "code"), book


def _borders_below(x: Column, borders: int) -> Column:
    """How many of the ascending borders ``_b`` are below ``x``.

    Binary search: a step is taken when the border that it would count last is below the value.
    """
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(borders.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda n, s: n + F.when(F.get("_b", n + s - 1) < x, s).otherwise(0))


def dequantize(codes: DataFrame, book: DataFrame, by: list[str]) -> DataFrame:
    return codes.join(book.select(*by, "code", F.col("centre").alias("restored")), [*by, "code"])


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once: a lambda takes it as a variable, where it would be computed anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scale_meanstd(vector: Column, eps: float = 1e-6) -> Column:
    """Subtract the mean, divide by norm/sqrt(n), at least ``eps``."""
    n = F.greatest(F.size(vector), F.lit(1))  # an empty vector stays empty
    mean = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double")) / n

    def scaled(centred: Column) -> Column:
        std = F.sqrt(F.aggregate(centred, F.lit(0.0), lambda s, x: s + x * x)) / F.sqrt(n)
        return _with(F.greatest(std, F.lit(eps)), lambda d: F.transform(centred, lambda x: x / d))

    return _with(mean, lambda m: _with(F.transform(vector, lambda x: x.cast("double") - m), scaled))


@F.arrow_udf(T.ArrayType(T.FloatType()))
def clamp_fp16(vector: pa.Array) -> pa.Array:
    """Values as half precision holds them, clamped to its range."""
    flat = vector.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return pa.ListArray.from_arrays(vector.offsets, pa.array(np.clip(flat, -65504, 65504).astype(np.float16).astype(np.float32)))


@F.arrow_udf(T.ArrayType(T.FloatType()))
def round_bf16(vector: pa.Array) -> pa.Array:
    """Values as bfloat16 holds them (round half to even)."""
    flat = np.ascontiguousarray(vector.flatten().to_numpy(zero_copy_only=False).astype(np.float32)).view(np.uint32)
    kept = (flat + np.uint32(0x7FFF) + ((flat >> np.uint32(16)) & np.uint32(1))) & np.uint32(0xFFFF0000)
    return pa.ListArray.from_arrays(vector.offsets, pa.array(kept.view(np.float32)))


def expected_vs_received(expected: DataFrame, received: DataFrame, by: list[str]) -> DataFrame:
    """Per ``by`` the share of expected (part, sender) pairs that were received."""
    keys = [*by, "part", "sender"]
    got = received.select(*keys).distinct().withColumn("_got", F.lit(1))
    met = expected.join(got, keys, "left")
    return met.groupBy(*by).agg(F.count(F.lit(1)).alias("expected"), F.count("_got").alias("received"), (F.count("_got") / F.count(F.lit(1))).alias("fraction"))


def or_local(received: Column, local: Column, as_delta: bool = False) -> Column:
    """A failed part keeps the local value, or a zero delta."""
    return F.coalesce(received, F.transform(local, lambda x: F.lit(0.0)) if as_delta else local)
