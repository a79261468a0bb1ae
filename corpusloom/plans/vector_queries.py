"""Queries over ``embeddings`` grouped by label, and the share tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import vectors
from corpusloom.plans.jobs import average_vectors_by_parts
from corpusloom.session import dealt, table


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return vectors.finite_rows(table(spark, d, "embeddings"))


def rounded(column: str, digits: int = 4):
    return F.transform(column, lambda x: F.round(x, digits) + 0.0).alias(column)


def q_weighted_vector_mean(spark: SparkSession, d: str) -> DataFrame:
    return vectors.weighted_vector_mean(embeddings(spark, d), ["label"], weight=F.expr("vec_id % 4")).select("label", rounded("mean"))


def q_delta_update(spark: SparkSession, d: str) -> DataFrame:
    means = vectors.weighted_vector_mean(embeddings(spark, d), ["label"])
    met = embeddings(spark, d).join(means, "label")
    old = F.transform("embedding", lambda x: x.cast("double") / 2)
    new = vectors.delta_update(F.transform("embedding", lambda x: x.cast("double")), old, F.col("mean"))
    return met.select("vec_id", F.round(F.aggregate(new, F.lit(0.0), lambda s, x: s + x), 3).alias("total"))


def q_rotating_sparse_mean(spark: SparkSession, d: str) -> DataFrame:
    size = embeddings(spark, d).agg(F.max(F.size("embedding"))).first()[0] or 1
    out = vectors.rotating_sparse_mean(embeddings(spark, d), ["label"], 0.2, 7, size)
    return out.select("vec_id", "label", rounded("mean"))


def q_decayed_delta(spark: SparkSession, d: str) -> DataFrame:
    vec = F.transform("embedding", lambda x: x.cast("double"))
    out = vectors.decayed_delta(vec, F.transform(vec, lambda x: -2 * x), 0.9, 3, second_moment=True)
    return embeddings(spark, d).select("vec_id", F.round(F.aggregate(out, F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


def q_split_parts(spark: SparkSession, d: str) -> DataFrame:
    parts = vectors.split_parts(embeddings(spark, d).select("vec_id", "embedding"), 10)
    return parts.select("vec_id", "part_index", F.size("part").alias("n"), F.round(F.aggregate("part", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"))


def q_assign_parts(spark: SparkSession, d: str) -> DataFrame:
    li, order = table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    parts = li.select(F.expr("l_orderkey div 100").alias("job"), F.col("l_quantity").cast("long").alias("n"), *order)
    jobs = parts.select("job").distinct()
    owners = jobs.select("job", F.explode(F.array(*[F.struct(F.lit(o).alias("owner"), F.lit(f).alias("fraction")) for o, f in (("a", 0.5), ("b", 0.25), ("c", 0.25))])).alias("o")).select("job", "o.*")
    # The count is read off the footers; a task's share of the rows does not grow with them.
    owned = vectors.assign_parts(dealt(parts, li.count(), 250_000, "job"), owners, ["job"], order)
    return owned.groupBy("job", "owner").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("total"))


def q_apportion(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    return vectors.apportion(c, 100, ["nation"], "segment", "score").select("nation", "segment", "seats")


def q_sample_mean(spark: SparkSession, d: str) -> DataFrame:
    means = vectors.weighted_vector_mean(embeddings(spark, d), ["label"], weight=F.when(F.col("vec_id") % 3 == 0, 0.0).otherwise(1.0))
    return means.select("label", F.transform("mean", lambda x: F.round(F.coalesce(x, F.lit(0.0)), 4) + 0.0).alias("mean"))


def q_quantize_uniform8(spark: SparkSession, d: str) -> DataFrame:
    return vectors.quantize_uniform8(embeddings(spark, d), ["label"])[1].select("label", "code", "n", F.round("centre", 5).alias("centre"))


def q_quantize_quantile8(spark: SparkSession, d: str) -> DataFrame:
    """Fewer borders than a byte allows, so that the SQL twin stays short; ``quantize_quantile8_byte`` has all 255."""
    return vectors.quantize_quantile8(embeddings(spark, d), ["label"], borders=7)[1].select("label", "code", "n", F.round("centre", 5).alias("centre"))


def q_dequantize(spark: SparkSession, d: str) -> DataFrame:
    codes, book = vectors.quantize_quantile8(embeddings(spark, d), ["label"], borders=7)
    out = vectors.dequantize(codes, book, ["label"])
    return out.groupBy("vec_id").agg(F.round(F.sum("restored"), 4).alias("total"), F.round(F.max(F.abs(F.col("restored") - F.col("x"))), 4).alias("worst"))


def q_quantize_vectors8(spark: SparkSession, d: str) -> DataFrame:
    """Each vector by itself, in stretches of few elements, so that borders are quantiles of quantiles."""
    codes, _ = vectors.quantize_vectors8(table(spark, d, "embeddings").select("vec_id", "embedding"), borders=15, longest=20)
    return codes.select("vec_id", "pos", "code")


def by_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A job per label with three owners: one fails for odd labels, one misses every fifth sender."""
    sent = embeddings(spark, d).select("label", F.col("vec_id").alias("sender"), (1 + F.col("vec_id") % 3).cast("double").alias("weight"), "embedding")
    local = sent.groupBy("label").agg(F.min_by("embedding", "sender").alias("embedding"))
    labels = local.select("label")
    owners = labels.select("label", F.explode(F.array(*[F.struct(F.lit(o).alias("owner"), F.lit(f).alias("fraction")) for o, f in (("a", 0.5), ("b", 0.25), ("c", 0.25))])).alias("o")).select("label", "o.*")
    lost = labels.where("label % 2 = 1").select("label", F.lit("b").alias("owner"), F.lit(None).cast("long").alias("sender"))
    lost = lost.unionByName(sent.where("sender % 5 = 0").select("label", F.lit("c").alias("owner"), "sender"))
    return average_vectors_by_parts(sent, local, owners, lost, 10, ["label"])


def q_average_by_parts(spark: SparkSession, d: str) -> DataFrame:
    return by_parts(spark, d)[0].select("label", F.posexplode("embedding").alias("pos", "x")).select("label", "pos", F.round("x", 4).alias("x"))


def q_average_by_parts_received(spark: SparkSession, d: str) -> DataFrame:
    return by_parts(spark, d)[1].select("label", "expected", "received", F.round("fraction", 6).alias("fraction"))


def q_quantize_quantile8_byte(spark: SparkSession, d: str) -> DataFrame:
    return vectors.quantize_quantile8(embeddings(spark, d), ["label"])[1].select("label", "code", "n", F.round("centre", 5).alias("centre"))


def q_dequantize_byte(spark: SparkSession, d: str) -> DataFrame:
    codes, book = vectors.quantize_quantile8(embeddings(spark, d), ["label"])
    out = vectors.dequantize(codes, book, ["label"])
    return out.groupBy("vec_id").agg(F.round(F.sum("restored"), 4).alias("total"), F.round(F.max(F.abs(F.col("restored") - F.col("x"))), 4).alias("worst"))


def q_scale_meanstd(spark: SparkSession, d: str) -> DataFrame:
    out = embeddings(spark, d).select("vec_id", vectors.scale_meanstd(F.col("embedding")).alias("v"))
    return out.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 3).alias("square"), F.round(F.array_max("v"), 4).alias("top"))


def q_half_precision(spark: SparkSession, d: str) -> DataFrame:
    """Largest error of each lossy cast; not SQL, so tested against numpy."""
    e = embeddings(spark, d).select("vec_id", "embedding", vectors.clamp_fp16("embedding").alias("half"), vectors.round_bf16("embedding").alias("brain"))
    worst = lambda c: F.array_max(F.zip_with("embedding", c, lambda x, y: F.abs(x - y)))
    return e.select("vec_id", worst("half").alias("half_error"), worst("brain").alias("brain_error"))


def q_received_fraction(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as expected pairs; those shipped without return count as received."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_linenumber").alias("part"), F.col("l_orderkey").alias("sender"), "l_returnflag")
    out = vectors.expected_vs_received(li.select("owner", "part", "sender").distinct(), li.where("l_returnflag = 'N'"), ["owner"])
    return out.select("owner", "expected", "received", F.round("fraction", 6).alias("fraction"))


QUERIES = {n[2:]: f for n, f in globals().items() if n.startswith("q_")}

LONG = "long AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings)"
PARTS_SQL = """long AS (SELECT label, vec_id AS sender, (1 + vec_id % 3)::DOUBLE AS w, len(embedding)::BIGINT AS n, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
  own AS (SELECT label, n, pos, x FROM long QUALIFY sender = min(sender) OVER (PARTITION BY label)),
  p AS (SELECT DISTINCT label, n, pos // 10 AS part, pos // 10 * 10 AS low, least(n, pos // 10 * 10 + 10) AS high FROM own),
  s AS (SELECT *, greatest(0, least(high, floor(n * 0.5)) - low) AS a, greatest(0, least(high, floor(n * 0.75)) - greatest(low, floor(n * 0.5))) AS b, greatest(0, high - greatest(low, floor(n * 0.75))) AS c FROM p),
  owned AS (SELECT label, part, CASE WHEN a >= b AND a >= c THEN 'a' WHEN b >= c THEN 'b' ELSE 'c' END AS owner FROM s),
  came AS (SELECT long.* FROM long JOIN owned ON owned.label = long.label AND owned.part = pos // 10 WHERE NOT (owner = 'b' AND long.label % 2 = 1) AND NOT (owner = 'c' AND sender % 5 = 0))"""
CUTS = f"{LONG}, cuts AS (SELECT label, quantile_cont(x, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS b FROM long GROUP BY label), codes AS (SELECT vec_id, label, pos, x, len(list_filter(b, lambda q: q < x))::INT AS code FROM long JOIN cuts USING (label))"
BYTE = f"{LONG}, cuts AS (SELECT label, quantile_cont(x, {[k / 256 for k in range(1, 256)]}) AS b FROM long GROUP BY label), codes AS (SELECT vec_id, label, pos, x, len(list_filter(b, lambda q: q < x))::INT AS code FROM long JOIN cuts USING (label))"
ORACLE_SQL = {
    "weighted_vector_mean": f"WITH {LONG}, m AS (SELECT label, pos, CASE WHEN sum(vec_id % 4) <> 0 THEN sum(x * (vec_id % 4)) / sum(vec_id % 4) END AS v FROM long GROUP BY label, pos) SELECT label, list(round(v, 4) + 0.0 ORDER BY pos) AS mean FROM m GROUP BY label",
    "delta_update": f"WITH {LONG}, m AS (SELECT label, pos, avg(x) AS v FROM long GROUP BY label, pos) SELECT vec_id, round(sum(x + v - x / 2), 3) AS total FROM long JOIN m USING (label, pos) GROUP BY vec_id",
    "rotating_sparse_mean": f"""WITH {LONG}, m AS (SELECT *, ('0x' || substr(md5(pos::VARCHAR), 1, 8))::BIGINT % 5 = 2 AS hit FROM long), v AS (SELECT *, CASE WHEN hit THEN avg(x) OVER (PARTITION BY label, pos) ELSE x END AS y FROM m)
        SELECT vec_id, label, list(round(y, 4) + 0.0 ORDER BY pos) AS mean FROM v GROUP BY vec_id, label""",
    "decayed_delta": f"WITH {LONG} SELECT vec_id, round(sum(greatest(0, x - 2 * x * pow(0.9, 3))), 4) AS total FROM long GROUP BY vec_id",
    "split_parts": f"WITH {LONG} SELECT vec_id, (pos // 10)::INT AS part_index, count(*)::INT AS n, round(sum(x), 4) AS total FROM long GROUP BY 1, 2",
    "assign_parts": """WITH p AS (SELECT l_orderkey // 100 AS job, l_quantity::BIGINT AS n, row_number() OVER w AS part_index, sum(l_quantity::BIGINT) OVER w AS p_end, sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey // 100) AS total
          FROM lineitem WINDOW w AS (PARTITION BY l_orderkey // 100 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING)),
        o AS (SELECT * FROM (VALUES ('a', 0.0, 0.5), ('b', 0.5, 0.75), ('c', 0.75, 1.0)) t(owner, f0, f1)),
        b AS (SELECT job, part_index, n, owner, greatest(0, least(p_end, CASE WHEN owner = 'c' THEN total ELSE floor(f1 * total + 1e-9) END) - greatest(p_end - n, floor(f0 * total + 1e-9))) AS ov FROM p, o),
        w AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY job, part_index ORDER BY ov DESC, owner) = 1) SELECT job, owner, count(*) AS parts, sum(n)::BIGINT AS total FROM w GROUP BY 1, 2""",
    "apportion": """WITH c AS (SELECT c_nationkey AS nation, c_mktsegment AS segment, count(*)::DOUBLE AS score FROM customer GROUP BY 1, 2), b AS (SELECT *, floor(100 * score / sum(score) OVER (PARTITION BY nation) + 1e-9)::BIGINT AS base FROM c),
        l AS (SELECT *, 100 - sum(base) OVER (PARTITION BY nation) AS seats_left FROM b), q AS (SELECT *, unnest(range(1, greatest(seats_left, 1)::BIGINT + 1)) AS k FROM l),
        r AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY score / (base + k) DESC, segment) AS rk FROM q) SELECT nation, segment, (base + count(*) FILTER (rk <= seats_left))::BIGINT AS seats FROM r GROUP BY nation, segment, base""",
    "sample_mean": f"WITH {LONG}, m AS (SELECT label, pos, coalesce(avg(x) FILTER (vec_id % 3 <> 0), 0) AS v FROM long GROUP BY label, pos) SELECT label, list(round(v, 4) + 0.0 ORDER BY pos) AS mean FROM m GROUP BY label",
    "quantize_uniform8": f"""WITH {LONG}, s AS (SELECT label, avg(x) AS mu, stddev_samp(x) AS sd FROM long GROUP BY label), c AS (SELECT label, x, least(255, greatest(0, round_even((x - mu) / (6 * sd / 256), 0) + 128))::INT AS code FROM long JOIN s USING (label))
        SELECT label, code, count(*) AS n, round(avg(x), 5) AS centre FROM c GROUP BY 1, 2""",
    "quantize_vectors8": """WITH v AS (SELECT vec_id, len(embedding)::BIGINT AS n, embedding FROM embeddings),
      w AS (SELECT *, CASE WHEN n <= 20 THEN n ELSE 20 + floor((n % 20 - 1) / (n // 20))::BIGINT + 1 END AS width FROM v),
      l AS (SELECT vec_id, width, unnest(range(n)) AS pos, unnest(embedding)::DOUBLE AS x FROM w),
      i AS (SELECT vec_id, unnest(quantile_cont(x, [k / 16.0 FOR k IN range(17)])) AS q FROM l GROUP BY vec_id, pos // width),
      b AS (SELECT vec_id, quantile_cont(q, [k / 16.0 FOR k IN range(1, 16)]) AS b FROM i GROUP BY vec_id)
      SELECT vec_id, pos::INT AS pos, len(list_filter(b, lambda y: y < x))::INT AS code FROM l JOIN b USING (vec_id)""".replace("[k / 16.0 FOR k IN range(17)]", str([k / 16 for k in range(17)])).replace("[k / 16.0 FOR k IN range(1, 16)]", str([k / 16 for k in range(1, 16)])),
    "average_by_parts": f"""WITH {PARTS_SQL}, m AS (SELECT label, pos, sum(w * x) / sum(w) AS mean FROM came GROUP BY 1, 2)
      SELECT o.label, o.pos::INT AS pos, round(coalesce(mean, x), 4) AS x FROM own o LEFT JOIN m USING (label, pos)""",
    "average_by_parts_received": f"""WITH {PARTS_SQL}, e AS (SELECT DISTINCT label, sender, pos // 10 AS part FROM long), r AS (SELECT DISTINCT label, sender, pos // 10 AS part FROM came)
      SELECT e.label, count(*) AS expected, count(r.sender) AS received, round(count(r.sender) / count(*), 6) AS fraction FROM e LEFT JOIN r USING (label, sender, part) GROUP BY 1""",
    "quantize_quantile8": f"WITH {CUTS} SELECT label, code, count(*) AS n, round(avg(x), 5) AS centre FROM codes GROUP BY 1, 2",
    "dequantize": f"WITH {CUTS}, d AS (SELECT *, avg(x) OVER (PARTITION BY label, code) AS restored FROM codes) SELECT vec_id, round(sum(restored), 4) AS total, round(max(abs(restored - x)), 4) AS worst FROM d GROUP BY vec_id",
    "quantize_quantile8_byte": f"WITH {BYTE} SELECT label, code, count(*) AS n, round(avg(x), 5) AS centre FROM codes GROUP BY 1, 2",
    "dequantize_byte": f"WITH {BYTE}, d AS (SELECT *, avg(x) OVER (PARTITION BY label, code) AS restored FROM codes) SELECT vec_id, round(sum(restored), 4) AS total, round(max(abs(restored - x)), 4) AS worst FROM d GROUP BY vec_id",
    "scale_meanstd": f"WITH {LONG}, s AS (SELECT vec_id, x - avg(x) OVER (PARTITION BY vec_id) AS c FROM long), t AS (SELECT vec_id, c / greatest(sqrt(avg(c * c) OVER (PARTITION BY vec_id)), 1e-6) AS v FROM s) SELECT vec_id, round(sum(v * v), 3) AS square, round(max(v), 4) AS top FROM t GROUP BY vec_id",
    "received_fraction": "WITH e AS (SELECT l_suppkey AS owner, l_linenumber, l_orderkey, bool_or(l_returnflag = 'N') AS got FROM lineitem GROUP BY 1, 2, 3) SELECT owner, count(*) AS expected, count(*) FILTER (got) AS received, round(count(*) FILTER (got) / count(*), 6) AS fraction FROM e GROUP BY owner",
}
