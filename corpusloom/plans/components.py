"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.groups import with_group_values
from corpusloom.session import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over ``a, b`` rows: neighbours of each node are moved to the least node around.

    A node may have a third of all edges: its least neighbour is found by task and brought back to salted parts.
    """
    if large:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    met = with_group_values(around, ["a"], F.xxhash64("b"), [], [F.min("b").alias("_m")])
    if large:
        moved = met.where("b > a").select(F.col("b").alias("a"), F.least("a", "_m").alias("b"))
    else:
        # The edge to the least neighbour stays, as no edge is repeated; the other neighbours move there.
        moved = met.select(F.when(F.col("b") == F.col("_m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("_m").alias("b"))
    return moved.where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether distinct ``a > b`` edges are stars around their ``b``: whatever is an ``a`` is in one edge only."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("end")).select("end.*")
    more = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("n")).where("up > 0 and n > 1")
    return not more.agg(F.count(F.lit(1)).alias("n")).first()["n"]


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``a, b`` edges that is not the least of its component.

    Nodes are non-null longs; self-edges and repeated edges do not matter.  Each step is stored, so a lost executor
    costs one step; the steps grow with the logarithm of the longest path.  Every step is some ten stages, whose tasks the driver
    keeps account of, so the end is seen from the edges themselves and not from a step that changes nothing.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        if _settled(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = stored(_star(_star(now, True), False))
    raise RuntimeError("components did not settle")
