"""Values of whole groups brought back to their rows, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_group_values(rows: DataFrame, keys: Sequence[str], salt: Column, parts: Sequence[Column], wholes: Sequence[Column], keep: str | None = None, salts: int = 32) -> DataFrame:
    """Add aggregates of each row's group: ``parts`` per (keys, salt), ``wholes`` over those per keys.

    No group meets in one task: rows are reduced per (keys, salt) first, and the group's values then go back to the salts
    that the group has, not to its rows.  ``salt`` is an integer column that follows from the row alone, so that a task which
    runs again gives the same.  ``keep`` filters groups; rows of others go.  Keys must not be null; ``salts`` is at most 63.

    Without ``parts``, ``wholes`` are over the rows, and must be aggregates that a map task reduces to one row a group (least,
    greatest, counts, sums; not lists): then each task sends a group one row at most, and one shuffle less is needed.
    """
    salted = rows.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    seen = F.expr("bit_or(shiftleft(1L, _salt))").alias("_seen")
    whole = (salted.groupBy(*keys, "_salt").agg(*parts) if parts else salted).groupBy(*keys).agg(*wholes, seen)
    if keep:
        whole = whole.where(keep)
    whole = whole.withColumn("_salt", F.explode(F.expr(f"filter(sequence(0, {salts - 1}), s -> (_seen & shiftleft(1L, s)) <> 0)"))).drop("_seen")
    return salted.join(whole, [*keys, "_salt"]).drop("_salt")
