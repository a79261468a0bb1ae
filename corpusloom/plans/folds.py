"""Ordered folds with carried state: sorted rows pass batch by batch, and only one key's state is held."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (state, rows of one key that lie together) -> (state, output columns).  The state of a new key is None.
Step = Callable[[Any, pa.RecordBatch], tuple[Any, Sequence[Any]]]


def ordered_fold(rows: DataFrame, by: str, order: Sequence[Column | str], step: Step, schema: str) -> DataFrame:
    """Fold each ``by``'s rows in ``order``: ``by`` (a string) and the columns of ``schema`` that ``step`` gives for each stretch of rows.

    Rows are dealt by key and sorted by Spark, which spills; a key may have any number of rows, and they may come in
    any number of batches.  A key is one task in time.  Null is a key of its own.
    """
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, first = None, None, True
        for batch in batches:
            codes = pc.dictionary_encode(batch.column(0), null_encoding="encode").indices.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), batch.num_rows]
            for p, q in zip(cuts[:-1], cuts[1:], strict=True):
                if p == q:
                    continue
                at = batch.column(0)[p].as_py()
                if first or at != key:
                    key, state, first = at, None, False
                state, out = step(state, batch.slice(p, q - p))
                if len(out[0]):
                    yield pa.record_batch([pa.array([key] * len(out[0]), pa.string()), *(pa.array(c) for c in out)], names=[by, *(f[0] for f in fields)])

    dealt = rows.withColumn(by, F.col(by).cast("string")).select(by, *[c for c in rows.columns if c != by]).repartition(by).sortWithinPartitions(F.asc_nulls_last(by), *order)
    return dealt.mapInArrow(fold, f"{by} string, {schema}")


def window_sums(state: tuple[int, float] | None, us: np.ndarray, value: np.ndarray, span_us: float) -> tuple[tuple[int, float] | None, list[tuple[int, int, float]]]:
    """Sums from an anchor on; the first row more than ``span_us`` later closes the sum and is the next anchor.

    ``us`` ascends.  State is the anchor and its sum so far; closed windows are anchor, closing time, sum.
    """
    closed, at = [], 0
    while at < len(us):
        anchor, total = state if state else (int(us[at]), 0.0)
        end = max(at, int(np.searchsorted(us, anchor + span_us, side="right")))
        state = (anchor, total + float(value[at:end].sum()))
        if end < len(us):
            closed.append((anchor, int(us[end]), state[1]))
            state = (int(us[end]), 0.0)
        at = end
    return state, closed


def phases(state: tuple[int, int] | None, stale: np.ndarray, phase1: int, phase2: int) -> tuple[tuple[int, int], np.ndarray]:
    """Phase of each step; state is the phase and how many of its steps are left.  Stretches of one phase are filled at once."""
    phase, left = state if state else (0, 0)
    out, starts, at = np.zeros(len(stale), np.int32), np.flatnonzero(stale), 0
    while at < len(stale):
        if phase == 0:
            k = np.searchsorted(starts, at)
            if k == len(starts):
                break
            at, phase, left = int(starts[k]), 1, phase1
        elif left:
            n = min(left, len(stale) - at)
            out[at : at + n] = phase
            at, left = at + n, left - n
            continue
        else:
            phase, left = (2, phase2) if phase == 1 and phase2 > 0 else (0, 0)
        out[at] = phase
        at, left = at + 1, max(0, left - 1)
    return (phase, left), out
