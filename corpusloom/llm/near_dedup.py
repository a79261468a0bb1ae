"""Near-duplicate groups by SetSketch registers (operator 9).

1. Texts become sets of word-shingle hashes; equal sets are one node from here on.
2. Nodes meet in buckets by bands of register values.
3. In each bucket all nodes are paired with one leader (a star, never all pairs); the Jaccard similarity of a pair is
   estimated jointly by likelihood, and pairs that pass are verified on the full sets.
4. Links join nodes to components.  Buckets whose nodes are all in one component are settled: more links could not
   change the result.  The others get stars around other leaders, and what still lies apart is compared across the
   components of a bucket, so no link between nodes that share a bucket is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import setsketch
from corpusloom.llm.ordered import with_rank
from corpusloom.llm.shingles import WordHash, shingle_set
from corpusloom.plans.components import connected_components
from corpusloom.plans.groups import with_group_values
from corpusloom.session import stored

SKETCH = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, regs binary"
#: Rows of a batch that are sketched together.
ROWS = 256


def sketched(docs: DataFrame, width: int, m: int, rows: int) -> DataFrame:
    """Set size, 128-bit set digest, band keys and registers of ``doc_id, text`` rows."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                sets = [shingle_set(t, width, hashes) for t in batch.column(1).to_pylist()]
                regs = setsketch.sketches(sets, m)
                keys = setsketch.band_keys(regs, rows)
                digests = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
                columns = [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digests[:, 0]),
                    pa.array(digests[:, 1]),
                    pa.array(list(keys), pa.list_(pa.int64())),
                    pa.array([r.tobytes() for r in regs], pa.binary()),
                ]
                yield pa.record_batch(columns, names=["doc_id", "n_shingles", "d1", "d2", "bands", "regs"])

    return docs.select("doc_id", "text").mapInArrow(sketch, SKETCH)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                found = [shingle_set(t, width, hashes).view(np.int64) for t in batch.column(1).to_pylist()]
                yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(sets, "doc_id long, shingles array<long>")


#: Bits of a parity sketch.
PARITY = 2048


def parity_sketches(sets: DataFrame) -> DataFrame:
    """``doc_id, n, bits``: set size, and a bit for each place, set if an odd number of shingles falls there."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for shingles in batch.column(1):
                place = shingles.values.to_numpy().view(np.uint64) % np.uint64(PARITY)
                odd = np.bincount(place.astype(np.int64), minlength=PARITY) & 1
                found.append(np.packbits(odd.astype(np.uint8)).tobytes())
            sizes = pa.compute.list_value_length(batch.column(1)).cast(pa.int64())
            yield pa.record_batch([batch.column(0), sizes, pa.array(found, pa.binary())], names=["doc_id", "n", "bits"])

    return sets.mapInArrow(sketch, "doc_id long, n long, bits binary")


def likely(pairs: DataFrame, nodes: DataFrame, least: float, m: int) -> DataFrame:
    """Pairs ``a, b`` whose sizes allow the similarity and whose likelihood estimate lies within five deviations of it."""

    @F.pandas_udf("double")
    def estimate(ra: pd.Series, rb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        a = np.frombuffer(b"".join(ra), np.uint16).reshape(-1, m)
        b = np.frombuffer(b"".join(rb), np.uint16).reshape(-1, m)
        more, less = (a > b).sum(1), (a < b).sum(1)
        return pd.Series(setsketch.joint_jaccard(more, less, m - more - less, na.to_numpy(np.float64), nb.to_numpy(np.float64)))

    slack = 5 * (least * (1 - least) / m) ** 0.5
    met = met_facts(pairs, nodes, ["n_shingles", "regs"]).where(F.least("n_shingles_a", "n_shingles_b") >= F.lit(least - 1e-9) * F.greatest("n_shingles_a", "n_shingles_b"))
    return met.where(estimate("regs_a", "regs_b", "n_shingles_a", "n_shingles_b") >= least - slack).select("a", "b").distinct()


def met_facts(pairs: DataFrame, facts: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs ``a, b`` with the ``columns`` of both nodes, as ``<column>_a`` and ``<column>_b``.

    A leader may be in very many pairs.  These are two longs each, streamed past one row of facts, and both sides of the join are
    dealt out for it alone, so that adaptive execution splits such a leader.
    """
    for side in ("a", "b"):
        pairs = pairs.join(facts.select(F.col("doc_id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
    return pairs


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union on the full sets."""
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    met = met_facts(pairs, sets, ["shingles"])
    return met.where(100 * both >= percent * (F.size("shingles_a") + F.size("shingles_b") - both)).select("a", "b")


def settled_apart(labelled: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of buckets whose nodes are not all in one component, with their present component."""
    now = labelled.select("key", "doc_id").join(roots, F.col("doc_id") == F.col("node"), "left")
    now = stored(now.select("key", "doc_id", F.coalesce("root", "doc_id").alias("comp")))
    apart = with_group_values(now, ["key"], F.xxhash64("doc_id"), [], [F.min("comp").alias("_a"), F.max("comp").alias("_b")], "_a <> _b")
    return stored(apart.select("key", "doc_id", "comp"))


def star_pairs(labelled: DataFrame, order: F.Column) -> DataFrame:
    """Each node with the first node of its bucket by ``order``, where that is of another component."""
    first = F.min(F.struct(order.alias("o"), F.col("doc_id").alias("id"), F.col("comp").alias("c"))).alias("_l")
    met = with_group_values(labelled, ["key"], F.xxhash64("doc_id"), [], [first]).where("comp <> _l.c")
    return met.select(F.least("doc_id", "_l.id").alias("a"), F.greatest("doc_id", "_l.id").alias("b")).distinct()


#: Nodes of a bucket in one strip; two strips are compared at a time.
STRIP = 1024


def cross_pairs(labelled: DataFrame, sets: DataFrame, percent: int, strip: int = STRIP) -> DataFrame:
    """Pairs of a bucket from different components that could be linked at all.

    Each node has a parity sketch of its whole set: every shingle flips one of ``PARITY`` bits.  The bits in which two
    sketches differ are at most the shingles that only one of the sets has, so a pair with more of them than the
    similarity allows is left out for certain, and what is left is not much more than the links.

    The nodes of a bucket are ranked by set size and cut into strips; a strip is one row.  Strips whose sizes are near enough are
    paired, one row for each two, so rows are as many as pairs of strips and not of nodes, and no bucket is one task's work.
    """
    known = parity_sketches(sets)
    ranked = with_rank(labelled.select("key", "doc_id", "comp").join(known, "doc_id"), "key", ["n", "doc_id"])
    node = F.struct("doc_id", "comp", "n", "bits")
    strips = stored(ranked.groupBy("key", F.expr(f"_rank div {strip}").alias("strip")).agg(F.collect_list(node).alias("nodes"), F.min("n").alias("low"), F.max("n").alias("high"), F.min("comp").alias("first"), F.max("comp").alias("last")))
    ends = strips.select("key", "strip", "low", "high", "first", "last")
    other = ends.select("key", *[F.col(c).alias(f"_{c}") for c in ends.columns[1:]])
    near = (F.col("strip") <= F.col("_strip")) & (100 * F.col("high") >= percent * F.col("_low")) & ((F.col("first") != F.col("_last")) | (F.col("last") != F.col("_first")))
    pairs = ends.join(other, "key").where(near).select("key", "strip", "_strip")
    met = pairs.join(strips.select("key", "strip", "nodes"), ["key", "strip"]).join(strips.select("key", F.col("strip").alias("_strip"), F.col("nodes").alias("_nodes")), ["key", "_strip"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one, two = (_strip_columns(batch.column(c)[k].values) for c in (1, 2))
                left, right = close_nodes(one, two, percent, batch.column(0)[k].as_py())
                yield pa.record_batch([pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right))], names=["a", "b"])

    # A row is two strips, so few make a batch.
    rows = met.select((F.col("strip") == F.col("_strip")).alias("same"), "nodes", "_nodes")
    return rows.mapInArrow(compared, "a long, b long").distinct()


def _strip_columns(nodes: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, comp, n = (nodes.field(c).to_numpy() for c in ("doc_id", "comp", "n"))
    return ids, comp, n, np.frombuffer(b"".join(nodes.field("bits").to_pylist()), np.uint64).reshape(len(nodes), PARITY // 64)


def close_nodes(one: tuple, two: tuple, percent: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of nodes of two strips (each pair once, if they are the ``same``) of different components, whose sizes and bits allow a link."""
    ids, comp, n, bits = two
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, (doc, c, size, own) in enumerate(zip(*one, strict=True)):
        start = i + 1 if same else 0
        fits = (comp[start:] != c) & (100 * np.minimum(size, n[start:]) >= percent * np.maximum(size, n[start:]))
        at = start + np.flatnonzero(fits)
        apart = np.bitwise_count(bits[at] ^ own).sum(axis=1, dtype=np.int64)
        at = at[(100 + percent) * apart <= (100 - percent) * (size + n[at])]
        left.append(np.full(len(at), doc))
        right.append(ids[at])
    return np.concatenate(left), np.concatenate(right)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of the similarity graph: ``doc_id, n_shingles, component_id, kept``, one row per input row.

    Documents are linked when the Jaccard similarity of their ``width``-word shingle sets is ``percent``/100 or more;
    ``component_id`` is the smallest id reachable and its row is kept.  A text without words (null, empty) has an empty
    set and is linked with nothing.  A link can be missed in two ways: its nodes share no band (for 32 bands of 4 registers a
    chance of 5e-8 at similarity 0.8), or the estimate of its similarity, by which pairs are chosen for the exact test, lies five
    deviations too low (below 1e-6 at similarity 0.8; nodes that other links connect lose nothing).  A row without id joins the group of an equal set and is
    kept only where no row of it has an id; an id repeated with other texts is one node with several sets.  An empty
    table gives an empty result; other columns are not read.
    """
    m, least = bands * rows, percent / 100
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = stored(sketched(slim, width, m, rows))
    same = stored(sketch.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))).where("rep is not null")
    nodes = sketch.where("n_shingles > 0").join(same.select(F.col("rep").alias("_rep")).distinct(), F.col("doc_id") == F.col("_rep"), "left_semi")
    keyed = nodes.select("doc_id", F.explode("bands").alias("key"))
    # Rows of buckets with more than one node: the only rows that later rounds read, and the only sets they need.
    crowded = with_group_values(keyed, ["key"], F.xxhash64("doc_id"), [], [F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")], "_a <> _b")
    labelled = stored(crowded.select("key", "doc_id").distinct()).withColumn("comp", F.col("doc_id"))
    met = stored(labelled.select(F.col("doc_id").alias("_id")).distinct())
    sets = stored(shingle_sets(slim.join(met, F.col("doc_id") == F.col("_id"), "left_semi"), width))
    nodes = stored(nodes.join(met, F.col("doc_id") == F.col("_id"), "left_semi").select("doc_id", "n_shingles", "regs"))

    tested = roots = None
    joined = False  # whether the last round joined anything
    # Stars by one order for all buckets, so a group tends to one leader; then by another for each bucket; then all pairs
    # that could still be linked.
    for round_no in range(3):
        if joined:
            labelled = settled_apart(labelled, roots)
            if labelled.isEmpty():
                break
        if round_no < 2:
            pairs = star_pairs(labelled, F.xxhash64("doc_id") if not round_no else F.xxhash64("doc_id", "key"))
        else:
            pairs = cross_pairs(labelled, sets.join(labelled.select(F.col("doc_id").alias("_id")).distinct(), F.col("doc_id") == F.col("_id"), "left_semi"), percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs)
        joined = False
        if pairs.isEmpty():
            if not round_no:
                break
            continue
        new = stored(verified(stored(likely(pairs, nodes, least, m)), sets, percent))
        tested = pairs if tested is None else tested.unionByName(pairs)
        joined = not new.isEmpty()
        if joined:
            # What is joined already is stars, so few steps are left.
            roots = connected_components(new if roots is None else new.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    return _labelled(sketch, same, roots)


def _labelled(sketch: DataFrame, same: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is not None:
        same = same.join(roots, F.col("rep") == F.col("node"), "left").select("d1", "d2", F.coalesce("root", "rep").alias("rep"))
    same = stored(same).select(F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), "rep")
    out = sketch.select("doc_id", "n_shingles", "d1", "d2").join(same, (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")), "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that ``near_duplicates`` keeps, with all their columns."""
    kept = near_duplicates(docs, width, percent, id_col=id_col, text_col=text_col).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_kept_id"]), "left_semi")
