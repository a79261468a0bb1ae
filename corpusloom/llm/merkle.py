"""Merkle dataset manifest by time-forward processing (operator 13).

A node's label is its level and index, so labels in order are an order in which children come before parents.  Time-forward
processing sends each digest ahead to its parent's label in a priority queue, from which a parent, when its turn comes, takes
what its children sent.  Spark's sort by label is the external part of that queue: nodes are ranked and sorted into blocks of
``2**bits`` neighbours, a task runs the queue over one block at a time and sends the block's root ahead to the next round, which has
so many times fewer nodes.  The reversed sweep goes the same blocks from the top down and hands each child its parent's proof
with the sibling's digest in front; rounds pass one proof for each block, and only the last one a proof for each leaf.

A block is at most ``2**bits`` digests, whatever the size of a group, and the driver sees the size of the largest group alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from heapq import heappop, heappush
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.ordered import with_rank
from corpusloom.session import stored

#: Levels of a block, so 4096 nodes.
BITS = 12
#: Rows that a task hands on together.
BATCH = 4096

NODE = "_g string, _rank long, _total long, _digest binary"
PROOF = "_g string, _rank long, _path string, _subroot string, _root string"


def encoded(field: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, colon, value."""
    text = field.cast("string")
    return F.when(field.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, fields)), 256)


def forward(digests: list[str], height: int) -> tuple[str, list[tuple[int, int, list[str]]]]:
    """Root ``height`` levels above neighbouring nodes, and each parent on the way in label order: level, index, its children's digests."""
    queue = [(0, i, d) for i, d in enumerate(digests)]
    parents = []
    while queue[0][0] < height:
        level, index, digest = heappop(queue)
        run = [digest]
        if queue and queue[0][:2] == (level, index + 1):
            run.append(heappop(queue)[2])
        parents.append((level + 1, index // 2, run))
        heappush(queue, (level + 1, index // 2, hashlib.sha256("".join(run).encode()).hexdigest()))
    return queue[0][2], parents


def backward(parents: list[tuple[int, int, list[str]]], height: int, path: str) -> list[str]:
    """Proofs of the nodes that ``forward`` started from; ``path`` is the proof of their root.

    A proof is a step for each level: ``R`` or ``L`` and the sibling's digest, by the side on which it stands, or ``N`` for none.
    """
    level, paths = height, [path]
    for above, row in groupby(reversed(parents), key=itemgetter(0)):
        below: list[str] = []
        for own, (_, _, run) in zip(reversed(paths), row, strict=True):
            # Children are met from the last to the first.
            below += [f"L{run[0]}{own}", f"R{run[1]}{own}"] if len(run) > 1 else [f"N{own}"]
        level, paths = above - 1, below[::-1]
    assert level == 0
    return paths


def height_of(total: int, bits: int) -> int:
    """Levels that a block of a tree over ``total`` nodes climbs."""
    return min(bits, (total - 1).bit_length())


def block_of(bits: int) -> Column:
    return F.shiftright("_rank", bits).alias("_block")


def in_blocks(nodes: DataFrame) -> DataFrame:
    """Rows ``_g, _block, _rank, ...``, one block after another."""
    first = ["_g", "_block", "_rank"]
    return nodes.select(*first, *[c for c in nodes.columns if c not in first]).repartition("_g", "_block").sortWithinPartitions(*first)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    every = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for _, rows in groupby(every, key=itemgetter(0, 1)):
        yield list(rows)


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) >= BATCH:
            yield batch()
            held = []
    if held:
        yield batch()


def climb(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """Nodes (``NODE``) of each round, from the given ones to one root for each ``_g``."""
    schema = pa.schema([("_g", pa.string()), ("_rank", pa.int64()), ("_total", pa.int64()), ("_digest", pa.binary())])

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for rows in _blocks(batches):
                g, block, _, total, _ = rows[0]
                root, _ = forward([r[4].hex() for r in rows], height_of(total, bits))
                yield g, block, -(-total >> bits), bytes.fromhex(root)

        yield from _batched(found(), schema)

    rounds = [nodes]
    while (rounds[-1].agg(F.max("_total")).first()[0] or 0) > 1:
        rounds.append(stored(in_blocks(rounds[-1].select("_g", block_of(bits), "_rank", "_total", "_digest")).mapInArrow(roots, NODE)))
    return rounds


def descend(rounds: list[DataFrame], proofs: DataFrame, bits: int, kept: str = "") -> DataFrame:
    """Proofs (``PROOF``) of the first round's nodes from those of the last round's, with ``_digest`` and, if it is named, the nodes' column ``kept``."""

    def handed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = next(batches, None)
        if head is None:
            return
        own = {"_path", "_subroot", "_root", "_g", "_rank", "_digest"}
        names = ["_g", "_rank", "_path", "_subroot", "_root", "_digest", *[n for n in head.schema.names if n not in own | {"_block", "_total"}]]

        def found() -> Iterator[tuple]:
            for (_, _, _, path, subroot, root, *_), *rows in _blocks(chain([head], batches)):
                height = height_of(rows[0][6], bits)
                _, parents = forward([r[7].hex() for r in rows], height)
                for r, p in zip(rows, backward(parents, height, path), strict=True):
                    yield r[0], r[2], p, subroot, root, *r[7:]

        yield from _batched(found(), pa.schema([head.schema.field(n) for n in names]))

    for i in range(len(rounds) - 2, -1, -1):
        extra = [kept] if kept and i == 0 else []
        nodes = rounds[i].select("_g", block_of(bits), "_rank", "_total", "_digest", *extra)
        # A block's proof is its first row.
        heads = proofs.select("_g", F.col("_rank").alias("_block"), F.lit(-1).cast("long").alias("_rank"), "_path", "_subroot", "_root")
        rows = in_blocks(heads.unionByName(nodes, allowMissingColumns=True))
        kinds = dict(rows.dtypes)
        proofs = rows.mapInArrow(handed, ", ".join([PROOF, "_digest binary", *[f"{c} {kinds[c]}" for c in extra]]))
    if len(rounds) == 1:
        proofs = proofs.join(rounds[0].select("_g", "_rank", "_digest", *([kept] if kept else [])), ["_g", "_rank"])
    return proofs


def folded(digest: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest and its proof."""
    steps = F.filter(F.split(path, "(?=[LRN])"), lambda s: s != "")

    def up(at: Column, step: Column) -> Column:
        side, sibling = F.substring(step, 1, 1), F.substring(step, 2, 64)
        return F.sha2(F.when(side == "L", F.concat(sibling, at)).otherwise(F.concat(at, sibling)), 256)

    return F.aggregate(steps, digest, up)


def proof_digest(path: Column) -> Column:
    """SHA-256 of a proof's sibling digests, in order."""
    return F.sha2(F.translate(path, "LRN", ""), 256)


def merkle_proofs(rows: DataFrame, leaf: Column, group: Column, order: Sequence[Column], carried: Sequence[Column], bits: int = BITS) -> DataFrame:
    """Inclusion proofs: ``carried`` columns, ``leaf, subroot, root, path`` (hex digests; see ``backward``), one row per input row.

    In each ``group`` (a string; null first, then bytewise) leaves ascend by ``order`` (nulls first), then digest.  While more than
    one node is left, each two neighbours, or the last one alone, become their SHA-256 as hex text.  The groups' roots
    become the root alike.  An empty table gives an empty result.
    """
    keyed = rows.select(F.struct(*carried).alias("_kept"), F.unhex(leaf).alias("_digest"), F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("_g"), *[c.alias(f"_o{i}") for i, c in enumerate(order)])
    keys = [f"_o{i}" for i in range(len(order))]
    leaves = stored(with_rank(keyed, "_g", [*keys, "_digest"]).drop(*keys))
    rounds = climb(leaves, bits)
    subroots = stored(with_rank(rounds[-1].select(F.lit("").alias("_all"), F.col("_g").alias("_of"), "_digest"), "_all", ["_of"]))
    tops = climb(subroots.withColumnRenamed("_all", "_g"), bits)
    root = tops[-1].select("_g", "_rank", F.lit("").alias("_path"), F.lit(None).cast("string").alias("_subroot"), F.lower(F.hex("_digest")).alias("_root"))
    above = descend(tops, root, bits, "_of")
    heads = stored(above.select(F.col("_of").alias("_g"), F.lit(0).cast("long").alias("_rank"), "_path", F.lower(F.hex("_digest")).alias("_subroot"), "_root"))
    # Proofs are long, so the rows' own columns go to them and not they to the rows.
    return descend(rounds, heads, bits, "_kept").select("_kept.*", F.lower(F.hex("_digest")).alias("leaf"), F.col("_subroot").alias("subroot"), F.col("_root").alias("root"), F.col("_path").alias("path"))


def verify_manifest(docs: DataFrame, every: int = 7, id_col: str = "doc_id", group_col: str = "lang", count_col: str = "n_chars", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), bits: int = BITS) -> DataFrame:
    """Build the manifest of ``docs``, tamper with some rows, and verify every row by its proof.

    Result, one row per input row: ``id_col, leaf, subroot, root, proof_sha256`` of the rows as they are, ``folded_root`` (from
    the tampered leaf, if any, and the original siblings) and ``verified`` (whether that is the root).  Tampering adds 1
    to ``count_col`` where ``every`` divides the CRC-32 of the id's decimal digits; null counts, and rows without id, stay.

    Nulls differ from empty values in a leaf; rows of equal id stand in the order of their digests, those without id first,
    those without group in a group of their own before all others.  Texts may have any length; equal rows are leaves of their own;
    an empty table gives an empty result; other columns are not read.
    """
    count = F.col(count_col)
    tampered = F.coalesce(F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")), F.lit(every)) == 0, F.lit(False)) & count.isNotNull()
    # Decimal, so that the largest long can be raised too.
    raised = [(F.col(c).cast("decimal(20,0)") + 1) if c == count_col else F.col(c) for c in fields]
    # Texts are hashed here, once (twice where tampered), and do not go further.
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(group_col).cast("string").alias("_group"), leaf_digest([F.col(c) for c in fields]).alias("_leaf"), F.when(tampered, F.unhex(leaf_digest(raised))).alias("_tampered"))
    proofs = merkle_proofs(narrow, F.col("_leaf"), F.col("_group"), [F.col("_id")], [F.col("_id"), F.col("_tampered")], bits)
    start = F.coalesce(F.lower(F.hex("_tampered")), "leaf")
    out = proofs.withColumn("folded_root", folded(start, F.col("path")))
    return out.select(F.col("_id").alias(id_col), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
