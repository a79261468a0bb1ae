"""Best-fit packing planned on the length histogram (operator 6).

Only piece lengths matter to best-fit, and there are at most ``capacity`` of them.  The plan works on
counts: identical sequences are one entry with a count, so its cost depends on the number of distinct
lengths, not of documents.  It yields runs ("ranks lo..hi of length L fill these sequences at this
offset"), which are unfolded into slots on the executors; pieces take slots by an equality join on
(length, rank within length).
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.token_pieces import encoder
from corpusloom.plans.ranking import hash_bucket, with_prefix_sum
from corpusloom.session import cut, dealt

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Sequences whose slots are unfolded together.
SPAN = 1 << 12
#: Rows of one length that a bucket is meant to have.
ROWS = 1 << 16


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids; a text's ids are followed by ``end_id``, so each row has a piece."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = end_id.to_bytes(4, "little")
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + keep_ids]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids]
        for whole in batches:
            for batch, all_ids, bounds in enc.batches(whole, 1):
                out: list[list] = [[] for _ in names]
                for k, doc in enumerate(batch.column(0).to_pylist()):
                    ids = all_ids[bounds[k] : bounds[k + 1]].tobytes() + end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        for column, value in zip(out, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part), part), strict=False):
                            column.append(value)
                yield pa.record_batch([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=names)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(pieces, PIECE + (", ids binary" if keep_ids else ""))


def plan_best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs ``(length, rank_lo, n, first_sequence, per_sequence, offset)``.

    Rank ``rank_lo + j`` of a length goes to sequence ``first_sequence + j div per_sequence`` at
    ``offset + (j mod per_sequence) * length``.
    """
    runs = []
    space: dict[int, list[tuple[int, int]]] = {}  # free room -> (first sequence, sequences)
    rooms: list[int] = []  # sorted keys of space
    next_sequence = 0

    def free(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in space:
                space[room] = []
                insort(rooms, room)
            space[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, n = space[room].pop()
                if not space[room]:
                    del space[room]
                    rooms.pop(i)
            else:
                room, first = capacity, next_sequence
                n = -(-left // (capacity // length))
                next_sequence += n
            each = room // length
            full = min(n, left // each)
            at = capacity - room
            if full:
                runs.append((length, rank, full * each, first, each, at))
                free(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            rest = n - full
            if rest and left:
                some = min(left, each)  # fewer than a sequence takes
                runs.append((length, rank, some, first + full, some, at))
                free(room - some * length, first + full, 1)
                rank, left, full, rest = rank + some, left - some, full + 1, rest - 1
            free(room, first + full, rest)
    return runs


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = False,
    seed: str = "pack",
) -> DataFrame:
    """Pack whole documents: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``).

    A document is its ids and ``end_id``; one longer than ``capacity`` is cut into pieces.  Null texts are
    empty: a piece of one id.  Repeated rows and null ids get places of their own; an empty table gives an
    empty result.  Other columns are not read.  The driver sees the histogram and the runs, a few thousand rows at any size.
    """
    spark = docs.sparkSession
    # Tokenized once; the histogram and the slot join both read it.
    pieces = cut(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, keep_ids))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = plan_best_fit(histogram, capacity)
    each_span = F.expr(f"n div (each * {SPAN}L) + if(n % (each * {SPAN}L) > 0, 1L, 0L)")
    spans = sum(-(-n // (SPAN * each)) for _, _, n, _, each, _ in runs)
    plan = spark.createDataFrame(runs, "length long, rank long, n long, first long, each long, at long").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), each_span - 1)))
    plan = dealt(plan.select("length", "rank", "n", "first", "each", "at", "k"), spans, 128)
    start = F.col("k") * SPAN * F.col("each")
    slots = plan.withColumn("j", F.explode(F.sequence(start, F.least(start + SPAN * F.col("each"), "n") - 1))).select(
        F.col("length").alias("slot_length"),
        (F.col("rank") + F.col("j")).alias("slot_rank"),
        F.expr("first + j div each").alias("sequence_id"),
        F.expr("at + (j % each) * length").alias("offset"),
    )
    # The content is part of the order, so that rows without id, or of one id, are spread as well; buckets follow the commonest length.
    digits = max(2, min(7, math.ceil(math.log(max([1, *histogram.values()]) / ROWS, 16))))
    keyed = pieces.withColumn("_order", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "piece", "ids_crc32"))).withColumn("_bucket", hash_bucket("_order", digits))
    ranked = with_prefix_sum(keyed, F.lit(1), ["length"], "_bucket", ["_order", "ids_crc32"], "rank")
    # There are as many slots as pieces, which the planner cannot know: they must not be broadcast.
    placed = ranked.join(slots.hint("merge"), (F.col("length") == F.col("slot_length")) & (F.col("rank") == F.col("slot_rank")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * keep_ids)
