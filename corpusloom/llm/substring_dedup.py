"""Substring deduplication with a log-structured fingerprint index (operator 7).

A window is ``WINDOW`` consecutive words.  Within a window, the ``GRAM``-word gram with the least hash is its
anchor; windows of one document that share an anchor occurrence form a span.  Equal windows have equal anchors,
so one row per span (about an eighth of the windows) finds every repeated window:

* two spans of equal content repeat all their windows: the later span is removed as a whole;
* spans of different content with one anchor may share some windows: these few spans are opened, and their
  windows are compared one by one.

A match is verified by a second hash of the content, built on other hashes of the words, so that what tells contents apart is
128 bits of words that have 128 bits themselves.  Texts are shuffled as zstd frames.

The index is a list of immutable runs, tables bucketed by anchor and sorted, which hold the first span of each
content.  A batch's spans are merge-joined with the runs, the spans not seen before become a new run, and runs
are compacted into one when there are too many.  Batches come in the order of document ids.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WINDOW = 20
GRAM = 5
#: Words that are hashed together, and words remembered by a Python worker; results depend on neither.
CHUNK_WORDS = 1 << 18
CACHE = 1 << 18
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
SPAN = "h long, r long, v long, doc_id long, start int, n int, dup boolean"
WIN = "w1 long, w2 long, doc_id long, start int, dup boolean"


class WordHash(dict):
    """Places of the words met, and at each place two 64-bit hashes of the word."""

    def __init__(self) -> None:
        super().__init__()
        self.digests = bytearray()

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = place = len(self)
        self.digests += xxhash.xxh3_128_digest(word, 7)
        return place

    def pairs(self, words: list[list[bytes]], total: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self) >= CACHE:
            self.clear()
            self.digests.clear()
        at = np.fromiter((self[x] for w in words for x in w), np.int64, total)
        both = np.frombuffer(bytes(self.digests), np.uint64).reshape(-1, 2)
        return both[at, 0], both[at, 1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(ODD[0])
    return x ^ (x >> np.uint64(29))


def rolled(ids: np.ndarray, width: int, odd: int) -> np.ndarray:
    """Polynomial hash mod 2^64 of every ``width`` consecutive ids."""
    power = np.full(len(ids), odd, np.uint64)
    power[0] = 1
    back = np.full(len(ids) - width + 1, pow(odd, -1, 1 << 64), np.uint64)
    back[0] = 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids * np.cumprod(power))])
    return mixed((total[width:] - total[:-width]) * np.cumprod(back))


class Words:
    """Words of some documents, end to end, and the windows that lie within one document."""

    def __init__(self, words: list[list[bytes]], hashes: WordHash):
        sizes = np.array([len(w) for w in words], np.int64)
        self.first = np.cumsum(sizes) - sizes
        self.ids, self.checks = hashes.pairs(words, int(sizes.sum()))
        self.doc = np.repeat(np.arange(len(words)), sizes)
        n = len(self.ids) - WINDOW + 1
        self.starts = np.flatnonzero(self.doc[: max(n, 0)] == self.doc[WINDOW - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def spans(self) -> tuple[np.ndarray, ...]:
        """Anchor hash, two content hashes, document, first window and windows of each span."""
        if not len(self.starts):
            return tuple(np.zeros(0, np.int64) for _ in range(6))
        gram = rolled(self.ids, GRAM, ODD[1])
        n = len(self.ids) - WINDOW + 1
        least, at = gram[:n].copy(), np.zeros(n, np.int64)
        for j in range(1, WINDOW - GRAM + 1):
            other = gram[j : j + n]
            less = other < least
            at[less] = j
            np.minimum(least, other, out=least)
        anchor = (at + np.arange(n))[self.starts]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (self.starts[1:] != self.starts[:-1] + 1)
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(anchor)))
        place = (np.arange(len(anchor)) - np.repeat(begin, size)).astype(np.uint64)
        # A span's content is the sequence of its windows, and where its anchor lies in them.
        factor = np.uint64(2) * mixed(place + np.uint64(1)) + np.uint64(1)
        sums = (np.add.reduceat(rolled(ids, WINDOW, odd)[self.starts] * factor, begin) for ids, odd in ((self.ids, ODD[2]), (self.checks, ODD[0])))
        content, check = (mixed(x + size.astype(np.uint64)) for x in sums)
        start = self.starts[begin]
        doc = self.doc[start]
        return gram[anchor[begin]], content, check, doc, start - self.first[doc], size


class Seen:
    """First places that a task has sent for keys which came more than once; later places of such a key are duplicates at once.

    It only saves rows: places that it doesn't know of are compared after the shuffle.
    """

    def __init__(self) -> None:
        self.first: dict[tuple[int, ...], tuple[int, int]] = {}

    def duplicates(self, keys: tuple[np.ndarray, ...], doc: np.ndarray, start: np.ndarray) -> np.ndarray:
        order = np.lexsort((start, doc, *keys[::-1]))
        same = np.zeros(len(doc), bool)
        same[1:] = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in keys])
        dup = np.zeros(len(doc), bool)
        # A repeated document id and start is the same place, not an earlier one.
        heads = np.maximum.accumulate(np.where(same, 0, np.arange(len(doc))))
        lead = order[heads]
        dup[order] = same & ((doc[order] != doc[lead]) | (start[order] != start[lead]))
        often = np.zeros(len(doc), bool)
        often[lead[same]] = True
        known = self.first
        if known:
            at = np.flatnonzero(~dup)
            for i, *key in zip(at.tolist(), *(x[at].tolist() for x in keys), strict=True):
                got = known.get(tuple(key))
                if got and got < (int(doc[i]), int(start[i])):
                    dup[i] = True
        if len(known) > CACHE:
            known.clear()
        for i in np.flatnonzero(often & ~dup).tolist():
            known[tuple(int(x[i]) for x in keys)] = int(doc[i]), int(start[i])
        return dup


def chunks(rows: Iterator[tuple]) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Rows of (UTF-8 text, ...) with their words, some ``CHUNK_WORDS`` words at a time."""
    held, words, count = [], [], 0
    for row in rows:
        held.append(row)
        words.append((row[0] or b"").split())
        count += len(words[-1])
        if count >= CHUNK_WORDS:
            yield held, words
            held, words, count = [], [], 0
    if held:
        yield held, words


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def packed(docs: DataFrame) -> DataFrame:
    """``doc_id, packed``: each text as a zstd frame, to be shuffled; null stays null."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            frames = [None if text is None else zstd.compress(text) for text in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(frames, pa.binary())], names=["doc_id", "packed"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(pack, "doc_id long, packed binary")


def unpacked(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows of (frame, ...) with the text in its place."""
    zstd = zstandard.ZstdDecompressor()
    for frame, *rest in rows:
        yield b"" if frame is None else zstd.decompress(frame), *rest


def document_spans(docs: DataFrame) -> DataFrame:
    """Spans of ``text, doc_id`` rows.  Rows known to be duplicates have no hashes, and an anchor that spreads them out, as they meet nobody."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHash(), Seen()
        for rows, words in chunks(rows_of(batches)):
            ids = np.array([r[1] for r in rows], np.int64)
            h, r, v, doc, start, n = Words(words, hashes).spans()
            doc = ids[doc]
            dup = seen.duplicates((h, r, v), doc, start)
            h = np.where(dup, mixed(mixed(doc.astype(np.uint64)) + (start >> 8).astype(np.uint64)), h)
            r, v = np.where(dup, 0, r), np.where(dup, 0, v)
            columns = [*(x.astype(np.uint64).view(np.int64) for x in (h, r, v)), doc, start.astype(np.int32), n.astype(np.int32), dup]
            yield pa.record_batch([pa.array(c) for c in columns], names=["h", "r", "v", "doc_id", "start", "n", "dup"])

    return docs.select(F.col("text").cast("binary"), "doc_id").mapInArrow(spans, SPAN)


def span_windows(docs: DataFrame) -> DataFrame:
    """Windows of the spans listed in ``packed, doc_id, spans`` rows, with two hashes of their words."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHash(), Seen()
        for rows, words in chunks(unpacked(rows_of(batches))):
            state = Words(words, hashes)
            if not len(state.starts):
                continue
            wanted = np.zeros(len(state.ids) + 1, np.int32)
            for k, row in enumerate(rows):
                for s in row[2]:
                    if s["start"] + s["n"] + WINDOW - 1 <= len(words[k]):
                        wanted[state.first[k] + s["start"]] += 1
                        wanted[state.first[k] + s["start"] + s["n"]] -= 1
            at = state.starts[np.cumsum(wanted)[state.starts] > 0]
            w1, w2 = rolled(state.ids, WINDOW, ODD[0])[at], rolled(state.checks, WINDOW, ODD[1])[at]
            k = state.doc[at]
            doc, start = np.array([r[1] for r in rows], np.int64)[k], at - state.first[k]
            dup = seen.duplicates((w1, w2), doc, start)
            w1 = np.where(dup, mixed(w2 ^ mixed(doc.astype(np.uint64) + start.astype(np.uint64))), w1)
            columns = [w1.view(np.int64), w2.view(np.int64), doc, start.astype(np.int32), dup]
            yield pa.record_batch([pa.array(c) for c in columns], names=["w1", "w2", "doc_id", "start", "dup"])

    return docs.select("packed", "doc_id", "spans").mapInArrow(windows, WIN)


class FingerprintIndex:
    """Sorted immutable runs of first spans; each batch is merge-joined with them.

    Runs are bucketed tables in the session's warehouse (``name`` prefixes them), one sorted file per bucket, so
    a merge join of runs moves no rows.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, max_runs: int = 4, buckets: int | None = None):
        self.spark, self.max_runs = spark, max_runs
        self.name = name or f"fingerprints_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self.batches: list[str] = []
        self.made = 0

    def _write(self, rows: DataFrame, kind: str) -> str:
        self.made += 1
        name = f"{self.name}_{kind}{self.made}"
        rows.write.bucketBy(self.buckets, "h").sortBy("h", "r").format("parquet").saveAsTable(name)
        return name

    def contents(self) -> DataFrame | None:
        """First spans of all contents so far."""
        runs = [self.spark.table(t).where("first").select("h", "r", "v", "doc_id", "start", "n") for t in self.runs]
        out = runs[0] if runs else None
        for run in runs[1:]:
            out = out.unionByName(run)
        return out

    def add_batch(self, docs: DataFrame) -> None:
        """Take in documents (``doc_id, text``) whose ids are larger than all before."""
        order = Window.partitionBy("h", "r", "v").orderBy("dup", "doc_id", "start")
        spans = document_spans(docs).repartition(self.buckets, "h")
        first = F.min(F.when(~F.col("dup"), F.struct("doc_id", "start"))).over(order)
        spans = spans.withColumn("first", ~F.col("dup") & (first["doc_id"] == F.col("doc_id")) & (first["start"] == F.col("start")))
        # The keys below are (anchor, contents) while runs are bucketed by anchor alone: co-located all the same.
        key = "spark.sql.requireAllClusterKeysForCoPartition"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, "false")
        try:
            for run in self.runs:
                old = self.spark.table(run).where("first").select(F.col("h").alias("oh"), F.col("r").alias("orr"), F.col("v").alias("ov"), F.lit(True).alias("old")).distinct()
                spans = spans.join(old, (F.col("h") == F.col("oh")) & (F.col("r") == F.col("orr")) & (F.col("v") == F.col("ov")), "left")
                spans = spans.withColumn("first", F.col("first") & F.col("old").isNull()).drop("oh", "orr", "ov", "old")
            name = self._write(spans.drop("dup"), "run")
        finally:
            self.spark.conf.set(key, before)
        self.runs.append(name)
        self.batches.append(name)
        if len(self.runs) > self.max_runs:
            self.compact()

    def compact(self) -> None:
        """Merge all runs into one; the old tables stay for the batches they describe."""
        merged = self.contents().withColumn("first", F.lit(True))
        self.runs = [self._write(merged.repartition(self.buckets, "h"), "merged")]

    def removed_spans(self) -> DataFrame:
        """Spans whose content came earlier, of all batches: ``doc_id, start, n``."""
        parts = [self.spark.table(t).where("not first").select("doc_id", "start", "n") for t in self.batches]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def open_spans(self) -> DataFrame:
        """Spans that share an anchor with a span of other content, as ``doc_id, spans``.

        Each run is looked at alone and merge-joined with each other run, so no run is moved.  (An anchor that two runs
        have stands for different contents, since a later run leaves out what an earlier one has.)
        """
        parts = []
        for name in self.runs:
            run = self.spark.table(name).where("first").select("h", "doc_id", "start", "n")
            ends = [f(c).alias(f"_{c}{k}") for c in "rv" for k, f in enumerate((F.min, F.max))]
            own = self.spark.table(name).where("first").groupBy("h").agg(*ends).where("_r0 <> _r1 or _v0 <> _v1").select(F.col("h").alias("_h"))
            others = [own] + [self.spark.table(t).where("first").select(F.col("h").alias("_h")) for t in self.runs if t != name]
            parts += [run.join(other, F.col("h") == F.col("_h"), "left_semi").select("doc_id", "start", "n") for other in others]
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        return found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def removed_windows(docs: DataFrame, index: FingerprintIndex) -> DataFrame:
    """All windows that also start earlier, as ``doc_id, start, n`` spans.

    Spans are equal by the hash of their anchor and two of their content, opened windows by two hashes of their words.
    """
    opened = index.open_spans().select(F.col("doc_id").alias("_doc"), "spans")
    windows = span_windows(packed(docs).join(opened, F.col("doc_id") == F.col("_doc")).select("packed", "doc_id", "spans"))
    first = F.min(F.when(~F.col("dup"), F.struct("doc_id", "start"))).over(Window.partitionBy("w1", "w2").orderBy("dup", "doc_id", "start"))
    later = F.col("dup") | (first["doc_id"] != F.col("doc_id")) | (first["start"] != F.col("start"))
    again = windows.withColumn("later", later).where("later").select("doc_id", "start", F.lit(1).alias("n"))
    return index.removed_spans().unionByName(again)


def without_removed(docs: DataFrame, removed: DataFrame, with_text: bool = False) -> DataFrame:
    """Words left in each document: ``doc_id, n_words, n_removed, kept_sha256`` (and ``kept_text``)."""
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.string()] * with_text

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, doc, spans in unpacked(rows_of([batch])):
                words = text.split()
                kept = words
                if spans:
                    cover = np.zeros(len(words) + 1, np.int32)
                    at = np.array([(s["start"], s["start"] + s["n"] + WINDOW - 1) for s in spans if s["start"] + s["n"] + WINDOW - 1 <= len(words)], np.int64).reshape(-1, 2)
                    np.add.at(cover, at[:, 0], 1)
                    np.add.at(cover, at[:, 1], -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(cover)[:-1] == 0).tolist()]
                joined = b" ".join(kept)
                out.append((doc, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), *[joined.decode("utf-8", "replace")] * with_text))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * len(names), types, strict=True)], names=names)

    spans = removed.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("spans")).select(F.col("doc_id").alias("_doc"), "spans")
    joined = packed(docs).join(spans, F.col("doc_id") == F.col("_doc"), "left").select("packed", "doc_id", "spans")
    return joined.mapInArrow(strip, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else ""))


def remove_repeated_substrings(docs: DataFrame, batches: int = 2, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Remove each word covered by a window that also starts earlier (smaller id, or same document and earlier).

    Result: ``doc_id, n_words, n_removed, kept_sha256`` (and ``kept_text``), one row per input row.  The documents
    pass through the index in ``batches`` ranges of ids; the result is the same for any number.  Null and empty texts have no
    words; texts under a window lose nothing.  A row without id has no place in the order: it loses nothing and takes
    nothing from others.  Rows that repeat an id with the same text count as one place and lose the same words.  An
    empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    index = FingerprintIndex(spark)
    bounds = slim.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    cuts = []
    if bounds["lo"] is not None:
        step = (bounds["hi"] - bounds["lo"]) // batches + 1
        cuts = [bounds["lo"] + k * step for k in range(batches)]
    for low in cuts:
        index.add_batch(slim.where((F.col("doc_id") >= low) & (F.col("doc_id") < low + step)))
    if not cuts:
        index.add_batch(slim.where("doc_id is not null"))
    return without_removed(slim, removed_windows(slim, index), with_text)
