"""Alignment of two tokenizers by divide and conquer at shared cuts (operator 12).

Two token streams over the same bytes are one interval.  An end that both share is looked for near its middle by bisection,
and the halves are treated alike; an interval without a shared end inside is a group.  All intervals of a level go
together, as arrays.

Texts are aligned by words.  Both tokenizers cut before a blank that follows something else than a blank and precedes no
white space (the byte-level one by its pattern, the other as no piece has a blank behind other characters), so distinct words of a
slice of texts are encoded and aligned once, and each text takes the groups of its words.  Texts where blanks stand otherwise are
cut at such places only.

Texts are encoded once.  What each has of counts, and its distinct linked id pairs, is stored; the documents of a pair are counted
from there, and summed over each document's links.  For that the ``hot`` most frequent pairs go to the tasks as a table of
bounded size; links of other pairs come out as rows and are joined with their counts.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import stored

#: Bytes of text that are aligned together; a longer text is a slice of its own.
SLICE = 2 << 20
#: Characters that are encoded in one call.
CHUNK = 1 << 15
#: Distances from the middle that are tried for all intervals of a level at once.
TOGETHER = 8
#: Pairs whose counts every task gets (17 bytes each).
HOT = 1 << 19
#: Links of one group that are listed one by one; larger groups are counted by distinct ids.
LISTED = 4096

COUNTED = ("_row", "_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")

# White space, as either tokenizer or Python sees it, and the mark that stands for a blank in pieces.
WHITE = "\t-\r\x1c-\x20\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK = "\u2581"
ODD = f"^[{WHITE}]| (?:[{WHITE}]|$)"
CUT = re.compile(f"(?<=[^ {BLANK}]) (?=[^{WHITE}])")


class Tokenizers:
    """Ids and byte lengths of texts by both tokenizers."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        shown = {c: b for b, c in _byte_letters().items()}
        self.a_bytes = [bytes(shown[c] for c in self.a.id_to_token(i)) if all(c in shown for c in self.a.id_to_token(i)) else self.a.id_to_token(i).encode() for i in range(self.a.get_vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.a_length = np.fromiter(map(len, self.a_bytes), np.int64)
        self.b_length = np.fromiter(map(len, self.b_bytes), np.int64)

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks end to end, by either tokenizer."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False)]
        return tuple(np.concatenate([np.zeros(0, np.int64), *map(np.array, x)]).astype(np.int64) for x in (a, self.b.encode(chunks, num_threads=1)))

    def restored(self, a: np.ndarray, b: np.ndarray) -> tuple[bytes, bytes]:
        return b"".join(map(self.a_bytes.__getitem__, a.tolist())), b"".join(map(self.b_bytes.__getitem__, b.tolist()))


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: bytes that print as themselves, the others in order from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def tokenizers(byte_level: str, pieces: str) -> Tokenizers:
    return Tokenizers(byte_level, pieces)


def shared_groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds behind each group's last token in two streams of ascending byte ends; both end at the same byte."""
    if not len(a_ends):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    open_ = np.array([[0, len(a_ends), 0, len(b_ends)]], np.int64)
    leaves = []
    while len(open_):
        lo, hi, _, b_hi = open_.T
        inner = hi - lo - 1
        middle = lo + inner // 2
        found = np.full(len(open_), -1)
        left = np.flatnonzero((inner > 0) & (b_hi - open_[:, 2] > 1))
        for d in range(TOGETHER):
            if not len(left):
                break
            at = middle[left] + (d + 1) // 2 * (1 if d % 2 else -1)
            inside = (at >= lo[left]) & (at < hi[left] - 1)
            ends = a_ends[np.where(inside, at, 0)]
            hit = inside & (b_ends[np.minimum(np.searchsorted(b_ends, ends), len(b_ends) - 1)] == ends)
            found[left[hit]] = at[hit]
            left = left[~hit]
        for k in left[inner[left] >= TOGETHER]:
            found[k] = _near_middle(a_ends, b_ends, int(lo[k]), int(hi[k]), int(middle[k]))
        cut = found >= 0
        leaves.append(open_[~cut][:, [1, 3]])
        whole, at = open_[cut], found[cut] + 1
        b_at = np.searchsorted(b_ends, a_ends[at - 1]) + 1
        # In order, so that bisections of a level go through the ends in order too.
        open_ = np.column_stack([whole[:, 0], at, whole[:, 2], b_at, at, whole[:, 1], b_at, whole[:, 3]]).reshape(-1, 4)
    bounds = np.concatenate(leaves)
    return np.sort(bounds[:, 0]), np.sort(bounds[:, 1])


def _near_middle(a_ends: np.ndarray, b_ends: np.ndarray, lo: int, hi: int, middle: int) -> int:
    """Index of the shared end nearest to the middle of one long interval, or -1."""
    own = a_ends[lo : hi - 1]
    at = np.searchsorted(b_ends, own)
    hits = lo + np.flatnonzero(b_ends[np.minimum(at, len(b_ends) - 1)] == own)
    return int(hits[np.argmin(np.abs(hits - middle))]) if len(hits) else -1


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0] + 1, ...`` (sizes[0] of them), then those of the next."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Aligned:
    """Words of a slice and the texts made of them.  ``codes[bounds[i]:bounds[i + 1]]`` are text i's words."""

    codes: np.ndarray
    bounds: np.ndarray
    stats: np.ndarray  # per word: tokens of A, of B, groups, links
    pairs: np.ndarray  # linked id pairs, word by word: A's id, then 16 bits of B's
    times: np.ndarray  # how often the word has the pair's link
    pair_bounds: np.ndarray
    groups: pa.StringArray | None  # per word


def align(texts: pa.StringArray, tok: Tokenizers, with_groups: bool, joined: bool = True) -> Aligned:
    """Align texts word by word; texts that are null, empty or not given back by both tokenizers have no words.

    ``joined`` encodes words side by side, which is faster.
    """
    given = pc.fill_null(texts, "")
    given = pc.if_else(pc.match_substring(given, BLANK), "", given)  # the mark itself comes back as a blank
    odd = np.flatnonzero(pc.match_substring_regex(given, ODD).to_numpy(zero_copy_only=False))
    lists = pc.split_pattern(given, " ")
    if len(odd):
        listed = lists.to_pylist()
        for i in odd.tolist():
            text = " " + given[i].as_py()
            cuts = [0, *(m.start() for m in CUT.finditer(text)), len(text)]
            listed[i] = [text[p + 1 : q] for p, q in zip(cuts[:-1], cuts[1:], strict=True)]
        lists = pa.array(listed, pa.list_(pa.string()))
    cut = pc.list_value_length(lists).to_numpy()
    sizes = np.where(pc.equal(given, "").to_numpy(zero_copy_only=False), 0, cut)
    coded = lists.flatten().filter(pa.array(np.repeat(sizes > 0, cut))).dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])

    words = coded.dictionary
    # Words that begin with white space or end in a blank are encoded alone.
    alone = pc.match_substring_regex(words, f"^[{WHITE}]| $").to_numpy(zero_copy_only=False) | (not joined)
    order = np.concatenate([np.flatnonzero(~alone), np.flatnonzero(alone)])
    taken = words.take(pa.array(order)).to_numpy(zero_copy_only=False).tolist()
    n = len(order) - int(alone.sum())
    part = np.cumsum(np.fromiter(map(len, taken[:n]), np.int64, n) + 1) // CHUNK
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), *([n] if n else [])]
    chunks = [" ".join(taken[p:q]) for p, q in zip(cuts[:-1], cuts[1:], strict=True)] + taken[n:]
    a, b = tok.encode(chunks)
    length = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)[order] + 1
    back = tok.restored(a, b)
    if any(x != " ".join(["", *taken]).encode() for x in back):
        # Find out which words are not given back, and leave out the texts that hold them.
        good = np.ones(len(words), bool)
        for k, word in zip(order.tolist(), taken, strict=True):
            good[k] = all(x == (" " + word).encode() for x in tok.restored(*tok.encode([word])))
        bad = document_sums(~good[:, None], codes, bounds)[:, 0] > 0
        rest = [None if x else t for t, x in zip(texts.to_pylist(), bad.tolist(), strict=True)]
        return align(pa.array(rest, pa.string()), tok, with_groups, joined=False)

    a_group, b_group = shared_groups(np.cumsum(tok.a_length[a]), np.cumsum(tok.b_length[b]))
    ends = np.cumsum(length)
    a_word, b_word = (np.searchsorted(np.cumsum(x), ends) + 1 for x in (tok.a_length[a], tok.b_length[b]))
    g_word = np.searchsorted(a_group, a_word) + 1
    n_a, n_b = np.diff(a_group, prepend=0), np.diff(b_group, prepend=0)
    links = n_a * n_b
    per_word = lambda upto: np.diff(upto, prepend=0)
    stats = np.column_stack([per_word(a_word), per_word(b_word), per_word(g_word), per_word(np.concatenate([[0], np.cumsum(links)])[g_word])])
    pairs, times, pair_word = _linked(a, b, a_group - n_a, b_group - n_b, n_a, n_b, np.repeat(np.arange(len(order)), per_word(g_word)))
    # Back to the order of the dictionary.
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    pair_bounds = np.searchsorted(pair_word, np.arange(len(order) + 1))
    shown = _shown(a, b, a_group, b_group, g_word) if with_groups else None
    return Aligned(rank[codes], bounds, stats, pairs, times, pair_bounds, shown)


def _linked(a, b, a_start, b_start, n_a, n_b, word) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of all groups in order of their words: id pair, times, word."""
    few = n_a * n_b <= LISTED
    size = (n_a * n_b)[few]
    within = spread(np.zeros(len(size), np.int64), size)
    wide = np.repeat(n_b[few], size)
    pairs = [a[np.repeat(a_start[few], size) + within // np.maximum(wide, 1)] << 16 | b[np.repeat(b_start[few], size) + within % np.maximum(wide, 1)]]
    times, words = [np.ones(len(pairs[0]), np.int64)], [np.repeat(word[few], size)]
    for g in np.flatnonzero(~few):
        ids, counts = zip(*(np.unique(x[s : s + k], return_counts=True) for x, s, k in ((a, a_start[g], n_a[g]), (b, b_start[g], n_b[g]))), strict=True)
        pairs.append((ids[0][:, None] << 16 | ids[1]).ravel())
        times.append((counts[0][:, None] * counts[1]).ravel())
        words.append(np.full(len(pairs[-1]), word[g]))
    at = np.argsort(np.concatenate(words), kind="stable")
    return np.concatenate(pairs)[at], np.concatenate(times)[at], np.concatenate(words)[at]


def _shown(a, b, a_group, b_group, g_word) -> pa.StringArray:
    """``a1,a2|b1;a3|b2,b3`` for each word."""
    side = lambda ids, upto: pc.binary_join(pa.LargeListArray.from_arrays(np.concatenate([[0], upto]), pa.array(ids).cast(pa.string())), ",")
    both = pc.binary_join_element_wise(side(a, a_group), side(b, b_group), "|")
    return pc.binary_join(pa.LargeListArray.from_arrays(np.concatenate([[0], g_word]), both), ";")


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE)) + 1).tolist(), batch.num_rows]
    for p, q in zip(cuts[:-1], cuts[1:], strict=True):
        if q > p:
            yield batch.slice(p, q - p)


def document_sums(per_word: np.ndarray, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    upto = np.concatenate([np.zeros((1, per_word.shape[1]), np.int64), np.cumsum(per_word[codes], axis=0)])
    return upto[bounds[1:]] - upto[bounds[:-1]]


def document_pairs(x: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, pair and times of links, one row for each distinct pair of a document; by document and pair."""
    document = np.repeat(np.arange(len(x.bounds) - 1), np.diff(x.bounds))
    word, often = np.unique(document * max(1, len(x.stats)) + x.codes, return_counts=True)
    document, code = np.divmod(word, max(1, len(x.stats)))
    size = np.diff(x.pair_bounds)[code]
    at = spread(x.pair_bounds[:-1][code], size)
    known, local = np.unique(x.pairs, return_inverse=True)
    key, back = np.unique(np.repeat(document, size) * max(1, len(known)) + local[at], return_inverse=True)
    times = np.bincount(back, np.repeat(often, size) * x.times[at], len(key)).astype(np.int64)
    document, local = np.divmod(key, max(1, len(known)))
    return document, known[local], times


def token_groups(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The groups themselves: ``id_col, groups`` (array of ``a`` and ``b``, ids in order), one row per input row."""

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers(byte_level, pieces)
        for batch in batches:
            for part in slices(batch, 1):
                x = align(part.column(1), tok, True)
                words = pa.LargeListArray.from_arrays(x.bounds, x.groups.take(pa.array(x.codes)))
                yield pa.record_batch([part.column(0), pc.binary_join(words, ";").cast(pa.string())], names=["_id", "_groups"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(grouped, f"_id {kind}, _groups string")
    ids = lambda g, i: F.split(F.split_part(g, F.lit("|"), F.lit(i)), ",").cast("array<int>")
    each = F.transform(F.filter(F.split("_groups", ";"), lambda g: g != ""), lambda g: F.struct(ids(g, 1).alias("a"), ids(g, 2).alias("b")))
    return found.select(F.col("_id").alias(id_col), each.alias("groups"))


def aligned_documents(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_row, _id, n_a, n_b, n_groups, n_links, groups_sha256, _pairs, _times`` of every text; the last two are its distinct linked pairs and their links."""

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers(byte_level, pieces)
        for batch in batches:
            for part in slices(batch, 2):
                x = align(part.column(2), tok, True)
                text = pc.binary_join(pa.LargeListArray.from_arrays(x.bounds, x.groups.take(pa.array(x.codes))), ";")
                digest = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in text.to_numpy(zero_copy_only=False).tolist()]
                document, pairs, times = document_pairs(x)
                upto = pa.array(np.searchsorted(document, np.arange(part.num_rows + 1)).astype(np.int32))
                lists = (pa.ListArray.from_arrays(upto, pa.array(v)) for v in (pairs, times))
                yield pa.record_batch([part.column(0), part.column(1), *map(pa.array, document_sums(x.stats, x.codes, x.bounds).T), pa.array(digest, pa.string()), *lists], names=[*COUNTED, "_pairs", "_times"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(aligned, f"_row long, _id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, _pairs array<long>, _times array<long>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, a, b, n_docs, best`` of all linked id pairs: the documents that hold it linked, and whether no pair of ``a`` has more."""
    counts = stored(aligned.select(F.explode("_pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs")))
    counts = counts.select("pair", F.shiftright("pair", 16).cast("int").alias("a"), F.col("pair").bitwiseAND(65535).cast("int").alias("b"), "n_docs")
    return counts.join(counts.groupBy("a").agg(F.max("n_docs").alias("_most")), "a").select("pair", "a", "b", "n_docs", (F.col("n_docs") == F.col("_most")).alias("best"))


def align_tokenizers(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Align every whole text: ``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, one row per input row.

    ``byte_level`` encodes blank and text, ``pieces`` the text (it adds the blank itself), both without special tokens.  Byte
    offsets where tokens of both end cut the tokens into groups; a link is a pair of occurrences, one of either side, in one
    group.  ``n_best`` are links whose id pair is linked in as many documents as any pair of its A id, ``count_sum`` sums the
    documents of the pairs over the links, ``groups_sha256`` digests the groups as ``a1,a2|b1;a3|b2,b3``.

    Texts that are null or empty, or that either tokenizer does not give back byte for byte, have zeros and an empty digest.
    Null and repeated ids are aligned like others, repeated rows count as documents of their own, texts may have any length, an
    empty table gives an empty result, other columns are not read.
    """
    facts = stored(aligned_documents(docs, byte_level, pieces, id_col, text_col))
    counts = stored(pair_counts(facts))
    # At most ``hot`` rows of 17 bytes, whatever the corpus; one more tells whether there are others.
    top = counts.orderBy(F.desc("n_docs"), "pair").limit(hot + 1).select("pair", "n_docs", "best").toArrow()
    others = top.num_rows > hot
    top = top.slice(0, hot)
    order = np.argsort(top["pair"].to_numpy())
    sent = docs.sparkSession.sparkContext.broadcast([top[c].to_numpy()[order] for c in ("pair", "n_docs", "best")])
    names = [*COUNTED, "n_best", "count_sum", "_pair", "_times"]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n_docs, best = sent.value
        for batch in batches:
            n = batch.num_rows
            lists = batch.column(len(COUNTED))
            linked, times = (batch.column(len(COUNTED) + i).flatten().to_numpy() for i in (0, 1))
            at = np.minimum(np.searchsorted(pair, linked), max(0, len(pair) - 1))
            known = pair[at] == linked if len(pair) else np.zeros(len(linked), bool)
            value = np.column_stack([np.where(known, v[at], 0) * times for v in (best, n_docs)]) if len(pair) else np.zeros((len(linked), 2), np.int64)
            ends = np.cumsum(pc.list_value_length(lists).to_numpy())
            upto = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(value, axis=0)])
            sums = upto[ends] - upto[np.concatenate([[0], ends[:-1]])]
            yield pa.record_batch([*batch.columns[: len(COUNTED)], *map(pa.array, sums.T), *[pa.nulls(n, pa.int64())] * 2], names=names)
            if not known.all():
                cold = np.flatnonzero(~known)
                rows = batch.column(0).take(pa.array(np.searchsorted(ends, cold, side="right")))
                blank = [pa.nulls(len(cold), c.type) for c in batch.columns[1 : len(COUNTED)]]
                yield pa.record_batch([rows, *blank, *[pa.nulls(len(cold), pa.int64())] * 2, pa.array(linked[cold]), pa.array(times[cold])], names=names)

    kinds = dict(facts.dtypes)
    out = facts.mapInArrow(summed, ", ".join([*[f"{c} {kinds[c]}" for c in COUNTED], *[f"{c} long" for c in names[len(COUNTED) :]]]))
    columns = [F.col("_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if not others:
        return out.select(*columns)
    out = stored(out)
    rest = out.where("_pair is not null").select("_row", "_pair", "_times").join(counts.withColumnRenamed("pair", "_pair").hint("merge"), "_pair")
    rest = rest.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("_times")).otherwise(0)).alias("_best"), F.sum(F.col("_times") * F.col("n_docs")).alias("_sum"))
    met = out.where("_pair is null").join(rest.hint("merge"), "_row", "left")
    return met.withColumns({"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))}).select(*columns)
