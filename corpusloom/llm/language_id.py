"""Language identification by prediction by partial matching (operator 10).

Per language a variable-order context tree over bytes: a symbol seen after a context of ``o`` bytes costs
``-log2(c / (t + d))`` bits (count, total and distinct symbols of the context); one not seen costs the escape
``-log2(d / (t + d))`` and is coded after ``o - 1`` bytes; below order 0 all bytes are equal.  The statistics are
frozen after training, so a language's code length of a text is a sum of table entries.  All languages share one
table of contexts, whose entries are the costs in each of them with the escapes already added.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER = 3
#: Bytes that are scored together.
BLOCK = 1 << 19
COUNTS = "lang string, order int, code long, n long"


def codes(data: np.ndarray, order: int) -> np.ndarray:
    """Code of each byte with the ``order`` bytes before it, from byte ``ORDER`` on."""
    out = np.zeros(len(data) - ORDER, np.uint64)
    for j in range(order, -1, -1):
        out = (out << np.uint64(8)) | data[ORDER - j : len(data) - j].astype(np.uint64)
    return out


def context_counts(docs: DataFrame) -> DataFrame:
    """Counts of (context, symbol) of every order, per language, of ``lang, text`` rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                texts.setdefault(lang, []).append(bytes(ORDER) + (text or "").encode("utf-8", "replace"))
            for lang, parts in texts.items():
                data = np.frombuffer(b"".join(parts), np.uint8)
                # Padding is context only: its own bytes are not counted.
                sizes = np.array([len(p) for p in parts])
                begin = np.cumsum(sizes) - sizes
                real = np.ones(len(data), bool)
                for j in range(ORDER):
                    real[begin + j] = False
                for order in range(ORDER + 1):
                    found, n = np.unique(codes(data, order)[real[ORDER:]], return_counts=True)
                    if len(found):
                        yield pa.record_batch([pa.array([lang] * len(found)), pa.array([order] * len(found), pa.int32()), pa.array(found.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "order", "code", "n"])

    rows = docs.select("lang", "text").mapInArrow(count, COUNTS)
    return rows.groupBy("lang", "order", "code").agg(F.sum("n").alias("n"))


class HashTable:
    """Open-addressing table of 64-bit keys with vectorised look-ups."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(4 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.mask = np.int64(size - 1)
        self.keys, self.rows = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.rows[at] < 0
            slot, first = np.unique(at[free], return_index=True)
            won = left[free][first]
            self.keys[slot], self.rows[slot] = keys[won], won
            stay = self.rows[at] != left
            left, at = left[stay], (at[stay] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        at = self._home(keys)
        out = self.rows[at]
        wrong = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.mask
            out[wrong] = self.rows[at[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.keys[at[wrong]] != keys[wrong])]
        return out


@dataclass
class Level:
    """Entries of one order: costs of (context, symbol), and of the escape from each context, by language.

    Contexts have a table of their own: those that reach over the start of a text are no (context, symbol) of a lower order.
    """

    table: HashTable
    cost: np.ndarray
    contexts: HashTable
    escape: np.ndarray


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    levels: list[Level] = field(default_factory=list)

    @classmethod
    def build(cls, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Model:
        """``counts``: for each order the languages' numbers, codes and counts."""
        model, n_langs = cls(langs), len(langs)
        for order, (lang, code, n) in enumerate(counts):
            keys, at = np.unique(code, return_inverse=True)
            matrix = np.zeros((len(keys), n_langs))
            matrix[at, lang] = n
            context, within = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(context), n_langs)), np.zeros((len(context), n_langs))
            np.add.at(total, within, matrix)
            np.add.at(kinds, within, matrix > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                own = -np.log2(matrix / (total + kinds)[within])
            if order:
                # What was seen after a context was seen after each shorter one, so none of these is missing.
                below = model.levels[-1]
                lower = below.cost[below.table.find(keys & np.uint64((1 << (8 * order)) - 1))].astype(np.float64)
            else:
                lower = np.full(n_langs, 8.0)
            cost = np.where(matrix > 0, own, escape[within] + lower)
            model.levels.append(Level(HashTable(keys), cost.astype(np.float32), HashTable(context), escape.astype(np.float32)))
        return model

    def costs(self, data: np.ndarray) -> np.ndarray:
        """Bits of each byte from ``ORDER`` on, by language."""
        code = codes(data, ORDER)
        out = np.zeros((len(code), len(self.langs)), np.float32)
        rest = np.arange(len(code))
        for order in range(ORDER, -1, -1):
            level = self.levels[order]
            row = level.table.find(code)
            hit = row >= 0
            out[rest[hit]] += level.cost[row[hit]]
            rest, code = rest[~hit], code[~hit]
            if not len(rest):
                return out
            context = level.contexts.find(code >> np.uint64(8))
            known = context >= 0
            out[rest[known]] += level.escape[context[known]]
            if order:
                code &= np.uint64((1 << (8 * order)) - 1)
        out[rest] += 8.0
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each whole text in each language."""
        total = np.zeros((len(texts), len(self.langs)))
        segments: list[bytes] = []
        owners: list[int] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if segments:
                data = np.frombuffer(b"".join(segments), np.uint8)
                sizes = np.array([len(s) for s in segments])
                begin = np.cumsum(sizes) - sizes
                cost = np.zeros((len(data), len(self.langs)), np.float32)
                cost[ORDER:] = self.costs(data)
                for j in range(ORDER):
                    cost[begin + j] = 0
                np.add.at(total, owners, np.add.reduceat(cost, begin, axis=0, dtype=np.float64))
            segments.clear()
            owners.clear()
            held = 0

        for k, text in enumerate(texts):
            padded = bytes(ORDER) + text
            for at in range(0, len(text), BLOCK):
                segments.append(padded[at : at + BLOCK + ORDER])
                owners.append(k)
                held += len(segments[-1])
                if held >= BLOCK:
                    flush()
        flush()
        return total


def in_fold(id_col: str, folds: int) -> F.Column:
    """Whether a row is held out: crc32 of the id as text, mod ``folds``, is 0; a null id never is."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, train_docs: int = 1000, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit the context trees on a sample of the labelled rows outside the held-out fold.

    The sample is bounded: about ``train_docs`` whole texts of each language, drawn by a hash of the id (all, where a
    language has fewer).  The driver sees the counts of this sample only.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & ~in_fold(id_col, folds))
    sizes = {r["l"]: r["n"] for r in labelled.groupBy(F.col(lang_col).alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model()
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, train_docs / n))])
    drawn = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("train")), F.lit(1 << 30)) / F.lit(float(1 << 30)) < share[F.col(lang_col)]
    counts = context_counts(labelled.where(drawn).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))).toArrow()
    if not counts.num_rows:
        return Model()
    langs = sorted(set(counts.column("lang").unique().to_pylist()))
    number = {x: i for i, x in enumerate(langs)}
    lang = np.array([number[x] for x in counts.column("lang").to_pylist()])
    order, code, n = (counts.column(x).to_numpy() for x in ("order", "code", "n"))
    return Model.build(langs, [(lang[order == o], code[order == o].view(np.uint64), n[order == o]) for o in range(ORDER + 1)])


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``lang_pred, score, bits, bytes`` for ``text_col``: see ``identify_language``; ``bits`` is the code length in that language.

    ``text_col`` itself is left out; for ``und``, ``bits`` is null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training sample
    keep = [c for c in docs.columns if c != text_col]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], text_col)
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType()), T.StructField("bytes", T.LongType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            langs, scores, lengths = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
            sizes = pc.binary_length(batch.column(batch.num_columns - 1).cast(pa.binary())).cast(pa.int64())
            worth = [k for k, t in enumerate(texts) if has_letter(t)] if model.langs else []
            if worth:
                bits = model.bits([texts[k].encode("utf-8", "replace") for k in worth])
                best = bits.argmin(axis=1)
                sure = 1 / np.exp2(-(bits - bits.min(axis=1, keepdims=True))).sum(axis=1)
                for k, b, s, n in zip(worth, best.tolist(), sure.tolist(), bits.min(axis=1).tolist(), strict=True):
                    langs[k], scores[k], lengths[k] = model.langs[b], s, n
            columns = [*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(lengths, pa.float64()), sizes]
            yield pa.record_batch(columns, names=[*keep, "lang_pred", "score", "bits", "bytes"])

    return rows.mapInArrow(score, schema)


def identify_language(docs: DataFrame, train_docs: int = 1000, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Language of every whole text: ``doc_id, held_out, lang_pred, score, bits, bytes``.

    The model learns from text and ``lang_col`` of rows outside the held-out fold; ``score`` is the posterior of the best
    language under equal priors.  Null texts, and texts without a letter, are ``und`` with score 0, as is
    everything when no row has a language.  Ties go to the first language by code point.  Repeated rows are scored alike; null
    ids are not held out; an empty table gives an empty result; other columns are not read.
    """
    model = train(docs, train_docs, folds, id_col, text_col, lang_col)
    slim = docs.select(F.col(id_col).alias("doc_id"), in_fold(id_col, folds).alias("held_out"), F.col(text_col).alias("_body"))
    return predict(slim, model, "_body")


#: Bits that a text may take beyond its plain bytes before no language is taken to have it; one or two odd letters do no harm.
SLACK_BITS = 64.0


def keep_identified(
    docs: DataFrame, train_docs: int = 1000, folds: int = 5, slack_bits: float = SLACK_BITS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Rows of ``docs``, with all their columns, that are in one of the learned languages.

    A text without a letter (or null) goes.  So does one that no language's model codes in ``8 * bytes + slack_bits`` bits:
    plain bytes would describe it better than any language does, as with a script that no labelled row has.  If no row has a language
    to learn from, the model knows none and everything is kept that has a letter.  Repeated rows are judged alike; an empty
    table gives an empty result; extra columns may have any name.
    """
    model = train(docs, train_docs, folds, id_col, text_col, lang_col)
    if not model.langs:
        return docs.where(F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    # The row travels as one column, so its names cannot clash.
    columns = docs.columns
    tagged = predict(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(text_col).alias("body")), model, "body")
    return tagged.where((F.col("lang_pred") != "und") & (F.col("bits") <= 8.0 * F.col("bytes") + slack_bits)).select(*[F.col(f"row.`{c}`").alias(c) for c in columns])
