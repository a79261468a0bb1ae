"""Token ids of whole texts by a public tokenizer, shared by token counts and packing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct words remembered by a Python worker in each of two generations; results never depend on it.
CACHE_WORDS = 300_000
#: Longer words are encoded each time.
CACHE_CHARS = 48
#: Bytes of text that are encoded together.
SLICE = 4 << 20
#: ASCII marks and digits; not the apostrophe, which might start a contraction.
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalpha() and c != "'")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def _load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def strings(array: pa.Array) -> list[str]:
    """Much faster than ``to_pylist``."""
    return array.to_numpy(zero_copy_only=False).tolist()


class Remembered(dict):
    """Ids of a piece of text as little-endian unsigned 32-bit bytes, found once."""

    def __init__(self, find: Callable[[str], bytes]):
        super().__init__()
        self.find = find
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = self.find(piece)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found


class WordEncoder:
    """Ids of whole texts, word by word.

    For tokenizers that drop white space and never merge across it, such as ``word_bpe_49k.json``, the ids of a text are
    those of its words in order.  Likewise, a word's leading run of letters and the marks behind it are split before
    any merge, so both are looked up alone, if the run still ends in a letter when it is normalised.
    """

    def __init__(self, path: str):
        self.tokenizer = _load(path)
        self.letters = Remembered(self._letters)
        self.words = Remembered(self._word)
        self.whole = Remembered(self._stays_whole)

    def _letters(self, run: str) -> bytes:
        if run.isascii():
            return np.array([t.id for t in self.tokenizer.model.tokenize(run)], "<u4").tobytes()
        return self._pieces(run)

    def _stays_whole(self, run: str) -> bytes:
        """``b"1"`` if the tokenizer splits a mark behind the run from it; lower-casing U+0130, for one, leaves a mark of its own."""
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(run + "."))
        return b"1" if pieces[-1][0] == "." else b""

    def _pieces(self, text: str) -> bytes:
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))
        return np.array([t.id for p, _ in pieces for t in self.tokenizer.model.tokenize(p)], "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if "<|" in word:  # may hold a special token's string
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        return self._pieces(word) if word else b""

    def _split(self, words: pa.StringArray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Pieces, and the two pieces of each word: its letters and its marks, or the whole word and nothing."""
        run = pc.utf8_rtrim(words, characters=MARKS)
        plain = pc.utf8_is_alpha(run)
        odd = np.flatnonzero(pc.and_(plain, pc.invert(pc.string_is_ascii(run))).to_numpy(zero_copy_only=False))
        if len(odd):
            is_plain = plain.to_numpy(zero_copy_only=False).copy()
            is_plain[odd] = [bool(self.whole[w]) for w in strings(run.take(pa.array(odd)))]
            plain = pa.array(is_plain)
        runs = pc.ascii_lower(run.filter(plain)).dictionary_encode()
        is_plain = plain.to_numpy(zero_copy_only=False)
        cut = np.where(is_plain, pc.utf8_length(run).to_numpy(), 0).tolist()
        # For a word that is not plain this is all of it.
        tails = [w[k:] for w, k in zip(strings(words), cut, strict=True)]
        others = pa.array(tails, pa.string()).dictionary_encode()
        pieces = [b"", *map(self.letters.__getitem__, strings(runs.dictionary)), *map(self.words.__getitem__, strings(others.dictionary))]
        first = np.zeros(len(words), np.int64)
        first[is_plain] = 1 + runs.indices.to_numpy()
        return pieces, first, 1 + len(runs.dictionary) + others.indices.to_numpy()

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the bounds of each text in them (null: none)."""
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = split.flatten().dictionary_encode()
        # Pieces are looked up once for each distinct one, and their ids then dealt out to all places.
        found, first, second = self._split(coded.dictionary)
        table = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        at = np.cumsum(size) - size
        word = coded.indices.to_numpy()
        piece = np.column_stack([first[word], second[word]]).ravel()
        sizes = size[piece]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = table[np.repeat(at[piece] - ends[:-1], sizes) + np.arange(ends[-1])]
        bounds = split.offsets.to_numpy()
        return ids, ends[2 * (bounds - bounds[0])]

    def batches(self, batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Slices of some ``SLICE`` bytes of text with the ids and bounds of ``batch``; a longer text is a slice of its own."""
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // SLICE
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                part = batch.slice(a, b - a)
                yield part, *self.batch(part.column(column))


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
