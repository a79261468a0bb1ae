"""Word shingles of whole texts as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np

CACHE = 1 << 18
ODD = 0x9E3779B97F4A7C15
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class WordHash(dict):
    """64-bit hash of a word; results do not depend on what is remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word, 11)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, width: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of a text, ASCII letters lower-cased.

    A text with fewer words is one shingle; without words there is none.
    """
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(ids) - width + 1)
    total = np.full(n, min(len(ids), width), np.uint64)
    for j in range(min(len(ids), width)):
        total = mixed(total * np.uint64(ODD) + ids[j : j + n])
    return np.unique(total)
