"""SetSketch registers: exponentially spaced truncated minima (mergeable, locality-sensitive).

Register ``i`` holds ``floor(1 - log_b(e_i))`` truncated to 0..q+1, where ``e_i`` is the least of exponential
variates (rate ``RATE``) that element hashes give.  The sketch of a union is the elementwise maximum.  With ``b``
near 1, two registers are equal with a probability close to the Jaccard similarity.
"""

from __future__ import annotations

import math

import numpy as np

BASE = 1.001
RATE = 20.0
LIMIT = (1 << 16) - 1
_LOG = math.log(BASE)
#: Elements that are hashed together.
BLOCK = 1 << 15


def multipliers(m: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20240607)).integers(0, 1 << 64, m, np.uint64) | np.uint64(1)


def registers_of_minima(minima: np.ndarray) -> np.ndarray:
    """Registers from least 64-bit hashes."""
    e = -np.log1p(-(minima.astype(np.float64) + 0.5) / 2.0**64 * (1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(e) / _LOG), 0, LIMIT).astype(np.uint16)


def sketches(sets: list[np.ndarray], m: int) -> np.ndarray:
    """One row of ``m`` registers for each set; an empty set has zeros."""
    minima = np.full((len(sets), m), (1 << 64) - 1, np.uint64)
    full = [k for k, s in enumerate(sets) if len(s)]
    odd = multipliers(m)
    at = 0
    while at < len(full):
        upto, size = at, 0
        while upto < len(full) and (upto == at or size + len(sets[full[upto]]) <= BLOCK):
            size += len(sets[full[upto]])
            upto += 1
        group = full[at:upto]
        rows = np.array(group)
        # A very long set is taken in blocks; minima merge.
        parts = [[sets[k] for k in group]] if size <= BLOCK else [[sets[group[0]][i : i + BLOCK]] for i in range(0, size, BLOCK)]
        for part in parts:
            x = np.concatenate(part)
            sizes = np.array([len(p) for p in part])
            begin = np.cumsum(sizes) - sizes
            for i in range(m):
                minima[rows, i] = np.minimum(minima[rows, i], np.minimum.reduceat(x * odd[i], begin))
        at = upto
    out = registers_of_minima(minima)
    out[[k for k, s in enumerate(sets) if not len(s)]] = 0
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(a, b)


def band_keys(regs: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key of each band of ``rows`` registers; the band number is part of it."""
    from corpusloom.llm.shingles import mixed

    n, m = regs.shape
    total = np.tile(np.arange(m // rows, dtype=np.uint64), (n, 1))
    for j in range(rows):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + regs[:, j::rows][:, : m // rows].astype(np.uint64) + np.uint64(1))
    return total.view(np.int64)


def joint_jaccard(more: np.ndarray, less: np.ndarray, same: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of sets of known sizes.

    ``more``, ``less``, ``same``: registers of the first sketch that are greater, smaller, equal.  With shares
    u, v of the sizes, a register is greater with probability p(u - vJ) and smaller with p(v - uJ), where
    p(x) = -log_b(1 - x(b-1)/b).  The likelihood has one maximum, found by golden sections.
    """
    u = n_a / (n_a + n_b)
    v = 1 - u

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / _LOG

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        log = lambda x: np.log(np.maximum(x, 1e-12))
        return more * log(up) + less * log(down) + same * log(1 - up - down)

    lo, hi = np.zeros_like(u), np.minimum(u / v, v / u)
    golden = (math.sqrt(5) - 1) / 2
    for _ in range(30):
        a, b = hi - golden * (hi - lo), lo + golden * (hi - lo)
        left = likelihood(a) > likelihood(b)
        hi, lo = np.where(left, b, hi), np.where(left, lo, a)
    return (lo + hi) / 2
