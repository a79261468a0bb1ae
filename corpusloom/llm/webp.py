"""Lossless WebP (VP8L): bit stream to pixels and back.

Pixels are ARGB values in ``uint32`` arrays of shape (height, width).  The decoder reads prefix codes (one group or many),
back-references, the colour cache, and the predictor, cross-colour, subtract-green and palette transforms.  Runs of
literal pixels are decoded in bulk: for every bit position of a window it is computed where a pixel that starts there
ends, and the chain of real pixels is then followed.
"""

from __future__ import annotations

import heapq
import struct
from functools import cached_property, lru_cache

import numpy as np

PREDICTOR, CROSS, GREEN, PALETTE = range(4)
LENGTHS = 24
DISTANCES = 40
MAX_SIDE = 1 << 14
# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
HASH = 0x1E35A7BD
NEIGHBOURS = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


def blocks(size: int, bits: int) -> int:
    return (size + (1 << bits) - 1) >> bits


def prefix_value(value: int) -> tuple[int, int, int]:
    """Prefix symbol, number of extra bits and extra bits of a length or distance."""
    value -= 1
    if value < 4:
        return value, 0, 0
    extra = value.bit_length() - 2
    high = value >> extra
    return 2 * extra + high, extra, value - (high << extra)


class Bits:
    """Bits of a byte string, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at = data + bytes(12), 0

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return (int.from_bytes(self.data[byte : byte + 8], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def take(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the stream ends early")
        return value


class PrefixCode:
    """Canonical prefix code; ``symbol`` and ``length`` are indexed by the next ``bits`` bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) < 2:  # a lone symbol takes no bits
            self.bits = 0
            self.symbol = np.array([used[0] if len(used) else 0], np.int32)
            self.length = np.zeros(1, np.int32)
        else:
            self.bits = int(lengths.max())
            order = used[np.lexsort((used, lengths[used]))]
            span = 1 << (self.bits - lengths[order])
            if span.sum() != 1 << self.bits:
                raise ValueError("prefix code is not complete")
            # In order of the codes each symbol covers a run of values; the stream holds codes first bit first.
            flip = reversed_bits(self.bits)
            self.symbol, self.length = np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int32)
            self.symbol[flip], self.length[flip] = np.repeat(order, span), np.repeat(lengths[order], span)
        self.mask = (1 << self.bits) - 1

    @cached_property
    def plain(self) -> tuple[list[int], list[int]]:
        return self.symbol.tolist(), self.length.tolist()

    def read(self, bits: Bits) -> int:
        symbol, length = self.plain
        k = bits.peek(self.bits)
        bits.at += length[k]
        return symbol[k]


@lru_cache(maxsize=16)
def reversed_bits(n: int) -> np.ndarray:
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


def read_lengths(bits: Bits, alphabet: int) -> np.ndarray:
    lengths = np.zeros(alphabet, np.int64)
    if bits.take(1):
        two, wide = bits.take(1), bits.take(1)
        symbols = [bits.take(8 if wide else 1)]
        if two:
            symbols.append(bits.take(8))
        lengths[symbols] = 1
        return lengths
    first = np.zeros(19, np.int64)
    for k in CODE_LENGTH_ORDER[: 4 + bits.take(4)]:
        first[k] = bits.take(3)
    code = PrefixCode(first)
    left = 2 + bits.take(2 + 2 * bits.take(3)) if bits.take(1) else alphabet
    at, before = 0, 8
    while at < alphabet and left:
        left -= 1
        k = code.read(bits)
        if k < 16:
            lengths[at] = k
            before = k or before
            at += 1
        else:
            times = 3 + bits.take(2) if k == 16 else 3 + bits.take(3) if k == 17 else 11 + bits.take(7)
            lengths[at : at + times] = before if k == 16 else 0
            at += times
    if at > alphabet:
        raise ValueError("code lengths run over")
    return lengths


_known: dict[tuple[int, int], list[tuple[int, int, list[PrefixCode]]]] = {}


def read_group(bits: Bits, cache_size: int) -> list[PrefixCode]:
    """Codes for green (with lengths and cache), red, blue, alpha, distance.

    Groups read before are recognised by their bits and not built again.
    """
    for n, value, group in _known.get((cache_size, bits.at & 7), []):
        byte = bits.at >> 3
        if (int.from_bytes(bits.data[byte : byte + (n + 15 >> 3)], "little") >> (bits.at & 7)) & ((1 << n) - 1) == value:
            bits.at += n
            return group
    start = bits.at
    group = [PrefixCode(read_lengths(bits, n)) for n in (256 + LENGTHS + cache_size, 256, 256, 256, DISTANCES)]
    n, byte = bits.at - start, start >> 3
    value = (int.from_bytes(bits.data[byte : byte + (n + 15 >> 3)], "little") >> (start & 7)) & ((1 << n) - 1)
    if len(_known) > 32:
        _known.clear()
    _known.setdefault((cache_size, start & 7), []).insert(0, (n, value, group))
    del _known[cache_size, start & 7][4:]
    return group


#: Bits of a window in which pixel ends are computed for every position.
WINDOW = 1 << 16


def pixel_ends(bits: Bits, group: list[PrefixCode]) -> tuple[np.ndarray, memoryview]:
    """Next 15 bits at each position of the window, and where a literal pixel that starts there ends (relative)."""
    byte = bits.at >> 3
    data = np.frombuffer(bits.data[byte : byte + (WINDOW >> 3) + 12], np.uint8).astype(np.int32)
    three = data[:-2] | (data[1:-1] << 8) | (data[2:] << 16)
    ahead = ((three[:, None] >> np.arange(8, dtype=np.int32)) & 0x7FFF).ravel()
    n = max(0, min(WINDOW, len(ahead) - 64))
    green, red, blue, alpha, _ = group
    now = ahead[:n] & green.mask
    at = np.arange(n, dtype=np.int32)
    at += green.length.take(now)
    for code in (red, blue, alpha):
        if code.bits:
            at += code.length.take(ahead.take(at) & code.mask)
    if green.symbol.max() >= 256:
        at[green.symbol.take(now) >= 256] = 1 << 30
    return ahead, memoryview(at)  # few of the positions are ever read


def pixels_at(ahead: np.ndarray, starts: np.ndarray, group: list[PrefixCode]) -> np.ndarray:
    """ARGB of the literal pixels that start at these positions."""
    found, at = [], starts.copy()
    for code in group[:4]:
        k = ahead[at] & code.mask
        found.append(code.symbol[k].astype(np.uint32))
        at += code.length[k]
    green, red, blue, alpha = found
    return (alpha << 24) | (red << 16) | (green << 8) | blue


#: Up to so many pixels are faster read one by one.
FEW = 12


def pixel_at(ahead: np.ndarray, start: int, group: list[PrefixCode]) -> int:
    found = []
    for code in group[:4]:
        symbol, length = code.plain
        k = int(ahead[start]) & code.mask
        found.append(symbol[k])
        start += length[k]
    green, red, blue, alpha = found
    return (alpha << 24) | (red << 16) | (green << 8) | blue


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image, flat."""
    cache_bits = bits.take(4) if bits.take(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    cache_size = 1 << cache_bits if cache_bits else 0
    meta, meta_bits = None, 0
    if main and bits.take(1):
        meta_bits = bits.take(3) + 2
        meta = ((read_image(bits, blocks(width, meta_bits), blocks(height, meta_bits), False) >> 8) & 0xFFFF).tolist()
    groups = [read_group(bits, cache_size) for _ in range(max(meta) + 1 if meta else 1)]
    n, done, cached = width * height, 0, 0
    out = np.zeros(n, np.uint32)
    cache = np.zeros(cache_size, np.uint32)
    across = blocks(width, meta_bits) if meta else 0

    while done < n:
        group = groups[meta[((done // width) >> meta_bits) * across + ((done % width) >> meta_bits)] if meta else 0]
        if meta is None:
            if not any(c.bits for c in group[:4]) and group[0].symbol[0] < 256:
                out[done:] = pixels_at(np.zeros(1, np.int32), np.zeros(1, np.int64), group)[0]
                return out
            offset = bits.at & 7
            base = bits.at - offset
            ahead, ends = pixel_ends(bits, group)
            # Follow the chain through this window; specials interrupt it.
            at, limit = offset, len(ends)
            while done < n and at < limit:
                path = []
                room = n - done
                while at < limit:
                    path.append(at)
                    at = ends[at]
                special = at >= 1 << 30
                if special:
                    at = path.pop()
                if len(path) > room:  # behind the last pixel
                    at, special = path[room], False
                    del path[room:]
                if len(path) > FEW:
                    out[done : done + len(path)] = pixels_at(ahead, np.array(path), group)
                else:
                    for k, start in enumerate(path, done):
                        out[k] = pixel_at(ahead, start, group)
                done += len(path)
                bits.at = base + at
                if special and done < n:
                    done, cached = read_special(bits, group, out, done, cached, cache, cache_bits, width)
                    at = bits.at - base
            if bits.at > 8 * len(bits.data):
                raise ValueError("the stream ends early")
            continue
        start = bits.at
        symbol = group[0].read(bits)
        if symbol < 256:
            red, blue, alpha = (c.read(bits) for c in group[1:4])
            out[done] = (alpha << 24) | (red << 16) | (symbol << 8) | blue
            done += 1
        else:
            bits.at = start
            done, cached = read_special(bits, group, out, done, cached, cache, cache_bits, width)
        if bits.at > 8 * len(bits.data):
            raise ValueError("the stream ends early")
    return out


def read_special(bits: Bits, group: list[PrefixCode], out: np.ndarray, done: int, cached: int, cache: np.ndarray, cache_bits: int, width: int) -> tuple[int, int]:
    """A back-reference or a colour of the cache; the cache takes in the pixels since ``cached`` only when it is asked."""
    symbol = group[0].read(bits)
    if symbol < 256 + LENGTHS:
        length = read_value(bits, symbol - 256)
        code = read_value(bits, group[4].read(bits))
        distance = code - 120
        if code <= 120:
            x, y = NEIGHBOURS[code - 1]
            distance = max(1, x + y * width)
        if distance > done or done + length > len(out):
            raise ValueError("back-reference outside the image")
        if distance >= length:
            out[done : done + length] = out[done - distance : done - distance + length]
        else:
            out[done : done + length] = np.resize(out[done - distance : done], length)
        return done + length, cached
    fresh = out[cached:done]
    if len(fresh) > FEW:
        cache[colour_slot(fresh, cache_bits)] = fresh  # of several colours in a slot the last stays
    else:
        for colour in fresh.tolist():
            cache[(colour * HASH & 0xFFFFFFFF) >> (32 - cache_bits)] = colour
    out[done] = cache[symbol - 256 - LENGTHS]
    return done + 1, done


def colour_slot(argb: np.ndarray, cache_bits: int) -> np.ndarray:
    return (argb * np.uint32(HASH)) >> np.uint32(32 - cache_bits)


def read_value(bits: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.take(extra) + 1


def channels(argb: np.ndarray) -> np.ndarray:
    """Blue, green, red, alpha bytes."""
    return np.ascontiguousarray(argb, np.dtype("<u4")).view(np.uint8).reshape(*argb.shape, 4)


def packed(parts: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(parts.astype(np.uint8)).view(np.dtype("<u4")).reshape(parts.shape[:-1])


def predicted(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Prediction of a pixel, or of a row of them, from its left, top, top-right and top-left neighbours (int arrays)."""
    half = lambda a, b: (a + b) >> 1
    if mode == 11:
        to = np.abs(top - corner).sum(-1, keepdims=True), np.abs(left - corner).sum(-1, keepdims=True)
        return np.where(to[0] < to[1], left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        middle = half(left, top)
        return np.clip(middle + np.trunc((middle - corner) / 2).astype(np.int64), 0, 255)
    return (
        lambda: np.broadcast_to(np.array([0, 0, 0, 255]), top.shape),
        lambda: left,
        lambda: top,
        lambda: right,
        lambda: corner,
        lambda: half(half(left, right), top),
        lambda: half(left, corner),
        lambda: half(left, top),
        lambda: half(corner, top),
        lambda: half(top, right),
        lambda: half(half(left, corner), half(top, right)),
    )[mode if mode < 11 else 0]()


#: Modes that look at no pixel of the same row, so a run of them is one step.
ROW_FREE = frozenset((0, 2, 4, 8))


def undo_predictor(argb: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    height, width = argb.shape
    out = channels(argb).astype(np.int64)
    out[0, 0] += (0, 0, 0, 255)
    out[0] = np.cumsum(out[0], axis=0) & 255
    mode_of = (modes >> 8) & 15
    for y in range(1, height):
        row, above = out[y], out[y - 1]
        row[0] = (row[0] + above[0]) & 255
        for block in range(mode_of.shape[1]):
            a, b = max(1, block << bits), min(width, (block + 1) << bits)
            mode = int(mode_of[y >> bits, block])
            if a >= b:
                continue
            if mode in ROW_FREE:
                row[a:b] = (row[a:b] + predicted(mode, row[a:b], above[a:b], above[a:b], above[a - 1 : b - 1])) & 255
            elif mode == 1:
                row[a - 1 : b] = np.cumsum(row[a - 1 : b], axis=0) & 255
            else:
                for x in range(a, b):
                    # Right of the last column, the row goes on with its own first pixel.
                    right = above[x + 1] if x + 1 < width else row[0]
                    row[x] = (row[x] + predicted(mode, row[x - 1], above[x], right, above[x - 1])) & 255
    return packed(out)


def cross_deltas(elements: np.ndarray, bits: int, shape: tuple[int, int]) -> list[np.ndarray]:
    """Green-to-red, green-to-blue and red-to-blue factors of each pixel."""
    wide = np.repeat(np.repeat(channels(elements).view(np.int8).astype(np.int64), 1 << bits, 0), 1 << bits, 1)[: shape[0], : shape[1]]
    return [wide[..., k] for k in range(3)]


def cross_delta(factor: np.ndarray, colour: np.ndarray) -> np.ndarray:
    return (factor * colour.astype(np.uint8).view(np.int8).astype(np.int64)) >> 5


def undo_cross(argb: np.ndarray, elements: np.ndarray, bits: int) -> np.ndarray:
    to_red, to_blue, red_to_blue = cross_deltas(elements, bits, argb.shape)
    parts = channels(argb).astype(np.int64)
    green = parts[..., 1]
    red = (parts[..., 2] + cross_delta(to_red, green)) & 255
    parts[..., 0] = (parts[..., 0] + cross_delta(to_blue, green) + cross_delta(red_to_blue, red)) & 255
    parts[..., 2] = red
    return packed(parts)


def palette_bits(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def undo_palette(argb: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    bits = palette_bits(len(table))
    index = (argb >> 8) & 255
    if bits:
        each = 8 >> bits
        index = ((index[..., None] >> (each * np.arange(1 << bits, dtype=np.uint32))) & ((1 << each) - 1)).reshape(len(argb), -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(table)] = table
    return full[index]


def decode(data: bytes) -> np.ndarray:
    """Pixels of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20:21] != b"\x2f":
        raise ValueError("not a lossless WebP file")
    bits = Bits(data[21 : 20 + struct.unpack("<I", data[16:20])[0]])
    width, height = bits.take(14) + 1, bits.take(14) + 1
    bits.take(1)
    if bits.take(3):
        raise ValueError("unknown version")
    steps, now = [], width
    while bits.take(1):
        kind = bits.take(2)
        if kind in (PREDICTOR, CROSS):
            size = bits.take(3) + 2
            side = read_image(bits, blocks(now, size), blocks(height, size), False).reshape(-1, blocks(now, size))
            steps.append((kind, side, size, now))
        elif kind == GREEN:
            steps.append((kind, None, 0, now))
        else:
            n = bits.take(8) + 1
            table = packed(np.cumsum(channels(read_image(bits, n, 1, False)).astype(np.int64), axis=0) & 255)
            steps.append((kind, table, 0, now))
            now = blocks(now, palette_bits(n))
    argb = read_image(bits, now, height, True).reshape(height, now)
    for kind, side, size, before in reversed(steps):
        if kind == PREDICTOR:
            argb = undo_predictor(argb, side, size)
        elif kind == CROSS:
            argb = undo_cross(argb, side, size)
        elif kind == GREEN:
            parts = channels(argb).copy()
            parts[..., 0] += parts[..., 1]
            parts[..., 2] += parts[..., 1]
            argb = packed(parts)
        else:
            argb = undo_palette(argb, side, before)
    return argb


#: Bits of the side of the largest block that has one predictor mode.
LARGEST_BLOCK = 9
#: The format allows 15 bits; shorter codes make small tables, which readers look up faster.
MOST_BITS = 12


def code_lengths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Lengths of a prefix code of at most ``most`` bits; ties are broken by symbol, so equal counts give equal codes."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    weight = counts[used].astype(np.int64)
    while True:
        heap = [(int(w), k) for k, w in enumerate(weight)]
        heapq.heapify(heap)
        parent, made = {}, len(used)
        while len(heap) > 1:
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i] = parent[j] = made
            heapq.heappush(heap, (a + b, made))
            made += 1
        depth = {made - 1: 0}
        for k in range(made - 2, -1, -1):
            depth[k] = depth[parent[k]] + 1
        found = np.array([depth[k] for k in range(len(used))])
        if found.max() <= most:
            lengths[used] = found
            return lengths
        weight = (weight + 1) // 2


def codes_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code bits as the stream holds them and their number, by symbol; a lone symbol takes none."""
    used = np.flatnonzero(lengths)
    bits, size = np.zeros(len(lengths), np.uint64), np.zeros(len(lengths), np.int64)
    if len(used) < 2:
        return bits, size
    code = before = 0
    for k in used[np.lexsort((used, lengths[used]))].tolist():
        n = int(lengths[k])
        code <<= n - before
        before = n
        bits[k] = int(f"{code:0{n}b}"[::-1], 2)
        code += 1
    return bits, lengths.copy()


class Writer:
    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def lengths(self, lengths: np.ndarray) -> None:
        used = np.flatnonzero(lengths).tolist()
        if len(used) < 3 and (not used or (max(used) < 256 and (len(used) < 2 or lengths.max() == 1))):
            self.put(1, 1)
            self.put(max(0, len(used) - 1), 1)
            self.put(1, 1)
            for k in used or [0]:
                self.put(k, 8)
            return
        self.put(0, 1)
        runs, values = [], lengths.tolist()
        at = 0
        while at < len(values):
            end = at
            while end < len(values) and values[end] == values[at]:
                end += 1
            n = end - at
            if values[at]:
                runs.append((values[at], 0, 0))
                n -= 1
                while n >= 3:
                    runs.append((16, min(n, 6) - 3, 2))
                    n -= min(n, 6)
                runs += [(values[at], 0, 0)] * n
            else:
                while n >= 11:
                    runs.append((18, min(n, 138) - 11, 7))
                    n -= min(n, 138)
                if n >= 3:
                    runs.append((17, n - 3, 3))
                    n = 0
                runs += [(0, 0, 0)] * n
            at = end
        first = code_lengths(np.bincount([r[0] for r in runs], minlength=19), 7)
        if np.count_nonzero(first) == 1:  # written as two symbols, for a code of one bit each
            first[0 if not first[0] else 1] = 1
        self.put(19 - 4, 4)
        for k in CODE_LENGTH_ORDER:
            self.put(int(first[k]), 3)
        self.put(0, 1)
        bits, size = codes_of(first)
        for symbol, extra, n in runs:
            self.put(int(bits[symbol]), int(size[symbol]))
            self.put(extra, n)

    def tokens(self, value: np.ndarray, size: np.ndarray) -> None:
        """Append values of up to 63 bits each."""
        ends = np.cumsum(size)
        at = ends - size + (self.n & 63)
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        total = int(at[-1] + size[-1]) // 64 + 2 if len(size) else 1
        low, high = value << shift, np.where(shift > 0, value >> ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        words = np.zeros(total, np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        if len(first):
            words[word[first]] |= np.bitwise_or.reduceat(low, first)
            words[word[first] + 1] |= np.bitwise_or.reduceat(high, first)
        start = self.n - (self.n & 63)
        self.value |= int.from_bytes(words.astype("<u8").tobytes(), "little") << start
        self.n += int(ends[-1]) if len(ends) else 0


def tokens_of(argb: np.ndarray, width: int, cache_bits: int, copies: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind (0 literal, 1 copy, 2 cache), first pixel and distance code of each token; ``copies`` are (at, length, distance)."""
    n = len(argb)
    start = np.ones(n, bool)
    kind = np.zeros(n, np.int64)
    extra = np.zeros(n, np.int64)
    near = {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(NEIGHBOURS)))} if copies else {}
    for at, length, distance in copies:
        start[at + 1 : at + length] = False
        kind[at], extra[at] = 1, near.get(distance, distance + 120)
    if cache_bits:
        slot = colour_slot(argb, cache_bits)
        # A pixel is in the cache if the last pixel before it in its slot had its colour (at first: 0).
        order = np.argsort(slot, kind="stable")
        last = np.zeros(n, np.uint32)
        again = np.flatnonzero(slot[order][1:] == slot[order][:-1])
        last[order[again + 1]] = argb[order[again]]
        hit = (last == argb) & start & (kind == 0)
        kind[hit], extra[hit] = 2, slot[hit]
    at = np.flatnonzero(start)
    return kind[at], at, extra[at]


def write_image(out: Writer, argb: np.ndarray, width: int, main: bool, cache_bits: int = 0, copies: list[tuple[int, int, int]] | None = None, groups: tuple[int, np.ndarray] | None = None, fixed: bool = False) -> None:
    """Entropy-code a flat image.  ``groups``: block bits and group number of each block; ``fixed``: use the codes for short texts."""
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    kind, at, extra = tokens_of(argb, width, cache_bits, copies or [])
    group = np.zeros(len(at), np.int64)
    if main:
        out.put(1 if groups else 0, 1)
        if groups:
            bits, numbers = groups
            out.put(bits - 2, 3)
            write_image(out, (numbers.astype(np.uint32) << 8) | np.uint32(0xFF000000), blocks(width, bits), False)
            group = numbers[((at // width) >> bits) * blocks(width, bits) + ((at % width) >> bits)]
    lengths = np.diff(np.append(at, len(argb)))
    colour = argb[at]
    # Symbols of copies, with their extra bits: (token, length prefix, distance prefix).
    copied = [(k, prefix_value(int(lengths[k])), prefix_value(int(extra[k]))) for k in np.flatnonzero(kind == 1).tolist()]
    cache_size = 1 << cache_bits if cache_bits else 0
    value, size = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64)
    if fixed:
        out.put(*fixed_header())
    for g in range(int(groups[1].max()) + 1 if groups else 1):
        own = np.flatnonzero(group == g) if groups else slice(None)
        parts = [((colour[own] >> np.uint32(shift)) & np.uint32(255)).astype(np.intp) for shift in (8, 16, 0, 24)]
        here = [c for c in copied if group[c[0]] == g]
        if fixed:
            codes = [fixed_codes(k) for k in range(5)]
        else:
            literal = kind[own] == 0
            used = [p[literal] for p in parts]
            cached = 256 + LENGTHS + extra[own][kind[own] == 2]
            used[0] = np.concatenate([used[0], cached, np.array([256 + c[1][0] for c in here], np.intp)])
            used.append(np.array([c[2][0] for c in here], np.intp))
            sizes = (256 + LENGTHS + cache_size, 256, 256, 256, DISTANCES)
            found = [code_lengths(np.bincount(u, minlength=n)) for u, n in zip(used, sizes, strict=True)]
            for code in found:
                out.lengths(code)
            codes = [codes_of(code) for code in found]
        # All tokens as literals first; those that are not are then set right.
        v, n = codes[0][0].take(parts[0]), codes[0][1].take(parts[0])
        for (bits, length), part in zip(codes[1:4], parts[1:], strict=True):
            v |= bits.take(part) << n.view(np.uint64)
            n += length.take(part)
        hit = np.flatnonzero(kind[own] == 2)
        if len(hit):
            slot = 256 + LENGTHS + extra[own][hit]
            v[hit], n[hit] = codes[0][0].take(slot), codes[0][1].take(slot)
        value[own], size[own] = v, n
        for k, (length, length_n, length_bits), (far, far_n, far_bits) in here:
            token = Writer()
            token.put(int(codes[0][0][256 + length]), int(codes[0][1][256 + length]))
            token.put(length_bits, length_n)
            token.put(int(codes[4][0][far]), int(codes[4][1][far]))
            token.put(far_bits, far_n)
            value[k], size[k] = token.value, token.n
    out.tokens(value, size)


def text_lengths(alphabet: int) -> np.ndarray:
    """Code lengths for bytes of text: letters by how common they are, then other marks, every byte possible."""
    counts = np.ones(alphabet, np.int64)
    if alphabet > DISTANCES:
        counts[32:127] = 300
        for rank, c in enumerate(b" etaoinshrdlcumwfgypbvkjxqz"):
            counts[c] = 60_000 // (rank + 3)
            counts[c - 32 if c != 32 else c] = max(counts[c - 32], counts[c] // 12) if c != 32 else counts[c]
        counts[[10, 44, 46]] = 2_000
        counts[0xC3] = 1_000
        counts[0xA0:0xC0] = 60
    return code_lengths(counts)


#: One code for all short texts, so that readers need not build it anew for each.
FIXED = (text_lengths(256 + LENGTHS), text_lengths(256), text_lengths(256), text_lengths(256), text_lengths(DISTANCES))


@lru_cache(maxsize=8)
def fixed_codes(k: int) -> tuple[np.ndarray, np.ndarray]:
    return codes_of(FIXED[k])


@lru_cache(maxsize=1)
def fixed_header() -> tuple[int, int]:
    out = Writer()
    for code in FIXED:
        out.lengths(code)
    return out.value, out.n


def container(out: Writer) -> bytes:
    body = b"\x2f" + out.value.to_bytes(-(-out.n // 8), "little")
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + bytes(len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def palette_image(argb: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The colours of an image and the image of their numbers, several to a pixel where they are few; None above 256 colours."""
    table, number = np.unique(argb, return_inverse=True)
    if len(table) > 256:
        return None
    bits = palette_bits(len(table))
    number = number.reshape(argb.shape).astype(np.uint32)
    if bits:
        wide = np.zeros((len(argb), blocks(argb.shape[1], bits) << bits), np.uint32)
        wide[:, : argb.shape[1]] = number
        number = (wide.reshape(len(argb), -1, 1 << bits) << ((8 >> bits) * np.arange(1 << bits, dtype=np.uint32))).sum(-1, dtype=np.uint32)
    return table, number << np.uint32(8)


def predictor_image(argb: np.ndarray, mode: int) -> np.ndarray:
    """What is left of an image if each pixel is predicted by its left (mode 1) or its top neighbour (mode 2)."""
    parts = channels(argb)
    out = parts.copy()
    if mode == 1:
        out[:, 1:] -= parts[:, :-1]
        out[1:, 0] -= parts[:-1, 0]
    else:
        out[1:] -= parts[:-1]
        out[0, 1:] -= parts[0, :-1]
    out[:1, 0, 3] -= np.uint8(255)
    return packed(out)


def encode(argb: np.ndarray, fixed: bool = False, cache_bits: int = 0, copies: list[tuple[int, int, int]] | None = None, groups: tuple[int, np.ndarray] | None = None, transform: int | None = None, mode: int = 2) -> bytes:
    """A lossless WebP file of these pixels, as they are or by a ``transform``: the predictor (with ``mode``) or the palette.

    ``copies`` are those of the image that is stored.
    """
    height, width = argb.shape
    out = Writer()
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    if transform is not None:
        out.put(1, 1)
        out.put(transform, 2)
    if transform == PREDICTOR:
        out.put(LARGEST_BLOCK - 2, 3)
        side = blocks(width, LARGEST_BLOCK)
        write_image(out, np.full(side * blocks(height, LARGEST_BLOCK), 0xFF000000 | mode << 8, np.uint32), side, False)
        argb = predictor_image(argb, mode)
    elif transform == PALETTE:
        table, argb = palette_image(argb)
        out.put(len(table) - 1, 8)
        write_image(out, packed(np.diff(channels(table), axis=0, prepend=np.uint8(0))), len(table), False)
    out.put(0, 1)
    write_image(out, argb.ravel(), argb.shape[1], True, cache_bits, copies, groups, fixed and not cache_bits)
    return container(out)


def runs(argb: np.ndarray, least: int = 3) -> list[tuple[int, int, int]]:
    """Copies from one pixel back, for runs of a colour."""
    flat = argb.ravel()
    # same[i]: pixel i repeats the one before it.
    same = np.concatenate([[False], flat[1:] == flat[:-1], [False]])
    edge = np.flatnonzero(same[1:] != same[:-1]) + 1
    out = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        at, end = a, b
        while end - at >= least:
            out.append((at, min(4096, end - at), 1))
            at += out[-1][1]
    return out


#: Bytes that a form with codes of its own must save over the codes for texts; it takes readers and writers that much longer.
PRICE = 3000
#: The largest cache of the format.
CACHE_BITS = 11


def coded_bits(counts: np.ndarray) -> float:
    """About the bits of symbols with these counts (one row a code), with the codes themselves."""
    total = counts.sum(-1)
    used = np.count_nonzero(counts, axis=-1)
    return float((total * np.log2(np.maximum(total, 1))).sum() - (counts * np.log2(np.maximum(counts, 1))).sum() + (60 + 5 * used).sum())


def channel_counts(flat: np.ndarray) -> np.ndarray:
    """How often each blue, green, red, alpha value comes."""
    return np.bincount((channels(flat) + 256 * np.arange(4)).ravel(), minlength=1024).reshape(4, 256)


def literals(flat: np.ndarray) -> np.ndarray:
    """Pixels that do not repeat the one before."""
    return flat[np.concatenate([[True], flat[1:] != flat[:-1]])]


def cached_bits(flat: np.ndarray, cache_bits: int) -> float:
    kind, at, slot = tokens_of(flat, 1, cache_bits, [])
    counts = channel_counts(flat[at[kind == 0]])
    hits = np.bincount(slot[kind == 2], minlength=1 << cache_bits)
    return coded_bits(counts[[0, 2, 3]]) + coded_bits(np.concatenate([counts[1], hits])[None])


def smallest(argb: np.ndarray) -> bytes:
    """The image as a file in the form that is estimated to be the smallest, by its pixels alone.

    Forms are: one fixed set of codes for texts; own codes; own codes and a colour cache; a palette; each pixel predicted by the one
    above.  All but the first are charged ``PRICE``.  Runs are copies in each.
    """
    flat = literals(argb.ravel())
    counts = channel_counts(flat)
    plain = fixed_header()[1] + float((counts * fixed_table()).sum())
    best, form = plain - 8 * PRICE, {"fixed": True}
    if best > 0:  # else no form can save as much
        forms = [(coded_bits(counts), {}), (cached_bits(flat, CACHE_BITS), {"cache_bits": CACHE_BITS})]
        forms.append((coded_bits(channel_counts(literals(predictor_image(argb, 2).ravel()))), {"transform": PREDICTOR}))
        found = palette_image(argb)
        if found:
            table, index = found
            forms.append((coded_bits(channel_counts(table)) + coded_bits(channel_counts(literals(index.ravel()))), {"transform": PALETTE}))
        size, own = min(forms, key=lambda f: f[0])
        if size < best:
            form = own
    kept = {PREDICTOR: lambda: predictor_image(argb, 2), PALETTE: lambda: palette_image(argb)[1]}.get(form.get("transform"), lambda: argb)()
    return encode(argb, copies=runs(kept), **form)


@lru_cache(maxsize=1)
def fixed_table() -> np.ndarray:
    """Lengths of the codes for texts by blue, green, red, alpha value."""
    green, red, blue, alpha = (code[:256] for code in FIXED[:4])
    return np.stack([blue, green, red, alpha])
