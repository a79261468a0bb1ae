"""Lossless WebP."""

import hashlib
import zlib

import brute
import numpy as np
import pytest

from corpusloom.llm import media, webp

RNG = np.random.default_rng(0)
SHAPES = [(1, 1), (1, 16), (3, 1), (5, 16), (40, 33)]


def images(shape):
    n = shape[0] * shape[1]
    yield RNG.integers(0, 1 << 32, shape, np.uint32)
    yield (RNG.integers(0, 5, shape) * 0x01020304).astype(np.uint32)
    yield np.zeros(shape, np.uint32)
    yield np.frombuffer(bytes(RNG.choice(np.frombuffer(b"the quick brown fox ", np.uint8), 4 * n)), "<u4").reshape(shape)


@pytest.mark.parametrize("shape", SHAPES)
def test_round_trips(shape):
    groups = (2, RNG.integers(0, 3, webp.blocks(shape[0], 2) * webp.blocks(shape[1], 2)))
    for image in images(shape):
        for cache_bits in (0, 1, 5, 11):
            for copies in (None, webp.runs(image)):
                for fixed, own in ((False, None), (False, groups), (True, None)):
                    assert np.array_equal(webp.decode(webp.encode(image, fixed, cache_bits, copies, own)), image)


def test_copies_at_any_distance():
    width = 20
    flat = RNG.integers(0, 1 << 32, 400, np.uint32)
    copies = []
    for at, length, distance in ((30, 5, 20), (40, 3, 19), (50, 10, 1), (70, 12, 3), (90, 30, 60), (150, 100, 150), (260, 4, 22), (300, 1, 161), (310, 90, 2)):
        for i in range(length):
            flat[at + i] = flat[at + i - distance]
        copies.append((at, length, distance))
    image = flat.reshape(-1, width)
    for cache_bits in (0, 6):
        assert np.array_equal(webp.decode(webp.encode(image, False, cache_bits, copies)), image)


def test_values_and_neighbours():
    for value in [*range(1, 300), 4095, 4096, 1 << 20]:
        symbol, n, extra = webp.prefix_value(value)
        bits = webp.Bits(extra.to_bytes(8, "little"))
        assert webp.read_value(bits, symbol) == value and bits.at == n
    assert len(set(webp.NEIGHBOURS)) == 120
    near = [x * x + y * y for x, y in webp.NEIGHBOURS]
    assert near == sorted(near)


def with_transforms(image, steps):
    """A file whose pixels pass through the transforms (plain, pixel by pixel)."""
    height, width = image.shape
    out = webp.Writer()
    for value, n in ((width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.put(value, n)
    now = image
    for kind, side, size in steps:
        out.put(1, 1)
        out.put(kind, 2)
        if kind in (webp.PREDICTOR, webp.CROSS):
            out.put(size - 2, 3)
            webp.write_image(out, side.ravel(), side.shape[1], False)
        elif kind == webp.PALETTE:
            out.put(len(side) - 1, 8)
            parts = webp.channels(side).astype(int)
            parts[1:] -= parts[:-1].copy()
            webp.write_image(out, webp.packed(parts & 255), len(side), False)
        now = FORWARD[kind](now, side, size)
    out.put(0, 1)
    webp.write_image(out, np.ascontiguousarray(now).ravel(), now.shape[1], True)
    return webp.container(out)


def parts_of(value):
    return [int(value) >> s & 255 for s in (24, 16, 8, 0)]


def joined(parts):
    return sum((p & 255) << s for p, s in zip(parts, (24, 16, 8, 0), strict=True))


def average(a, b):
    return [(x + y) // 2 for x, y in zip(a, b, strict=True)]


def select(left, top, corner):
    guess = [x + y - z for x, y, z in zip(left, top, corner, strict=True)]
    far = [sum(abs(g - v) for g, v in zip(guess, side, strict=True)) for side in (left, top)]
    return left if far[0] < far[1] else top


def clamp(values):
    return [min(255, max(0, v)) for v in values]


def plain_prediction(mode, left, top, right, corner):
    if mode == 13:
        middle = average(left, top)
        return clamp([m + int((m - c) / 2) for m, c in zip(middle, corner, strict=True)])
    return [
        [255, 0, 0, 0], left, top, right, corner, average(average(left, right), top), average(left, corner), average(left, top), average(corner, top), average(top, right),
        average(average(left, corner), average(top, right)), select(left, top, corner), clamp([x + y - z for x, y, z in zip(left, top, corner, strict=True)]),
    ][mode]


def forward_predictor(image, modes, size):
    height, width = image.shape
    out = np.zeros_like(image)
    flat = image.ravel()
    for y in range(height):
        for x in range(width):
            i = y * width + x
            if not i:
                guess = [255, 0, 0, 0]
            elif not y:
                guess = parts_of(flat[i - 1])
            elif not x:
                guess = parts_of(flat[i - width])
            else:
                mode = int(modes[y >> size, x >> size]) >> 8 & 15
                guess = plain_prediction(mode, *(parts_of(flat[k]) for k in (i - 1, i - width, i - width + 1, i - width - 1)))
            out[y, x] = joined([a - b for a, b in zip(parts_of(flat[i]), guess, strict=True)])
    return out


def signed(x):
    return (x & 255) - 256 * ((x & 255) > 127)


def forward_cross(image, elements, size):
    out = np.zeros_like(image)
    for y, x in np.ndindex(*image.shape):
        alpha, red, green, blue = parts_of(image[y, x])
        _, red_to_blue, green_to_blue, green_to_red = map(signed, parts_of(elements[y >> size, x >> size]))
        out[y, x] = joined([alpha, red - (green_to_red * signed(green) >> 5), green, blue - (green_to_blue * signed(green) >> 5) - (red_to_blue * signed(red) >> 5)])
    return out


def forward_green(image, *_):
    out = np.zeros_like(image)
    for at in np.ndindex(*image.shape):
        alpha, red, green, blue = parts_of(image[at])
        out[at] = joined([alpha, red - green, green, blue - green])
    return out


def forward_palette(image, table, _):
    number = {int(c): i for i, c in enumerate(table)}
    bits = webp.palette_bits(len(table))
    out = np.zeros((len(image), webp.blocks(image.shape[1], bits)), np.uint32)
    for y, x in np.ndindex(*image.shape):
        out[y, x >> bits] |= number[int(image[y, x])] << ((x & (1 << bits) - 1) * (8 >> bits)) << 8
    return out


FORWARD = {webp.PREDICTOR: forward_predictor, webp.CROSS: forward_cross, webp.GREEN: forward_green, webp.PALETTE: forward_palette}


def test_predictor_modes():
    for size in (2, 4):
        image = RNG.integers(0, 1 << 32, (23, 19), np.uint32)
        for mode in range(14):
            modes = np.full((webp.blocks(23, size), webp.blocks(19, size)), mode << 8, np.uint32)
            assert np.array_equal(webp.decode(with_transforms(image, [(webp.PREDICTOR, modes, size)])), image)
        modes = (RNG.integers(0, 14, (webp.blocks(23, size), webp.blocks(19, size))) << 8).astype(np.uint32)
        assert np.array_equal(webp.decode(with_transforms(image, [(webp.PREDICTOR, modes, size)])), image)


def test_colour_transforms_and_chains():
    image = RNG.integers(0, 1 << 32, (9, 14), np.uint32)
    side = RNG.integers(0, 1 << 32, (webp.blocks(9, 2), webp.blocks(14, 2)), np.uint32)
    modes = (RNG.integers(0, 14, (webp.blocks(9, 3), webp.blocks(14, 3))) << 8).astype(np.uint32)
    for steps in ([(webp.CROSS, side, 2)], [(webp.GREEN, None, 0)], [(webp.PREDICTOR, modes, 3), (webp.CROSS, side, 2), (webp.GREEN, None, 0)]):
        assert np.array_equal(webp.decode(with_transforms(image, steps)), image)


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 256])
def test_palettes(colours):
    table = RNG.integers(0, 1 << 32, colours, np.uint32)
    image = table[RNG.integers(0, colours, (7, 21))]
    steps = [(webp.PALETTE, table, 0)]
    assert np.array_equal(webp.decode(with_transforms(image, steps)), image)
    modes = (RNG.integers(0, 14, (2, webp.blocks(webp.blocks(21, webp.palette_bits(colours)), 2))) << 8).astype(np.uint32)
    assert np.array_equal(webp.decode(with_transforms(image, [*steps, (webp.PREDICTOR, modes, 2)])), image)


def test_broken_streams():
    whole = webp.encode(RNG.integers(0, 1 << 32, (8, 8), np.uint32))
    with pytest.raises(ValueError, match="not a lossless"):
        webp.decode(b"RIFF" + whole[5:])
    cut = bytearray(whole[:60])
    cut[16:20] = (40).to_bytes(4, "little")
    with pytest.raises((ValueError, IndexError)):
        webp.decode(bytes(cut))


def expected(docs):
    for doc, text in docs:
        data = (text or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        yield doc, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])


def test_media_column(edge_docs, edge_rows, small, no_docs, clashing, spark):
    for df, rows in ((edge_docs, [r[:2] for r in edge_rows]), (small, brute.rows(small.select("doc_id", "text")))):
        out = media.media_digests(df).collect()
        assert {tuple(r)[:5] for r in out} == set(expected(rows))
        text = dict(rows)
        by_text = {}
        for r in out:
            assert by_text.setdefault(text[r.doc_id] or "", tuple(r)[1:]) == tuple(r)[1:]
    assert media.media_digests(no_docs).count() == 0
    assert set(brute.rows(media.media_digests(clashing))) == set(brute.rows(media.media_digests(edge_docs)))
    odd = media.read_media(media.store_media(spark.createDataFrame([(None, None), (1, "a"), (1, "a")], "doc_id long, text string"))).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.width, r.height) for r in odd) == [("1", 1, 16, 1), ("1", 1, 16, 1), ("None", 0, 16, 1)]
    assert odd[0].pixels.rstrip(b"\0") in (b"", b"a")


def test_smallest_form_by_content():
    """Each form is chosen where it pays, is read back, and is not much above the least of all forms."""
    words = RNG.integers(0, 1 << 32, 16, np.uint32)
    steps = RNG.integers(0, 1 << 32, 16, np.uint32)
    many = RNG.integers(0, 1 << 32, 900, np.uint32)
    images = {
        "fixed": np.frombuffer(b"some words of plain text, not many. " * 16, "<u4").reshape(-1, 16),
        "own": RNG.integers(0, 9, (400, 64)).astype(np.uint8).view("<u4"),
        "cache": many[np.cumsum(RNG.integers(0, 3, 12000)) % 900].reshape(-1, 16),
        "palette": words[RNG.integers(0, 2, (5, 8))[RNG.integers(0, 5, 800)].reshape(-1, 16)],
        "predictor": webp.packed(np.cumsum(np.broadcast_to(webp.channels(steps), (500, 16, 4)).astype(np.int64), axis=0) & 255),
    }
    for name, image in images.items():
        keeps = {"predictor": webp.predictor_image(image, 2), "palette": (webp.palette_image(image) or (None, image))[1]}
        how = {"fixed": {"fixed": True}, "own": {}, "cache": {"cache_bits": webp.CACHE_BITS}, "palette": {"transform": webp.PALETTE}, "predictor": {"transform": webp.PREDICTOR}}
        files = {k: webp.encode(image, copies=webp.runs(keeps.get(k, image)), **v) for k, v in how.items() if k != "palette" or webp.palette_image(image)}
        for file in files.values():
            assert np.array_equal(webp.decode(file), image)
        assert webp.smallest(image) == files[name]
        assert len(files[name]) <= min(map(len, files.values())) + webp.PRICE
    side = np.frombuffer(bytes(RNG.integers(0, 256, 64 * 40, np.uint8)), "<u4").reshape(-1, 16)
    assert np.array_equal(webp.decode(webp.encode(side, transform=webp.PREDICTOR, mode=1)), side)


def test_form_has_no_switch_by_size():
    sizes = [len(media.to_image(b"a" * n)) for n in range(32_640, 33_000, 64)]
    assert max(sizes) - min(sizes) < 16


def test_tall_and_wide_payloads():
    for n in (64 * webp.MAX_SIDE, 64 * webp.MAX_SIDE + 64):
        payload = bytes(RNG.integers(97, 110, n, np.uint8))
        assert media.from_image(media.to_image(payload), n)[1] == payload
