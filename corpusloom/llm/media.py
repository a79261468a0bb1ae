"""Media columns: payloads stored as lossless WebP images, read back into pixel arrays (operator 3)."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import webp

#: Pixels in a row of an image, as long as it is not taller than the format allows.
ROW = 16
#: Images that leave a task together.
ROWS = 64
STORED = "doc_id long, n_bytes long, media binary"
PIXELS = "doc_id long, n_bytes long, width int, height int, pixels binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(data: bytes) -> bytes:
    """``data`` with bytes 0 up to a positive multiple of 64."""
    return data + bytes(-len(data) % 64 if data else 64)


def to_image(payload: bytes) -> bytes:
    """A lossless WebP file whose pixels, four bytes each, are the payload; equal payloads give equal files."""
    flat = np.frombuffer(payload, "<u4")
    width = ROW
    while len(flat) > width * webp.MAX_SIDE:
        width *= 2
    if width > webp.MAX_SIDE:
        raise ValueError("payload larger than an image can be")
    full = -(-len(flat) // width) * width
    if full > len(flat):  # only texts above a megabyte: the rows of wide images are filled up
        flat = np.concatenate([flat, np.zeros(full - len(flat), np.uint32)])
    return webp.smallest(flat.reshape(-1, width))


def from_image(media: bytes, payload_bytes: int) -> tuple[np.ndarray, bytes]:
    argb = webp.decode(media)
    return argb, argb.astype("<u4").tobytes()[:payload_bytes]


def feature(payload: bytes) -> str:
    """Mean, deviation and a histogram of eight bins of the samples, read back."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples >> 5, minlength=8)
    return f"mean={samples.mean():.4f};dev={samples.std():.4f};hist={','.join(map(str, counts.tolist()))}"


def rows_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple]]:
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield list(zip(*(c.to_pylist() for c in batch.slice(at, most).columns), strict=True))


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: each text (null: empty) in UTF-8, padded, as a lossless WebP file.

    Extra columns are not read, repeated rows and ids are stored again, each with its own text, a null id stays null, an empty table
    gives an empty result.  Equal texts give equal files, as the form of a file depends on its pixels alone.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches, ROWS):
            data = [(text or "").encode("utf-8", "replace") for _, text in rows]
            yield pa.record_batch(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([len(d) for d in data], pa.int64()), pa.array([to_image(padded(d)) for d in data], pa.binary())],
                names=["doc_id", "n_bytes", "media"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(write, STORED)


def read_media(stored: DataFrame, with_pixels: bool = True) -> DataFrame:
    """Decode ``store_media`` rows: pixel arrays (ARGB, little-endian 32-bit), digests of what was read, and a feature."""
    names = [x.split()[0] for x in PIXELS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for rows in rows_of(batches, ROWS):
            out = []
            for doc, n, media in rows:
                size = max(64, -(-n // 64) * 64)
                argb, payload = from_image(media, size)
                pixels = argb.astype("<u4").tobytes() if with_pixels else None
                digest, tail = hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])
                out.append((doc, n, argb.shape[1], argb.shape[0], pixels, len(payload), digest, tail, len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return stored.mapInArrow(read, PIXELS)


def media_digests(docs: DataFrame) -> DataFrame:
    """What a media column holds after a round trip through its stored form, one row per document."""
    found = read_media(store_media(docs), with_pixels=False)
    sides = ["width", "height"]
    return found.select(*[c for c in found.columns if c not in ("pixels", *sides)], *sides)
