"""Column functions.  Each returns a ``Column`` built from Spark's own functions unless it says otherwise."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The code points that Unicode-aware whitespace matching takes in.
WHITESPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
BYTE_BOS, BYTE_EOS, BYTE_SHIFT, BYTE_CAP = 1, 2, 16, 272
#: Bytes of text that a Python worker turns into tokens at a time: tokens take four times as many.
PIECE = 1 << 22
#: Clocks within this distance count as equal.
CLOCK_SLACK_S = 3


def whitespace_normalize(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WHITESPACE, " "))


def _pieces(raw: pa.Array) -> Iterator[pa.Array]:
    """Slices of a batch of byte strings, each of less than ``PIECE`` bytes beyond its first string."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(ends // PIECE)) + 1).tolist(), len(raw)]
    return (raw.slice(low, high - low) for low, high in zip(cuts, cuts[1:], strict=False))


def _tokens_of(raw: pa.Array) -> pa.Array:
    filled = pc.fill_null(raw, b"")
    _, ends, data = filled.buffers()
    offsets = np.frombuffer(ends, np.int32)[filled.offset : filled.offset + len(filled) + 1] if len(filled) else np.zeros(1, np.int32)
    tokens = np.add(np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]], BYTE_SHIFT, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), pa.array(tokens), mask=raw.is_null())


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _byte_tokens(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for text in texts:
        for raw in _pieces(text.cast(pa.binary())):
            yield _tokens_of(raw)


@F.arrow_udf(T.StructType().add("tokens", T.ArrayType(T.IntegerType())).add("sha256", T.StringType()))
def _hashed_byte_tokens(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for text in texts:
        for raw in _pieces(text.cast(pa.binary())):
            tokens = _tokens_of(raw)
            low, ends = (tokens.values.to_numpy() - BYTE_SHIFT).astype(np.uint8).tobytes(), tokens.offsets.to_pylist()
            hashes = [hashlib.sha256(low[a:b].hex().upper().encode()).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]
            hashes = pc.if_else(raw.is_valid(), pa.array(hashes, pa.string()), None)
            yield pa.StructArray.from_arrays([tokens, hashes], ["tokens", "sha256"])


#: Token ids of a text: its UTF-8 bytes plus 16.  Not deterministic for the optimizer only, so that it runs once.
byte_tokenize = _byte_tokens.asNondeterministic()
#: The same with the SHA-256 of the bytes that the tokens stand for, in hex digits: tokens need not go to Python again for it.
hashed_byte_tokenize = _hashed_byte_tokens.asNondeterministic()


@F.arrow_udf(T.BinaryType())
def _blake128(seed: pa.Array, crawl: pa.Array, doc: pa.Array) -> pa.Array:
    rows = zip(seed.to_pylist(), crawl.to_pylist(), doc.to_pylist(), strict=True)
    return pa.array([hashlib.blake2b(f"{c}\0{d}".encode(), digest_size=16, key=s).digest() for s, c, d in rows], pa.binary())


keyed_hash128 = _blake128.asNondeterministic()


@F.arrow_udf(T.BinaryType())
def _blake64(domain: pa.Array, key: pa.Array) -> pa.Array:
    rows = zip(domain.to_pylist(), key.to_pylist(), strict=True)
    return pa.array([hashlib.blake2b(d.encode() + b"\0" + k, digest_size=8).digest() for d, k in rows], pa.binary())


reservation_hash64 = _blake64.asNondeterministic()


def sha_key(crawl: Column, doc: Column) -> Column:
    """32 hex digits that order documents at random: the built-in flavour of the document key."""
    return F.substring(F.sha2(F.concat(crawl, F.lit("\0"), doc.cast("string")), 256), 1, 32)


def sha_reservation(domain: str, key: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(f"{domain}\0"), key), 256), 1, 16)


def share_threshold(fraction: float, digits: int) -> str:
    """Hex digits below which ``fraction`` of all hashes lie."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie strictly between 0 and 1")
    return f"{int(fraction * 16**digits):0{digits}x}"


def sha256_hex(data: Column) -> Column:
    return F.sha2(data, 256)


def canonical_digest(value: object, compact: bool = True) -> str:
    """SHA-256 of JSON with sorted keys; manifests use default separators, recipes compact ones."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":") if compact else None)
    return hashlib.sha256(text.encode()).hexdigest()


def glob_regex(pattern: str) -> str:
    """Anchored, segment-aware glob: ``*`` and ``?`` stay within a segment, ``**/`` takes any segments, ``**`` any rest."""
    out, at = "", 0
    while at < len(pattern):
        if pattern.startswith("**/", at):
            out, at = out + "(?:[^/]+/)*", at + 3
        elif pattern.startswith("**", at):
            out, at = out + ".*", at + 2
        else:
            c = pattern[at]
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if not c.isalnum() and c not in "/_-" and c.isascii() else c
            at += 1
    return f"^{out}$"


def glob_match(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern))


def safe_object_name(name: Column) -> Column:
    """Relative, no empty, ``.`` or ``..`` segment, no backslash or control character."""
    return name.rlike(r"^[^/\\\x00-\x1f]+(/[^/\\\x00-\x1f]+)*\z") & ~name.rlike(r"(^|/)\.{1,2}(/|$)")


def safe_chunk_name(name: Column) -> Column:
    """A safe object name of one segment that ends in ``.bin``."""
    return safe_object_name(name) & ~name.contains("/") & name.rlike(r"[^.]\.bin\z")


def schema_hash(kinds: dict[str, str]) -> str:
    """SHA-256 over field names and types in the order of names, so that equal schemas agree whatever their order."""
    return canonical_digest(sorted(kinds.items()))


def crawl_of(path: Column) -> Column:
    """First segment that starts ``CC-MAIN-``, else the first segment, else the base name without extension."""
    parts = F.split(path, "/")
    crawl = F.filter(parts, lambda x: x.startswith("CC-MAIN-"))
    return F.when(F.size(crawl) > 0, crawl[0]).when(F.size(parts) > 1, parts[0]).otherwise(F.regexp_replace(path, r"\.[^.]*$", ""))


def parse_log_ts(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss,SSS"))


def ms_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1000.0


def rate_to_mbps(text: Column) -> Column:
    """``12.3Mbps`` with K, M or G in megabits; null where it does not fit."""
    number = F.regexp_extract(text, r"^([0-9.]+)([KMG]?)bps$", 1)
    unit = F.regexp_extract(text, r"^([0-9.]+)([KMG]?)bps$", 2)
    factor = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "G", 1e9).otherwise(1.0)
    return F.when(number != "", number.cast("double") * factor / 1e6)


def member_value(text: Column) -> Column:
    """``peer[_ghost1_N|_ghost2_N]`` as (peer, phase, epoch); phase 0 without a suffix, the last suffix counts."""
    pattern = r"^(.+)_ghost([12])_([0-9]+)$"
    has = text.rlike(pattern)
    return F.when(
        text.isNotNull(),
        F.struct(
            F.when(has, F.regexp_extract(text, pattern, 1)).otherwise(text).alias("peer"),
            F.when(has, F.regexp_extract(text, pattern, 2).cast("int")).otherwise(0).alias("phase"),
            F.when(has, F.regexp_extract(text, pattern, 3).cast("int")).alias("epoch"),
        ),
    )


def stage_of(uid: Column) -> Column:
    return F.split_part(uid, F.lit("."), F.lit(1))


def successor_stage(uid: Column, stages: int) -> Column:
    """head, body1, ..., body(n-2), tail; nothing follows the tail."""
    stage = stage_of(uid)
    after = F.regexp_extract(stage, r"^body([0-9]+)$", 1).cast("int") + 1
    first = F.lit("tail" if stages <= 2 else "body1")
    return F.when(stage == "head", first).when(stage.startswith("body") & (after > stages - 2), "tail").when(stage.startswith("body"), F.concat(F.lit("body"), after.cast("string")))


def flop_per_sample(params: Column, layers: int, heads: int, head_dim: int, seq: int, backward: bool = False) -> Column:
    attention = (8 if backward else 4) * layers * heads * head_dim * seq
    return (F.lit(4.0 if backward else 2.0) * params + F.lit(float(attention))) * F.lit(float(seq))


def shift_labels(tokens: Column, batch: int | None = None) -> Column:
    """(inputs, labels): all but the last token, all but the first; with ``batch``, also each label's weight 1/(batch * labels)."""
    n = F.size(tokens) - 1
    weight = [] if batch is None else [F.when(n > 0, 1.0 / (n * batch)).alias("weight")]
    return F.struct(F.slice(tokens, F.lit(1), n).alias("inputs"), F.slice(tokens, F.lit(2), n).alias("labels"), *weight)


def ttl_seconds(expiration: Column, now: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(expiration) - F.unix_micros(now)) / 1e6)


def normalize_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^0-9a-z]+", " "))


def max_age(ages: Column) -> Column:
    """Largest of ``a/b/c``."""
    return F.array_max(F.transform(F.split(ages, "/"), lambda x: x.cast("double")))


def finite(vector: Column) -> Column:
    return ~F.exists(vector, lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def nearest_rank(values: Column, fraction: float) -> Column:
    """``sorted[min(n-1, round(f*(n-1)))]``, rounding half to even; null for no values."""
    ordered = F.array_sort(values)
    n = F.size(ordered)
    at = F.least(n - 1, F.bround(F.lit(fraction) * (n - 1)).cast("int"))
    return F.when(n > 0, F.get(ordered, at))
