"""Building a corpus: documents in, a globally shuffled token stream cut into chunks out.

A document table has ``crawl, doc_id, text`` (all non-null); a keyed one also ``key``, hex digits that order it at random.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import scalar
from corpusloom.plans.ranking import hash_bucket, with_prefix_sum

TRANSFORMS = {("whitespace_normalize", 1): scalar.whitespace_normalize}


def select_items(inventory: DataFrame, include: Sequence[str], exclude: Sequence[str] = (), column: str = "name") -> DataFrame:
    """Items that any ``include`` glob matches and no ``exclude`` glob does."""
    name = F.col(column)

    def any_of(patterns: Sequence[str]) -> Column:
        return name.rlike("|".join(f"(?:{scalar.glob_regex(p)})" for p in patterns)) if patterns else F.lit(False)

    return inventory.where(any_of(include) & ~any_of(exclude))


def with_crawl(df: DataFrame, path: str = "path", name: str = "crawl") -> DataFrame:
    return df.withColumn(name, scalar.crawl_of(F.col(path)))


def apply_transforms(df: DataFrame, specs: Sequence[tuple[str, int]], column: str = "text") -> DataFrame:
    """Apply versioned transforms in order; an unknown one is an error before anything is read."""
    unknown = [s for s in specs if tuple(s) not in TRANSFORMS]
    if unknown:
        raise ValueError(f"unknown transforms: {unknown}")
    out = df
    for spec in specs:
        out = out.withColumn(column, TRANSFORMS[tuple(spec)](F.col(column)))
    return out


def transforms_digest(specs: Sequence[tuple[str, int]]) -> str:
    return scalar.canonical_digest([{"name": n, "version": v} for n, v in specs])


def doc_key(df: DataFrame, flavour: str = "sha2", seed: bytes = b"") -> DataFrame:
    """Add ``key``: 32 hex digits by SHA-256, or by keyed BLAKE2b-128."""
    if flavour == "sha2":
        return df.withColumn("key", scalar.sha_key(F.col("crawl"), F.col("doc_id")))
    return df.withColumn("key", F.lower(F.hex(scalar.keyed_hash128(F.lit(seed), "crawl", F.col("doc_id").cast("string")))))


def global_shuffle(df: DataFrame) -> DataFrame:
    """Ascending keys are the shuffled order, whatever the partitions of the input."""
    return df.orderBy("key")


def tranche(df: DataFrame, fraction: float) -> DataFrame:
    """The first ``fraction`` of the order; it pushes down to sorted files."""
    return df.where(F.col("key") < scalar.share_threshold(fraction, 32))


def with_validation(df: DataFrame, domain: str, fraction: float, flavour: str = "sha2") -> DataFrame:
    """Mark the documents reserved for validation, at random by key and domain."""
    limit = scalar.share_threshold(fraction, 16)
    if flavour == "sha2":
        found = scalar.sha_reservation(domain, F.col("key"))
    else:
        found = F.lower(F.hex(scalar.reservation_hash64(F.lit(domain), F.unhex("key"))))
    return df.withColumn("is_validation", found < limit)


def route_roles(df: DataFrame, roles: Sequence[str]) -> DataFrame:
    """Reserved documents go to ``validation`` only where there is such an output."""
    return df.withColumn("role", F.when(F.col("is_validation"), "validation").otherwise("train") if "validation" in roles else F.lit("train"))


def tokenize_bytes(df: DataFrame, column: str = "text", digest: str | None = None) -> DataFrame:
    """``tokens``; with ``digest``, also the SHA-256 of their bytes in hex under that name, from the same pass."""
    if digest is None:
        return df.withColumn("tokens", scalar.byte_tokenize(column))
    return df.withColumn("_t", scalar.hashed_byte_tokenize(column)).withColumns({"tokens": F.col("_t.tokens"), digest: F.col("_t.sha256")}).drop("_t")


def tokenize_with(df: DataFrame, path: str, column: str = "text", sha256: str | None = None) -> DataFrame:
    """``tokens`` by a pinned tokenizer file that every executor can open; no special tokens are added, null texts have none.

    With ``sha256``, an executor that finds another file under the name fails.
    """

    @F.arrow_udf("array<int>")
    def ids(text: pa.Array) -> pa.Array:
        encode = _tokenizer(path, sha256).encode_batch_fast
        return pa.array([e.ids for e in encode(text.fill_null("").to_pylist(), add_special_tokens=False)], pa.list_(pa.int32()))

    return df.withColumn("tokens", ids.asNondeterministic()(column))


@lru_cache(maxsize=4)
def _tokenizer(path: str, sha256: str | None):
    from tokenizers import Tokenizer

    with open(path, "rb") as file:
        data = file.read()
    if sha256 and hashlib.sha256(data).hexdigest() != sha256:
        raise ValueError(f"{path} is not the tokenizer that the recipe pins")
    return Tokenizer.from_str(data.decode())


def drop_docs_with_eos(df: DataFrame, eos: int) -> DataFrame:
    return df.where(~F.array_contains("tokens", eos))


def assert_token_range(df: DataFrame, cap: int) -> DataFrame:
    bad = (F.array_min("tokens") < 0) | (F.array_max("tokens") >= cap)
    return df.withColumn("tokens", F.when(bad, F.raise_error(F.lit("token id out of range"))).otherwise(F.col("tokens")))


def frame_tokens(df: DataFrame, bos: int | None, eos: int) -> DataFrame:
    """``[BOS] + tokens + [EOS]``; without ``bos`` the legacy form."""
    parts = [F.array(F.lit(bos))] * (bos is not None) + [F.col("tokens"), F.array(F.lit(eos))]
    return df.withColumn("tokens", F.concat(*parts))


def assign_units(units: DataFrame, workers: int, worker: int | None = None) -> DataFrame:
    """Units dealt to ``workers`` by the number at the end of ``unit_id``; with ``worker``, those of one of them."""
    out = units.withColumn("worker", F.pmod(F.regexp_extract("unit_id", "([0-9]+)$", 1).cast("long"), F.lit(workers)).cast("int"))
    return out if worker is None else out.where(F.col("worker") == worker)


def union_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """Parts as one table, by column name; columns that a part lacks are an error."""
    if not parts:
        raise ValueError("no parts")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def reconcile_output(written: DataFrame, expected: DataFrame) -> DataFrame:
    """Roles whose written documents or tokens differ from what the parts add up to; both have ``role, docs, tokens``."""
    a = written.select("role", F.col("docs").alias("written_docs"), F.col("tokens").alias("written_tokens"))
    met = a.join(expected.groupBy("role").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")), "role", "full")
    return met.where(~(F.col("docs").eqNullSafe(F.col("written_docs")) & F.col("tokens").eqNullSafe(F.col("written_tokens"))))


def unit_stats(df: DataFrame, by: Sequence[str] = ("unit_id",)) -> DataFrame:
    """Per unit, of rows with ``has_eos, is_validation, n_tokens`` (framed): seen, selected, dropped, validation, tokens."""
    taken = ~F.col("has_eos")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("seen"),
        F.count_if(taken).alias("selected"),
        F.count_if(F.col("has_eos")).alias("dropped_eos"),
        F.count_if(taken & F.col("is_validation")).alias("validation"),
        F.coalesce(F.sum(F.when(taken, F.col("n_tokens"))), F.lit(0)).alias("tokens"),
    )


def role_stats(df: DataFrame, totals: bool = False) -> DataFrame:
    """Documents and tokens per unit and role; with ``totals``, rolled up."""
    grouped = df.rollup("unit_id", "role") if totals else df.groupBy("unit_id", "role")
    return grouped.agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))


def eos_drop_violations(stats: DataFrame, max_rate: float) -> DataFrame:
    return stats.where((F.col("seen") > 0) & (F.col("dropped_eos") > F.lit(max_rate) * F.col("seen")))


def duplicate_keys(df: DataFrame, column: str = "key") -> DataFrame:
    """Keys that repeat.  A build fails on any."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def fail_if_any(violations: DataFrame, what: str) -> None:
    if not violations.isEmpty():
        raise ValueError(f"{what}: {violations.limit(3).collect()}")


def stream_offsets(df: DataFrame, n: str = "n_tokens") -> DataFrame:
    """Start of each document in the token stream: an exclusive prefix sum in key order, without a global window."""
    keyed = df.withColumn("_bucket", hash_bucket("key")).withColumn("_all", F.lit(0))
    return with_prefix_sum(keyed, F.col(n), ["_all"], "_bucket", ["key"], "start_pos", "stream_tokens").drop("_bucket", "_all")


def token_budget(df: DataFrame, budget: int, n: str = "n_tokens", tokens: str | None = None) -> DataFrame:
    """Exact prefix of a stream with ``start_pos``; the last document is cut and counts as one."""
    out = df.where(F.col("start_pos") < budget)
    if tokens:
        out = out.withColumn(tokens, F.slice(tokens, F.lit(1), F.least(F.size(tokens), (F.lit(budget) - F.col("start_pos")).cast("int"))))
    return out.withColumn(n, F.least(F.col(n), F.lit(budget) - F.col("start_pos")))


def cut_chunks(df: DataFrame, chunk: int, n: str = "n_tokens", tokens: str | None = None) -> DataFrame:
    """Pieces of chunks: chunk k holds positions kC to (k+1)C inclusive, the last of them shared with the next chunk.

    Rows: ``chunk_id, pos`` (in the chunk), ``from_doc`` (first token of the document taken), ``n_piece`` and the document's
    columns; with ``tokens`` also the slice.  A chunk is never gathered into one row.
    """
    start, end = F.col("start_pos"), F.col("start_pos") + F.col(n)
    last = F.expr(f"(start_pos + {n} - 1) div {chunk}")
    first = F.expr(f"start_pos div {chunk}")
    # A document that starts on a boundary also gives the overlap token of the chunk before.
    first = F.when((F.pmod(start, F.lit(chunk)) == 0) & (start > 0), first - 1).otherwise(first)
    out = df.where(F.col(n) > 0).withColumn("chunk_id", F.explode(F.sequence(first, last)))
    low = F.greatest(start, F.col("chunk_id") * chunk)
    high = F.least(end, (F.col("chunk_id") + 1) * chunk + 1)
    out = out.withColumns({"pos": low - F.col("chunk_id") * chunk, "from_doc": low - start, "n_piece": high - low}).where("n_piece > 0")
    # Overlap tokens of a stream that ends on the boundary belong to no further chunk; those pieces are empty above.
    if tokens:
        out = out.withColumn(tokens, F.slice(tokens, (F.col("from_doc") + 1).cast("int"), F.col("n_piece").cast("int")))
    return out


def chunk_counts(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_piece").alias("tokens"))


def order_violations(df: DataFrame, key: str = "key", by: Sequence[str] = ()) -> DataFrame:
    """Rows of a part, in position order, whose key is not larger than the one before."""
    before = F.lag(key).over(Window.partitionBy(*by).orderBy("position"))
    return df.withColumn("previous_key", before).where(F.col("previous_key") >= F.col(key))


def pending_units(units: DataFrame, markers: DataFrame, pins: Sequence[str]) -> DataFrame:
    """Units without a valid completion marker (same unit and pins)."""
    return units.join(markers.select("unit_id", *pins), ["unit_id", *pins], "left_anti")


def marker_mismatches(units: DataFrame, markers: DataFrame, pins: Sequence[str]) -> DataFrame:
    """Units whose marker disagrees: an error, not a reason to rebuild."""
    theirs = markers.select("unit_id", *[F.col(p).alias(f"marker_{p}") for p in pins])
    differs = ~F.lit(True)
    for p in pins:
        differs = differs | ~F.col(p).eqNullSafe(F.col(f"marker_{p}"))
    return units.join(theirs, "unit_id").where(differs)


def inventory_drift(live: DataFrame, locked: DataFrame) -> DataFrame:
    """Names whose size differs or that only one side has."""
    a, b = live.select("name", F.col("size").alias("live_size")), locked.select("name", F.col("size").alias("locked_size"))
    return a.join(b, "name", "full").where(~F.col("live_size").eqNullSafe(F.col("locked_size")))


def reconcile_units(markers: DataFrame, parts: DataFrame) -> DataFrame:
    """Units whose counts do not add up; ``parts`` has docs and tokens per unit and role.

    With a ``validation`` column in the markers, it is at most what was selected, and what the validation role holds, if there
    is such a role.
    """
    held = F.col("role") == "validation"
    sums = parts.groupBy("unit_id").agg(
        F.sum("docs").alias("part_docs"), F.sum("tokens").alias("part_tokens"), F.sum(F.when(held, F.col("docs"))).alias("part_validation"), F.count_if(F.col("tokens") < 2 * F.col("docs")).alias("_short")
    )
    joined = markers.join(sums, "unit_id", "left").na.fill(0, ["part_docs", "part_tokens", "_short"])
    good = (
        (F.col("seen") == F.col("selected") + F.col("dropped_eos"))
        & (F.col("part_docs") == F.col("selected"))
        & (F.col("part_tokens") == F.col("tokens"))
        & (F.col("_short") == 0)
        & (F.col("rows").isNull() | (F.col("seen") == F.col("rows")))
    )
    if "validation" in markers.columns:
        good = good & (F.col("validation") <= F.col("selected")) & (F.col("part_validation").isNull() | (F.col("part_validation") == F.col("validation")))
    return joined.where(~F.coalesce(good, F.lit(False))).drop("_short")


def reconcile_crawls(units: DataFrame, markers: DataFrame) -> DataFrame:
    """Crawls whose seen rows differ from the declared ones, over units with evidence."""
    sums = units.where("rows is not null").join(markers.select("unit_id", "seen"), "unit_id").groupBy("crawl").agg(F.sum("seen").alias("seen"), F.sum("rows").alias("declared"))
    return sums.where("seen <> declared")


def split_leak(parts: DataFrame, domain: str, fraction: float, flavour: str = "sha2") -> DataFrame:
    """Rows whose role disagrees with their recomputed reservation."""
    again = with_validation(parts.drop("is_validation"), domain, fraction, flavour)
    return again.where((F.col("role") == "validation") != F.col("is_validation"))


def chunk_integrity(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Chunks missing, extra, or of another size or digest than the manifest says."""
    found = chunks.select("name", F.col("size").alias("found_size"), F.col("sha256").alias("found_sha256"))
    joined = found.join(manifest.select("name", "tokens", "sha256"), "name", "full")
    good = (F.col("found_size") == 4 * F.col("tokens")) & (F.col("found_sha256") == F.col("sha256"))
    return joined.where(~F.coalesce(good, F.lit(False)))


def overlap_breaks(objects: DataFrame) -> DataFrame:
    """Objects whose last token is not the first of the next; ``ordinal, first_token, last_token, n``."""
    following = objects.select((F.col("ordinal") - 1).alias("ordinal"), F.col("first_token").alias("next_first"))
    return objects.join(following, "ordinal").where("last_token <> next_first")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows only one side has, with ``side``; empty where the bags are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def membership_diff(known: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """``evict`` what is known but not live, ``refresh`` what is live."""
    gone = known.select(key).distinct().join(live.select(key), key, "left_anti").withColumn("action", F.lit("evict"))
    return gone.unionByName(live.select(key).distinct().withColumn("action", F.lit("refresh")))


def intersection(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of both sides: train and validation must have none."""
    return a.select(key).intersect(b.select(key))


def manifest_of(chunks: DataFrame, eos: int, chunk_tokens: int, total_docs: int) -> dict:
    """Self-certifying manifest of ``chunk_id, name, tokens, sha256`` rows (one per chunk, so it fits the driver)."""
    rows = chunks.orderBy("chunk_id").select("name", "sha256", "tokens").collect()
    body = {
        "format": "corpusloom-chunks-v1",
        "dtype": "int32",
        "eos_id": eos,
        "chunk_tokens": chunk_tokens,
        "total_tokens": sum(r["tokens"] for r in rows) - max(0, len(rows) - 1),
        "total_docs": total_docs,
        "chunks": [r.asDict() for r in rows],
    }
    return body | {"manifest_sha256": scalar.canonical_digest(body, compact=False)}
