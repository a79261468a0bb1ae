"""Whole jobs: build a corpus and read it back, fleet metrics, vector averaging."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import scalar
from corpusloom.operators import corpus, samples, telemetry, vectors
from corpusloom.plans.folds import ordered_fold
from corpusloom.session import dealt, stored
from corpusloom.sources import documents as sources
from corpusloom.sources import parts as sources_parts
from corpusloom.sources import token_chunks


@dataclass(frozen=True)
class Recipe:
    """How a corpus is built; its digest goes into the manifest's side-car."""

    seed: bytes = b""
    transforms: tuple[tuple[str, int], ...] = (("whitespace_normalize", 1),)
    domain: str = "validation"
    validation: float = 0.01
    roles: tuple[str, ...] = ("train", "validation")
    chunk_tokens: int = 1 << 26
    budgets: tuple[tuple[str, int], ...] = ()
    max_eos_drop: float = 0.005
    flavour: str = "blake2b"
    #: Tokenizer file, and the ids and vocabulary size that frame and bound its tokens; without a file, bytes.
    tokenizer: str = ""
    bos: int | None = scalar.BYTE_BOS
    eos: int = scalar.BYTE_EOS
    vocabulary: int = scalar.BYTE_CAP

    def __post_init__(self) -> None:
        if not 0 <= self.eos < self.vocabulary or (self.bos is not None and not 0 <= self.bos < self.vocabulary):
            raise ValueError("bos and eos must be ids of the vocabulary")
        if self.chunk_tokens < 1 or any(role not in self.roles or budget < 1 for role, budget in self.budgets):
            raise ValueError("chunks and budgets must be positive, budgets of roles that are built")

    @property
    def tokenizer_sha256(self) -> str | None:
        """Digest of the tokenizer file as it is now; every executor must find the same."""
        if not self.tokenizer:
            return None
        with open(self.tokenizer, "rb") as file:
            return hashlib.sha256(file.read()).hexdigest()

    @property
    def sha256(self) -> str:
        """What is built follows from what the tokenizer file holds, not from where it lies."""
        return scalar.canonical_digest({k: v.hex() if isinstance(v, bytes) else v for k, v in self.__dict__.items()} | {"tokenizer": self.tokenizer_sha256 or ""})


def encode_documents(docs: DataFrame, recipe: Recipe) -> DataFrame:
    """Keyed, tokenized, framed and routed documents of a recipe."""
    rows = docs if "key" in docs.columns else corpus.doc_key(docs, recipe.flavour, recipe.seed)
    rows = corpus.apply_transforms(rows.select("crawl", "doc_id", "text", "unit_id", "key"), recipe.transforms)
    rows = (corpus.tokenize_with(rows, recipe.tokenizer, sha256=recipe.tokenizer_sha256) if recipe.tokenizer else corpus.tokenize_bytes(rows)).drop("text")
    rows = rows.withColumn("has_eos", F.array_contains("tokens", recipe.eos))
    rows = corpus.route_roles(corpus.with_validation(rows, recipe.domain, recipe.validation, recipe.flavour), recipe.roles)
    rows = corpus.frame_tokens(corpus.assert_token_range(rows, recipe.vocabulary), recipe.bos, recipe.eos)
    return rows.withColumns({"n_tokens": F.size("tokens").cast("long"), "tokens": F.col("tokens").cast("array<int>")})


def unit_evidence(docs: DataFrame) -> DataFrame:
    """``unit_id, input_docs, input_hash`` of documents: a count, and two sums over the halves of their digests (order does not matter)."""
    digest = F.sha2(F.concat_ws("\0", *[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in ("crawl", "doc_id", "text")]), 256)
    half = lambda at: F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return docs.groupBy("unit_id").agg(F.count(F.lit(1)).alias("input_docs"), F.concat_ws(":", half(1), half(16)).alias("input_hash"))


def build_units(docs: DataFrame, recipe: Recipe, folder: str, evidence: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Parts and markers of all units (``sources.parts``); only slices of units without a marker are built, by one scan of the documents.

    ``evidence`` (as of ``unit_evidence``) tells what each unit holds; without it the documents are read for it.  A marker of
    another recipe or other documents is an error, and so is a part that is missing, was changed since, or does not add up.
    """
    spark = docs.sparkSession
    units = stored((evidence if evidence is not None else unit_evidence(docs)).select("unit_id", "input_docs", "input_hash", F.lit(recipe.sha256).alias("recipe_sha256")))
    known = stored(sources_parts.read_markers(spark, folder).join(units.select("unit_id"), "unit_id", "left_semi"))
    corpus.fail_if_any(corpus.marker_mismatches(units, known.select("unit_id", *sources_parts.PINS).distinct(), sources_parts.PINS), "units that were built from something else")
    corpus.fail_if_any(sources_parts.changed_parts(known, folder), "parts and marker differ")
    todo = stored(sources_parts.unfinished(units, known))
    if not todo.isEmpty():
        pending = corpus.doc_key(docs.join(todo.select("unit_id"), "unit_id", "left_semi"), recipe.flavour, recipe.seed)
        pending = pending.withColumn("slice", sources_parts.slice_of()).join(known.select("unit_id", "slice"), ["unit_id", "slice"], "left_anti")
        rows = encode_documents(pending, recipe)
        known = known.unionByName(stored(sources_parts.write_parts(rows, todo, folder)))
    # Sums of narrow marker rows against what the files hold now: only counts are read from the parts.
    rows = sources_parts.read_parts(spark, folder).join(units.select("unit_id"), "unit_id", "left_semi") if not units.isEmpty() else spark.createDataFrame([], sources_parts.PART)
    kept = rows.where(~F.col("has_eos")).groupBy("unit_id", "role").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))
    corpus.fail_if_any(corpus.reconcile_units(sources_parts.unit_markers(known), kept), "units whose parts and marker differ")
    return rows, known


def build_corpus(docs: DataFrame, recipe: Recipe, folder: str, evidence: DataFrame | None = None, crawls: DataFrame | None = None, publish_to: str | None = None) -> dict[str, dict]:
    """Build ``role/chunk-*.bin`` and manifests below ``folder`` from ``crawl, doc_id, text`` (and perhaps ``unit_id``).

    Documents are keyed, tokenized once, checked (no repeated key, few that hold EOS, each in the role of its reservation), put into
    key order, cut into chunks and written.  Violations stop the job before any manifest exists; a manifest is the commit of its role.
    What an earlier run has finished is taken from ``folder`` (see ``build_units``).

    ``crawls`` (``crawl, rows``) declares how many documents each crawl has; it must be met.  With ``publish_to``, chunks are hashed
    again where they lie and copied there, each role to its own folder, the manifest last.
    """
    from pyarrow import fs

    unit = F.coalesce("unit_id", F.raise_error(F.lit("null unit_id")).cast("string")) if "unit_id" in docs.columns else F.lit("unit-00000")
    rows, markers = build_units(docs.select("crawl", "doc_id", "text", unit.alias("unit_id")), recipe, folder, evidence)
    if crawls is not None:
        seen = markers.select(F.explode("crawls").alias("crawl", "seen")).groupBy("crawl").agg(F.sum("seen").alias("seen"))
        corpus.fail_if_any(crawls.select("crawl", "rows").join(seen, "crawl", "full").where(~F.col("rows").eqNullSafe(F.col("seen"))), "crawls that do not have the declared rows")
    narrow = rows.select("key", "unit_id", "role", "has_eos", "is_validation", "n_tokens")
    corpus.fail_if_any(corpus.duplicate_keys(narrow), "documents with one key")
    corpus.fail_if_any(corpus.eos_drop_violations(sources_parts.unit_markers(markers), recipe.max_eos_drop), "units that lose too many documents")
    if "validation" in recipe.roles:
        corpus.fail_if_any(corpus.split_leak(narrow, recipe.domain, recipe.validation, recipe.flavour), "documents in the role of others")
    manifests = {}
    for role in recipe.roles:
        own = rows.where((F.col("role") == role) & ~F.col("has_eos"))
        stream = corpus.stream_offsets(own.select("key", "n_tokens", "tokens"))
        budget = dict(recipe.budgets).get(role)
        if budget:
            stream = corpus.token_budget(stream, budget, tokens="tokens")
        stream = stored(stream)
        written = token_chunks.write_chunks(corpus.cut_chunks(stream, recipe.chunk_tokens, tokens="tokens"), f"{folder}/{role}")
        counts = stream.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).first()
        manifest = corpus.manifest_of(written, recipe.eos, recipe.chunk_tokens, counts["docs"])
        if manifest["total_tokens"] != counts["tokens"]:
            raise ValueError(f"{role}: chunks hold {manifest['total_tokens']} tokens, documents {counts['tokens']}")
        store, base = fs.FileSystem.from_uri(f"{folder}/{role}")
        store.create_dir(base, recursive=True)
        for name, value in (("recipe.json", {"recipe_sha256": recipe.sha256}), ("manifest.json", manifest)):
            with store.open_output_stream(f"{base}/{name}") as out:
                out.write(json.dumps(value, sort_keys=True).encode())
        manifests[role] = manifest
    if publish_to:
        for role, manifest in manifests.items():
            corpus.fail_if_any(broken_chunks(docs.sparkSession, f"{folder}/{role}", manifest), f"{role}: chunks that differ from the manifest")
            sources.publish_chunks(docs.sparkSession, f"{folder}/{role}", f"{publish_to}/{role}", manifest)
    return manifests


def broken_chunks(spark: SparkSession, folder: str, manifest: dict) -> DataFrame:
    """Chunks that are missing, extra, or of another size or digest than the manifest says."""
    listed = spark.createDataFrame([(c["name"], c["tokens"], c["sha256"]) for c in manifest["chunks"]], "name string, tokens long, sha256 string")
    found = sources.list_inventory(spark, folder, (".bin",)) if manifest["chunks"] else spark.createDataFrame([], "name string, size long, path string")
    hashed = sources.hash_objects(dealt(found, len(manifest["chunks"]), 1)).select("name", F.col("bytes").alias("size"), "sha256")
    return corpus.chunk_integrity(hashed, listed)


def epoch_samples(manifest: dict, seq: int) -> int:
    """Samples of one epoch; a chunk's tail that fills none is left out."""
    if manifest["chunk_tokens"] % seq:
        raise ValueError("the sequence length must divide the chunk size")
    return sum((c["tokens"] - 1) // seq for c in manifest["chunks"])


def corpus_layout(spark: SparkSession, manifest: dict, seq: int) -> DataFrame:
    chunks = spark.createDataFrame([(int(c["name"][6:-4]), c["tokens"]) for c in manifest["chunks"]], "chunk_id long, tokens long")
    return samples.chunk_layout(chunks, seq)


def read_corpus(spark: SparkSession, folder: str, manifest: dict, seq: int, seed: int, epoch: int = 0, flavour: str = "pcg64") -> DataFrame:
    """One epoch of samples in its order: ``sample_id, chunk_id, j, tokens`` (64-bit), inputs and labels overlapping by all but one."""
    total = epoch_samples(manifest, seq)
    if not total:
        raise ValueError("no chunk holds a whole sample")
    permute = samples.permutation_pcg64 if flavour == "pcg64" else samples.permutation_by_hash
    order = permute(corpus_layout(spark, manifest, seq), seed, epoch).withColumn("sample_id", F.lit(epoch * total) + F.col("chunk_id") * (manifest["chunk_tokens"] // seq) + F.col("local"))
    windows = samples.chunk_samples(token_chunks.read_chunks(spark, folder, manifest), seq)
    return order.join(windows, ["chunk_id", "j"]).select("sample_id", "chunk_id", "j", F.col("tokens").cast("array<bigint>").alias("tokens"))


def read_samples(spark: SparkSession, folder: str, manifest: dict, seq: int, seed: int, ids: DataFrame, flavour: str = "pcg64") -> DataFrame:
    """Samples by ``sample_id`` of any epochs (rows of ``samples.range_ids``, ``stream_batches``, ...), with the columns of ``ids``.

    Ids run on through the epochs.  Only chunks that hold one of the ids are opened; repeated ids give repeated rows.  ``labels`` are
    the inputs one token on.
    """
    total = epoch_samples(manifest, seq)
    if not total:
        raise ValueError("no chunk holds a whole sample")
    placed = stored(samples.locate(ids, F.lit(total), manifest["chunk_tokens"] // seq))
    # One row per chunk and epoch, of which a manifest has few.
    wanted = placed.select("epoch", "chunk_id").distinct().collect()
    layout = corpus_layout(spark, manifest, seq)
    permute = samples.permutation_pcg64 if flavour == "pcg64" else samples.permutation_by_hash
    orders = None
    for epoch in sorted({r["epoch"] for r in wanted}):
        own = permute(layout.where(F.col("chunk_id").isin([r["chunk_id"] for r in wanted if r["epoch"] == epoch])), seed, epoch).withColumn("epoch", F.lit(epoch).cast("long"))
        orders = own if orders is None else orders.unionByName(own)
    chunks = sorted({r["chunk_id"] for r in wanted})
    slices = token_chunks.read_chunks(spark, folder, manifest).where(F.col("chunk_id").isin(chunks))
    if orders is None:
        orders = layout.select("chunk_id", F.lit(0).cast("long").alias("local"), F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("epoch")).where("false")
    windows = samples.chunk_samples(slices, seq).withColumn("tokens", F.col("tokens").cast("array<bigint>"))
    found = placed.join(orders, ["epoch", "chunk_id", "local"]).join(windows, ["chunk_id", "j"])
    return found.select(*ids.columns, "epoch", "chunk_id", "j", F.slice("tokens", 1, seq).alias("inputs"), F.slice("tokens", 2, seq).alias("labels"))


def rechunk_corpus(spark: SparkSession, inventory: DataFrame, old_chunk: int, new_chunk: int, folder: str) -> dict:
    """Cut an ordered legacy stream anew, byte for byte; its overlap tokens must agree.  Documents are not known: counted as 0."""
    # The overlap tokens are read by themselves, and agree before anything is written.
    corpus.fail_if_any(corpus.overlap_breaks(sources.object_ends(inventory)), "objects whose overlap tokens differ")
    slices = stored(sources.scan_token_objects(spark, inventory, old_chunk))
    written = token_chunks.write_chunks(corpus.cut_chunks(sources.rechunk(slices, old_chunk), new_chunk, tokens="tokens"), folder)
    return corpus.manifest_of(written, scalar.BYTE_EOS, new_chunk, 0)


def fleet_metrics(lines: DataFrame, role: str = "host", flop: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Latest gauges and durations, error counters and the busiest labels of each label metric, of log lines (``value`` and the role column).

    Lines that mark begin and end of a round become durations (``ar_time``, ``grad_accum_time``, ``state_ar_time``) or an error.
    ``flop`` (per example ``forward``, ``backward``; perhaps ``peak``, ``hw_forward``, ``hw_backward`` and ``interval_s``) gives
    the gauge ``flop``, PFLOP so far as of the last report, and with ``peak`` the utilisations ``mfu`` and ``hfu``.
    """
    parsed = telemetry.parse_lines(lines).withColumnRenamed(role, "role")
    metrics = telemetry.extract_metrics(parsed)
    marks = metrics.where("kind = 'event'").select("role", "ts", "name", F.col("value").cast("long").alias("epoch"))
    cycles = telemetry.epoch_cycle_times(marks.where("name in ('ar_begin', 'ar_transition')").select("role", F.regexp_replace("name", "^ar_", "").alias("event"), "epoch", "ts"), "role")
    # A transition before any begin is no missed round.
    first = marks.where("name = 'ar_begin'").groupBy("role").agg(F.min("ts").alias("_first"))
    cycles = cycles.join(first, "role").where("ts >= _first").drop("_first")
    averaging = telemetry.pair_intervals(marks.where("name in ('state_ar_start', 'state_ar_end')"), ["role"], F.col("name") == "state_ar_start", F.col("name") == "state_ar_end", ("ts", "name"))
    columns = ["role", "ts", "kind", "name", "value"]
    told = metrics.select(*columns).unionByName(cycles.select("role", F.col("ts").cast(dict(metrics.dtypes)["ts"]).alias("ts"), "kind", "name", "value"))
    told = told.unionByName(averaging.select("role", "ts", F.lit("duration").alias("kind"), F.lit("state_ar_time").alias("name"), F.col("ms").cast("double").alias("value")))
    if flop:
        told = told.unionByName(work_metrics(parsed, flop).select("role", F.col("ts").cast(dict(metrics.dtypes)["ts"]).alias("ts"), F.lit("gauge").alias("kind"), "name", "value"))
    return telemetry.latest_gauges(told.where("kind in ('gauge', 'duration')")), telemetry.error_counters(told.where("kind = 'error'")), telemetry.bounded_labels(told)


def work_metrics(parsed: DataFrame, flop: dict[str, float]) -> DataFrame:
    """``role, ts, name, value``: cumulative ``flop`` (PFLOP) per report, and ``mfu`` and ``hfu`` windows where a ``peak`` is given."""
    along = Window.partitionBy("role").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    out = telemetry.flop_flushes(parsed, ["role"], flop).select("role", "ts", F.lit("flop").alias("name"), F.sum("value").over(along).alias("value"))
    work = telemetry.worked_examples(parsed)
    for name, prefix in (("mfu", ""), ("hfu", "hw_")) if "peak" in flop else ():
        if f"{prefix}forward" in flop:
            cost = F.when(F.col("direction") == "forward", flop[f"{prefix}forward"]).otherwise(flop[f"{prefix}backward"])
            used = work.select("role", F.col("ts").cast("timestamp").alias("ts"), (F.col("examples") * cost / flop.get("interval_s", 60.0) / flop["peak"]).alias("value"))
            out = out.unionByName(telemetry.utilisation_windows(used, "role").select("role", F.col("closed").cast(dict(out.dtypes)["ts"]).alias("ts"), F.lit(name).alias("name"), F.col("total").alias("value")))
    return out


# What a fleet's hosts are watched for.
ALERT_RULES: tuple[dict, ...] = (
    {"name": "accumulate", "pattern": r"accumulated (-?\d+) samples for epoch", "action": "track_activity", "timeout": 3600.0},
    {"name": "connection_error", "pattern": r"^(?!.*Metadata Store)(?!.*push metrics).*Connection refused", "action": "terminate"},
    {"name": "cuda_error", "pattern": r"CUDA error", "action": "terminate"},
    {"name": "trainerless_data_stream_failure", "pattern": r"\[W2WInject\] data stream failed:", "action": "terminate"},
    {"name": "error_in_grads", "pattern": r"Encountered incorrect value in grads", "action": "terminate"},
    {"name": "ar_state_success", "pattern": r"Averaged parameters with (\d+) peers", "action": "reset_counters", "resets": ["ar_state_timeout", "averaging_size_mismatch"]},
    {"name": "ar_state_timeout", "pattern": r"Averaging parameters failed with <class 'TimeoutError'>|Averaging step failed: could not find a group", "action": "windowed_count", "threshold": 2, "window": 3},
    {
        "name": "averaging_size_mismatch",
        "pattern": r"Error in auto step: The size of tensor a \(\d+\) must match the size of tensor b \(\d+\)|shape mismatch: value tensor of shape \[\d+\] cannot be broadcast to indexing result of shape \[\d+\]",
        "action": "windowed_count",
        "threshold": 2,
        "window": 2,
    },
    {"name": "handler_liveness_ok", "pattern": r"\[HandlerLiveness\] stale: 0", "action": "reset_counters", "resets": ["handler_stale"]},
    {"name": "handler_stale", "pattern": r"\[HandlerLiveness\] stale: [1-9]", "action": "windowed_count", "threshold": 3, "window": 3},
    {"name": "ram_mem_usage", "pattern": r"Used RAM mem is (\d+\.\d+)", "action": "threshold", "above": 0.9},
    {"name": "server_start", "pattern": r"Server started with", "action": "set_started"},
    {"name": "global_epoch_refresh_failure", "pattern": r"Timed out waiting for global progress update", "action": "terminate"},
)


def fleet_alerts(lines: DataFrame, rules: Sequence[dict] = ALERT_RULES, role: str = "host") -> DataFrame:
    """``role, ts, rule, value`` alerts of log lines (``value`` and the role column): the batch form of ``streaming.jobs.stream_alerts``.

    Lines without time can't be placed and are left out.  Where the reference ends a process there is a row, and the host goes on.
    """
    from corpusloom.streaming.jobs import alert_fold

    def step(state: dict | None, rows: pa.RecordBatch) -> tuple[dict, list]:
        state, out = state if state is not None else {}, []
        for us, line in zip(rows.column("us").to_pylist(), rows.column("line").to_pylist(), strict=True):
            out += [(us, name, value) for name, value in alert_fold(list(rules), state, line, us / 1e6)]
        return state, [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.float64()))]

    rows = telemetry.parse_lines(lines).select(F.col(role).alias("role"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "line").where("us is not null")
    return ordered_fold(rows, "role", ["us", "line"], step, "us long, rule string, value double").select("role", F.timestamp_micros("us").alias("ts"), "rule", "value")


def average_vectors(sent: DataFrame, local: DataFrame, by: Sequence[str], weight: str = "weight", vec: str = "embedding") -> DataFrame:
    """Local vectors moved by (mean of what was sent - local); rows that are not finite and groups without weight change nothing."""
    means = vectors.weighted_vector_mean(vectors.finite_rows(sent, vec), list(by), vec, F.col(weight))
    own = F.transform(vec, lambda x: x.cast("double"))
    mean = F.zip_with(F.coalesce("mean", own), own, lambda m, x: F.coalesce(m, x))
    return local.join(means, list(by), "left").withColumn(vec, vectors.delta_update(own, own, mean)).drop("mean")


def average_vectors_by_parts(sent: DataFrame, local: DataFrame, owners: DataFrame, lost: DataFrame, part_size: int, by: Sequence[str], vec: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Average vectors part by part, where senders and owners may fail: local vectors moved by the means, and what came through.

    ``sent``: ``by, sender, weight, vec``; ``local``: ``by, vec``; ``owners``: ``by, owner, fraction``, each of whom averages the
    parts that lie most in its share; ``lost``: ``by, owner, sender``, deliveries that failed, with a null sender for an owner that failed
    altogether.  A part whose owner failed, or that has no weight, keeps the local value.  Senders whose vector is not finite,
    or has another length than the local one, send nothing.

    Second result: per ``by`` the deliveries that were expected and received, and their fraction.
    """
    keys = list(by)
    mine = local.select(*keys, F.col(vec).cast("array<double>").alias("_v"))
    # Part sizes follow from the local vector, and so do owners.
    own = vectors.split_parts(mine, part_size, "_v")
    owned = stored(vectors.assign_parts(own.select(*keys, "part_index", F.size("part").alias("n")), owners, keys).select(*keys, "part_index", "owner"))
    fit = vectors.finite_rows(sent, vec).join(mine.select(*keys, F.size("_v").alias("_n")), keys).where(F.size(vec) == F.col("_n"))
    parts = vectors.split_parts(fit.select(*keys, "sender", "weight", F.col(vec).cast("array<double>").alias("_v")), part_size, "_v").join(owned, [*keys, "part_index"])
    down = lost.where("sender is null").select(*keys, "owner").distinct()
    missed = lost.where("sender is not null").select(*keys, "owner", "sender").distinct()
    came = parts.join(down, [*keys, "owner"], "left_anti").join(missed, [*keys, "owner", "sender"], "left_anti")
    means = vectors.weighted_vector_mean(came, [*keys, "part_index"], "part", F.col("weight"))
    kept = own.join(means, [*keys, "part_index"], "left").withColumn("_new", vectors.or_local(F.zip_with(F.coalesce("mean", "part"), "part", lambda m, x: F.coalesce(m, x)), F.col("part")))
    whole = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("part_index", "_new"))).alias("_p")).select(*keys, F.flatten(F.transform("_p", lambda p: p["_new"])).alias("_new"))
    met = mine.join(whole, keys, "left").withColumn("_new", F.coalesce("_new", "_v"))
    moved = met.select(*keys, vectors.delta_update(F.col("_v"), F.col("_v"), F.col("_new")).alias(vec))
    expected = sent.select(*keys, "sender").distinct().join(owned, keys).select(*keys, F.col("part_index").alias("part"), "sender")
    received = came.select(*keys, F.col("part_index").alias("part"), "sender")
    return moved, vectors.expected_vs_received(expected, received, keys)
