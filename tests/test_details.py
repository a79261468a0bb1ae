"""Folds, records of two kinds, long vectors, averaging by parts, log records of several lines, and whole fleet jobs."""

import hashlib
import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom import session
from corpusloom.functions import scalar
from corpusloom.operators import corpus, records, samples, telemetry, vectors
from corpusloom.plans import jobs, vector_queries
from corpusloom.sources import documents as src
from test_telemetry import plan_of, ts


def plain_phases(stale, phase1, phase2):
    phase = left = 0
    for late in stale:
        if phase == 0 and late:
            phase, left = 1, phase1
        elif phase and left == 0:
            phase, left = (2, phase2) if phase == 1 and phase2 > 0 else (0, 0)
        left = max(0, left - 1) if phase else 0
        yield phase


@pytest.mark.parametrize("phase1, phase2", [(2, 3), (1, 0), (0, 2), (50, 1)])
def test_phases_of_any_peer(spark, phase1, phase2):
    """Several Arrow batches a peer, peers of any length, null epochs."""
    rng = random.Random(phase1)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), i, rng.choice([0, 0, 0, None, 5]), rng.choice([0, 3, 9])) for i in range(1500)]
    df = spark.createDataFrame(rows, "peer string, step long, local long, remote long").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    out = telemetry.phase_timeline(df, phase1, phase2, 6)
    assert "FlatMapGroupsInPandas" not in plan_of(out)
    got = {(r.peer, r.step): r.phase for r in out.collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for peer in ("hot", "a", None):
        own = [r for r in rows if r[0] == peer]
        want = plain_phases([r[2] is not None and r[3] - r[2] > 6 for r in own], phase1, phase2)
        assert [got[peer, r[1]] for r in own] == list(want)
    assert len(got) == len(rows)


def plain_entries(log, now):
    held = {}
    for key, subkey, value, expiration, arrival in sorted(log, key=lambda r: (r[4], r[1] is not None, r[1] or "", r[2])):
        if expiration < arrival:
            continue
        kind, content, most = held.get(key, (None, None, None))
        if subkey is None:
            if most is None or expiration > most:
                held[key] = ("plain", value, expiration)
        elif kind == "map":
            if subkey not in content or expiration > content[subkey][1]:
                content[subkey] = (value, expiration)
            held[key] = ("map", content, max(most, expiration))
        elif most is None or expiration > most:
            held[key] = ("map", {subkey: (value, expiration)}, expiration)
    out = {}
    for key, (kind, content, most) in held.items():
        if kind == "map":
            content = {s: v for s, (v, e) in content.items() if e > now}
        if content and most > now:
            out[key] = (kind, content)
    return out


def test_plain_values_and_maps_compete(spark):
    rng = random.Random(4)
    log, at = [], 0
    for key in range(80):
        only = rng.choice([None, None, "plain", "map"])
        for _ in range(rng.randint(1, 14)):
            at += 1
            plain = only == "plain" or (only is None and rng.random() < 0.4)
            log.append((f"k{key}", None if plain else rng.choice("ab"), f"v{at}", ts(at + rng.randint(-2, 60)), ts(at)))
    now = ts(at - 200)
    df = spark.createDataFrame(log, "key string, subkey string, value string, expiration timestamp, arrival timestamp").repartition(4)
    got = {r.key: ("map", r.value) if r.plain is None else ("plain", r.plain) for r in records.latest_entries(df, F.lit(now)).collect()}
    want = plain_entries(log, now)
    assert got == want and {k for k, _ in want.values()} == {"plain", "map"}
    assert records.latest_entries(df.where("false"), F.lit(now)).isEmpty()


def test_quantiles_of_quantiles_of_a_long_vector(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 3, 250_000)
    df = spark.createDataFrame([(1, x.tolist()), (2, [3.0, 1.0, 2.0]), (3, [5.0])], "vec_id long, embedding array<double>")
    codes, book = vectors.quantize_vectors8(df)
    width = 100_000 + (50_000 - 1) // 2 + 1
    shares = np.linspace(0, 1, 257)
    cuts = np.quantile(np.array([np.quantile(x[k : k + width], shares) for k in range(0, len(x), width)]), shares)[1:-1]
    table = codes.where("vec_id = 1").toPandas().sort_values("pos")
    assert np.array_equal(table["x"].to_numpy(), x)
    want = np.searchsorted(cuts, x, "left")
    differs = np.flatnonzero(table["code"].to_numpy() != want)
    # Only values at a border may fall to either side, by rounding.
    assert len(differs) <= 2 and all(np.min(np.abs(cuts - x[i])) < 1e-9 for i in differs)
    assert {(r.vec_id, r.pos): r.code for r in codes.where("vec_id > 1").collect()} == {(2, i): int(np.searchsorted(np.quantile([3.0, 1.0, 2.0], shares)[1:-1], v, "left")) for i, v in enumerate([3.0, 1.0, 2.0])} | {(3, 0): 0}
    assert book.agg(F.sum("n")).first()[0] == 250_004


def test_averaging_with_failures(spark):
    rng = np.random.default_rng(8)
    local = {g: rng.normal(size=n) for g, n in (("g", 23), ("h", 5), ("alone", 4))}
    sent = [(g, s, float(s), rng.normal(size=len(local[g])).tolist()) for g in ("g", "h") for s in range(4)]
    sent += [("g", 7, 1.0, [float("nan")] * 23), ("g", 8, 1.0, [1.0])]
    owners = [(g, o, f) for g in local for o, f in (("a", 0.5), ("b", 0.5))]
    lost = [("g", "b", None), ("g", "a", 2), ("h", "a", 1), ("h", "a", 2), ("h", "a", 3)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    moved, came = jobs.average_vectors_by_parts(frame(sent, "g string, sender long, weight double, embedding array<double>"), frame([(g, v.tolist()) for g, v in local.items()], "g string, embedding array<double>"), frame(owners, "g string, owner string, fraction double"), frame(lost, "g string, owner string, sender long"), 4, ["g"])
    got = {r.g: np.array(r.embedding) for r in moved.collect()}
    by = {(g, s): np.array(v) for g, s, _, v in sent}
    # Parts 0 to 2 of g lie in a's half (12 of 23 elements); b is down, so the rest stays.
    mean = (1 * by["g", 1] + 3 * by["g", 3]) / 4
    assert np.allclose(got["g"][:12], mean[:12]) and np.allclose(got["g"][12:], local["g"][12:])
    # In h, only the sender without weight reached a: nothing changes there; b has the last element.
    assert np.allclose(got["h"][:4], local["h"][:4]) and np.allclose(got["h"][4:], (by["h", 1] + 2 * by["h", 2] + 3 * by["h", 3])[4:] / 6)
    assert np.allclose(got["alone"], local["alone"])
    assert {r.g: (r.expected, r.received) for r in came.collect()} == {"g": (36, 9), "h": (8, 5)}


def test_records_of_several_lines(spark, tmp_path):
    """Tracebacks stay with their record, also where a file is read in splits of a few bytes."""
    at = "2026-01-01 00:00:{:02d},000 - {} - {}"
    logs = ["lost line\n", at.format(1, "INFO", "one\n"), at.format(2, "ERROR", "bad\nTraceback:\n  File x\n\n    raise\nTimeoutError()\n"), at.format(3, "INFO", "last\n"), "\n"]
    for k in range(3):
        (tmp_path / f"{k}.log").write_text("".join(logs) * 20)
    (tmp_path / "empty.log").write_text("")
    want = sorted(["lost line"] + [x.rstrip("\n") for x in [*logs[1:3], at.format(3, "INFO", "last\n\nlost line")] * 19] + [logs[1].rstrip(), logs[2].rstrip(), at.format(3, "INFO", "last")])
    for size in ("128m", "200b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        got = sorted(r.value for r in src.scan_log_lines(spark, str(tmp_path)).collect())
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
        assert got == sorted(want * 3)
    errors = telemetry.extract_metrics(telemetry.parse_lines(src.scan_log_lines(spark, str(tmp_path)).where("value like '%ERROR%'"))).collect()
    assert len(errors) == 60 and all("TimeoutError" in r.line and r.name == "error_unknown" for r in errors)
    query = src.scan_log_lines(spark, str(tmp_path), streaming=True).writeStream.format("memory").queryName("records_of_lines").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r.value for r in spark.table("records_of_lines").collect()) == sorted(want * 3)


def test_lines_of_files_have_a_caller(spark):
    lines = ["Nov 28 14:33:02.123 [WARNING] [mod.fn:12] odd\nmore", "Nov 28 14:33:02.123 [INFO] [GhostPhase] phase: 1", "2026-01-01 00:00:00,000 - INFO - [GhostPhase] phase: 1", "free text"]
    out = telemetry.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"), year=2025).collect()
    assert [(r.level, r.caller, r.msg) for r in out] == [("WARNING", "mod.fn:12", "odd\nmore"), ("INFO", None, "[GhostPhase] phase: 1"), ("INFO", None, "[GhostPhase] phase: 1"), (None, None, "free text")]
    assert [str(r.ts) for r in out[:3]] == ["2025-11-28 14:33:02.123000", "2025-11-28 14:33:02.123000", "2026-01-01 00:00:00"]
    assert telemetry.parse_lines(spark.createDataFrame([(lines[0],)], "value string")).first().ts is None


def test_a_fleet_in_whole(spark):
    """Labels have one set a metric, failed pushes their told totals; rounds, work and utilisation come out."""
    texts = [f"WARNING - Banned expert b{k}.0 reason=timeout duration=1s" for k in range(4) for _ in range(2)]
    send = "INFO - [W2WSend] entries: 1, accepted_forward: 2, accepted_backward: 3, busy: 4, forward_pushes: 5, backward_pushes: 6, busy_retries: 7, drops: 8, push_errors: 9, per_target: a.1={} a.2=3"
    work = "INFO - body1.0.7_{}: 28 batches (0.47 s/batch), {} examples (0.93 s/example), avg batch size 2.00, avg batch await time 12ms"
    texts += [send.format(500), send.format(400), "INFO - Transitioning to epoch 9", "INFO - Beginning optimizer step #41", "INFO - Transitioning to epoch 42", "INFO - Beginning optimizer step #42", "INFO - Transitioning to epoch 50"]
    texts += [work.format("forward", 50), work.format("backward", 10), "INFO - Processed 28 batches in last 60 seconds:", "INFO - Processed 0 batches in last 60 seconds:", work.format("forward", 4), "INFO - Processed 1 batches", work.format("forward", 1)]
    texts += ["INFO - All-reduce round started at local epoch #3", "INFO - All-reduce round started at local epoch #4", "INFO - All-reduce round finished at local epoch #4"]
    rows = [("h", f"2026-01-01 00:{i // 30:02d}:{i * 2 % 60:02d},000 - {x}") for i, x in enumerate(texts)]
    flop = {"forward": 1e15, "backward": 2e15, "peak": 1e15, "hw_forward": 2e15, "hw_backward": 3e15, "interval_s": 10.0}
    gauges, errors, labels = jobs.fleet_metrics(spark.createDataFrame(rows, "host string, value string"), flop=flop)
    assert {(r.metric, r.name, r.n, r["rank"]) for r in labels.collect()} == {
        ("ban", "ban_timeout_b3.0", 2, 1), ("ban", "ban_timeout_b2.0", 2, 2), ("ban", "ban_timeout_b1.0", 2, 3), ("w2w_push_fail", "w2w_push_fail_a.1", 400, 1), ("w2w_push_fail", "w2w_push_fail_a.2", 3, 2),
    }
    got = {r.name: r.value for r in gauges.collect()}
    assert got["ar_time"] == 2000 and got["grad_accum_time"] == 2000 and got["state_ar_time"] == 2000 and got["flop"] == 74
    # The window from the first work line closes at the line 8 s later: 50 and 10 examples in it.
    assert np.isclose(got["mfu"], (50 + 2 * 10) / 10) and np.isclose(got["hfu"], (2 * 50 + 3 * 10) / 10)
    assert {r.name: r.total for r in errors.collect()} == {"error_missed_ar_step": 1}


def test_small_helpers(spark):
    docs = spark.createDataFrame([("c", f"d{i}", "x") for i in range(50)], "crawl string, doc_id string, text string")
    keys = [r.key for r in corpus.global_shuffle(corpus.doc_key(docs).repartition(4)).collect()]
    assert keys == sorted(keys) and len(set(keys)) == 50
    assert corpus.transforms_digest([("whitespace_normalize", 1)]) == scalar.canonical_digest([{"name": "whitespace_normalize", "version": 1}]) != corpus.transforms_digest([])
    layout = samples.chunk_layout(spark.createDataFrame([(0, 9), (1, 9), (3000, 3)], "chunk_id long, tokens long"), 2)
    assert {tuple(r) for r in layout.collect()} == {(0, 4, 4), (1, 4, 8), (3000, 1, 9)}
    permutation = samples.permutation_by_hash(layout, 1, 0)
    windows = spark.range(8).select(F.col("id").alias("g"), F.array(F.col("id")).alias("tokens"))
    got = samples.samples_for_ids(samples.range_ids(spark, 0, 8), permutation.where("chunk_id < 2"), windows, F.lit(8), 4).collect()
    assert sorted(r.sample_id for r in got) == list(range(8)) and sorted(r.g for r in got) == list(range(8))
    assert [r.sample_id for r in samples.stream_batches(spark, 1, 4, 2, 2, 11).orderBy("sample_id").collect()] == [1, 5, 9]
    row = spark.createDataFrame([([1.0], [2.0]), (None, [3.0])], "a array<double>, b array<double>").select(vectors.or_local(F.col("a"), F.col("b")).alias("x"), vectors.or_local(F.col("a"), F.col("b"), True).alias("y")).collect()
    assert [(r.x, r.y) for r in row] == [([1.0], [1.0]), ([3.0], [0.0])]


def test_batches_of_a_shard_roll_over(spark):
    total, shards = 23, spark.createDataFrame([(s,) for s in range(4)], "shard long")
    out = samples.shard_epochs(F.lit(total), shards, 1, 8, 3, 3).orderBy("shard", "turn").collect()
    want = []
    for s in range(3):
        low, high, turn = s * 8, min((s + 1) * 8, total), 0
        for epoch in range(3):
            for first in range(low, high, 3):
                want.append((s, epoch, turn, epoch * total + first, epoch * total + min(first + 3, high)))
                turn += 1
    assert [tuple(r) for r in out] == want
    assert [r.sample_id for r in samples.legacy_batch(spark, 2, 3).collect()] == [6, 7, 8]


def test_chain_of_validators(spark):
    import hashlib

    sign = lambda key, text, secret="s": text + "[signature:" + hashlib.sha256(f"{secret}\0{key}\0{text}".encode()).hexdigest() + "]"
    good = '{"a": 1}'
    rows = [("p1", sign("p1", good)), ("p2", sign("p1", good)), ("p3", good), ("p4", sign("p4", '{"a": "1"}')), ("q", sign("q", good)), ("p5", None), ("p6", sign("p6", good, "other"))]
    chain = [records.signature_validator("s", "key"), records.owner_validator("key", "^p"), records.schema_validator({"a": "BIGINT"})]
    passed, failed = records.run_validators(spark.createDataFrame(rows, "key string, value string"), chain)
    assert [tuple(r) for r in passed.collect()] == [("p1", good)]
    assert {r.key: r.failed for r in failed.collect()} == {"p2": "signature", "p3": "signature", "p4": "schema", "q": "owner", "p5": "signature", "p6": "signature"}


def test_links_and_weights_and_pins(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/sub/a.jsonl").write_text('{"id": "1", "text": "x"}')
    assert [r.name for r in src.list_inventory(spark, str(tmp_path / "in")).collect()] == ["sub/a.jsonl"]
    (tmp_path / "out.jsonl").write_text("{}")
    (tmp_path / "in/b.jsonl").symlink_to(tmp_path / "out.jsonl")
    with pytest.raises(Exception, match="symbolic link"):
        src.list_inventory(spark, str(tmp_path / "in")).collect()
    row = spark.createDataFrame([([1, 2, 3],)], "t array<int>").select(scalar.shift_labels(F.col("t"), 4).alias("s")).first().s
    assert (list(row.inputs), list(row.labels), row.weight) == ([1, 2], [2, 3], 0.125)
    (tmp_path / "t.json").write_text("{}")
    with pytest.raises(Exception, match="recipe pins"):
        corpus.tokenize_with(spark.createDataFrame([("x",)], "text string"), str(tmp_path / "t.json"), sha256="0" * 64).collect()
    one = jobs.Recipe(tokenizer=str(tmp_path / "t.json"), eos=2).sha256
    (tmp_path / "t.json").write_text("[]")
    assert jobs.Recipe(tokenizer=str(tmp_path / "t.json"), eos=2).sha256 != one


def test_rechunking(spark, tmp_path):
    tokens = np.arange(1000, dtype="<i4")
    files = []
    for k in range(0, 1000, 100):
        part = tokens[k : k + 101]
        (tmp_path / f"{k:04d}.bin").write_bytes(part.tobytes())
        files.append((k // 100, f"file://{tmp_path}/{k:04d}.bin", 4 * len(part)))
    inventory = spark.createDataFrame(files, "ordinal long, path string, size long")
    manifest = jobs.rechunk_corpus(spark, inventory, 100, 64, f"file://{tmp_path}/new")
    assert manifest["total_tokens"] == 1000 and len(manifest["chunks"]) == 16
    whole = b"".join((tmp_path / "new" / c["name"]).read_bytes()[: 4 * 64] for c in manifest["chunks"])
    assert whole == tokens.tobytes()
    (tmp_path / "0300.bin").write_bytes((tokens[300:401] + 5).astype("<i4").tobytes())
    with pytest.raises(ValueError, match="overlap"):
        jobs.rechunk_corpus(spark, inventory, 100, 64, f"file://{tmp_path}/other")


def test_parts_meet_their_owners_unmultiplied(spark, data_dir):
    """Parts in an order of several columns go where a plain loop sends them; no row per part and owner is sorted or shuffled."""
    rng = random.Random(5)
    parts = [(g, a, b, rng.randint(0, 9)) for g in "xyz" for a in range(6) for b in range(3)]
    owners = {"x": [("a", 0.5), ("b", 0.25), ("c", 0.25)], "y": [("b", 0.1), ("a", 0.3), ("d", 0.6)]}
    want = []
    for g, shares in owners.items():
        own, shares = sorted(p for p in parts if p[0] == g), sorted(shares)
        total, start, ranges, share = sum(p[3] for p in own), 0, [], 0.0
        for i, (o, f) in enumerate(shares):
            low, share = math.floor(share * total + 1e-9), share + f
            ranges.append((o, low, total if i == len(shares) - 1 else math.floor(share * total + 1e-9)))
        for p in own:
            want.append((*p, min((-max(0, min(start + p[3], high) - max(start, low)), o) for o, low, high in ranges)[1]))
            start += p[3]
    given = spark.createDataFrame([(g, o, f) for g, s in owners.items() for o, f in s], "g string, owner string, fraction double")
    out = vectors.assign_parts(spark.createDataFrame(rng.sample(parts, len(parts)), "g string, a long, b long, n long"), given, ["g"], ["a", "b"])
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert session.dealt(spark.range(4_000_000), 4_000_000, 250_000, "id").rdd.getNumPartitions() == 16
    plan = plan_of(vector_queries.q_assign_parts(spark, data_dir))
    assert "SortAggregate" not in plan and "REPARTITION_BY_NUM" in plan


def test_scaling_takes_time_in_proportion(spark):
    """Mean and deviation are computed once a vector: with them computed anew for each element, 2000 elements take minutes."""
    x = np.random.default_rng(3).normal(3, 2, 2000).astype(np.float32)
    df = spark.createDataFrame([(0, x.tolist()), (1, []), (2, None), (3, [2.0, 2.0])], "i long, e array<float>")
    began = time.monotonic()
    out = {r.i: r.v for r in df.select("i", vectors.scale_meanstd(F.col("e")).alias("v")).collect()}
    assert time.monotonic() - began < 60
    wide = x.astype(np.float64)
    assert np.allclose(out[0], (wide - wide.mean()) / wide.std(), rtol=0, atol=1e-9)
    assert out[1] == [] and out[2] is None and out[3] == [0.0, 0.0]


def test_tokens_are_made_by_pieces(monkeypatch):
    """A batch of any size leaves in pieces of few bytes beyond their first text, in order, nulls and empty texts in their places."""
    monkeypatch.setattr(scalar, "PIECE", 100)
    rng = random.Random(9)
    texts = [None, "", *("é" * rng.choice((0, 3, 20, 30, 400)) for _ in range(300)), None]
    batches = [pa.array(texts, pa.string()), pa.array(["x", *texts], pa.string()).slice(1), pa.array([], pa.string()), pa.array([None], pa.string())]
    want = [None if t is None else [b + 16 for b in t.encode()] for t in [*texts, *texts, None]]
    out = list(scalar._byte_tokens.func(iter(batches)))
    assert [x for piece in out for x in piece.to_pylist()] == want
    assert all(sum(n or 0 for n in piece.value_lengths().to_pylist()[1:]) < 100 for piece in out) and len(out) > 100
    hashed = [x for piece in scalar._hashed_byte_tokens.func(iter(batches)) for x in piece.to_pylist()]
    assert [h["tokens"] for h in hashed] == want
    assert [h["sha256"] for h in hashed] == [None if w is None else hashlib.sha256(bytes(x - 16 for x in w).hex().upper().encode()).hexdigest() for w in want]
