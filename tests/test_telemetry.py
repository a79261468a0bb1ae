"""Line families, ordered folds, vectors, socket dumps and streaming twins."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import records, telemetry, vectors
from corpusloom.sources import documents as src
from corpusloom.streaming import jobs

AT = "2026-01-01 00:00:00,000"
LINES = {
    f"{AT} - INFO - train loss = 2.31, num batches process = 64, internal trainer step = 12": {("gauge", "head_batches", 64), ("gauge", "head_loss", 2.31)},
    f"{AT} - INFO - train loss = 0.0, num batches process = 3": {("gauge", "head_batches", 3)},
    f"{AT} - INFO - total_tokens_processed = 262144": {("gauge", "head_total_tokens", 262144)},
    f"{AT} - INFO - Banned expert body1.0.7 reason=timeout duration=3600s": {("label", "ban_timeout_body1.0.7", 1)},
    f"{AT} - INFO - TCP retransmit: 5 of 1000 segs retransmitted (0.500%) cc=bbr": {("gauge", "tcp_retrans_segs", 5), ("gauge", "tcp_out_segs", 1000), ("gauge", "tcp_retrans_pct", 0.5), ("gauge", "cc_default_bbr", 1)},
    f"{AT} - INFO - TCP peers: n=3 rtt_p50_ms=10.00 rtt_p95_ms=- retrans_total=7 delivery_rate_p50_mbps=90.00 delivery_rate_min_mbps=-": {("gauge", "tcp_peer_count", 3), ("duration", "tcp_peer_rtt_p50", 10), ("gauge", "tcp_peer_retrans_total", 7), ("gauge", "tcp_peer_delivery_p50", 90)},
    f"{AT} - INFO - [HandlerLiveness] stale: 1, ages_s: 0.1/65.0/0.2": {("gauge", "handler_stale_count", 1), ("gauge", "handler_max_age_s", 65)},
    f"{AT} - INFO - Beginning optimizer step #41": {("gauge", "step", 41), ("event", "ar_begin", 41)},
    f"{AT} - INFO - Transitioning to epoch 42": {("event", "ar_transition", 42)},
    f"{AT} - INFO - body1.0.7_forward: 28 batches (0.47 s/batch), 56 examples (0.93 s/example), avg batch size 2.00, avg batch await time 12ms": {("gauge", "forward_batches", 28), ("gauge", "avg_batch_size", 2), ("duration", "batch_await_time", 12)},
    f"{AT} - ERROR - something unexpected": {("error", "error_unknown", 1)},
    f"{AT} - ERROR - Failed to load state from peers\nTimeoutError()": {("error", "error_loadtimeout", 1)},
    f"{AT} - INFO - Sent 3.5 and Rcv 1.5": {("gauge", "send_comm", 3.5), ("gauge", "recv_comm", 1.5), ("gauge", "tot_comm", 5)},
    f"{AT} - INFO - see 4 of head.": {("gauge", "peer_vis_head", 4)},
    f"{AT} - INFO - [Metadata Store Client Stats] Last 60s - requests: 5, mean_latency: 1.5ms, max_latency: 9.0ms, failures: 1, retries: 2": {("gauge", "ms_client_requests", 5), ("duration", "ms_client_mean_latency", 1.5), ("duration", "ms_client_max_latency", 9), ("gauge", "ms_client_failures", 1), ("gauge", "ms_client_retries", 2), ("gauge", "ms_client_rejects", 0), ("gauge", "ms_client_dropped_expired", 0)},
    f"{AT} - INFO - [W2WSend] entries: 1, accepted_forward: 2, accepted_backward: 3, busy: 4, forward_pushes: 5, backward_pushes: 6, busy_retries: 7, drops: 8, push_errors: 9, per_target: body1.0.1=3 tail.0=4": {
        *(("gauge", f"w2w_send_{n}", i + 1) for i, n in enumerate(("entries", "accepted_forward", "accepted_backward", "busy", "forward_pushes", "backward_pushes", "busy_retries", "drops", "push_errors"))),
        ("label", "w2w_push_fail_body1.0.1", 3),
        ("label", "w2w_push_fail_tail.0", 4),
    },
    f"{AT} - INFO - Averaging gradients failed with TimeoutError()": {("gauge", "grad_avg_timeout", 1), ("gauge", "grad_avg_groupsize", 0)},
    f"{AT} - INFO - Averaged gradients with 5 peers": {("gauge", "grad_avg_groupsize", 5), ("gauge", "grad_avg_timeout", 0)},
    f"{AT} - INFO - Formed group with 3 peers out of 8 in 2.5 secs": {("gauge", "formed_groupsize", 3), ("gauge", "max_groupsize", 8), ("gauge", "mm_time", 2.5)},
    f"{AT} - WARNING - Failed to receive tensors from peer x: 2 failures, reason=timeout": {("error", "ar_peer_failure_timeout", 1)},
    f"{AT} - INFO - AR yield blocked 1.5s for sender 3 (inbound_qsize=4/9)": {("duration", "ar_yield_stall", 1.5), ("gauge", "ar_in_qsize", 4)},
    f"{AT} - INFO - nothing to see here": set(),
}


def ts(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_line_families(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "value string")
    got = {x: set() for x in LINES}
    for r in telemetry.extract_metrics(telemetry.parse_lines(df)).collect():
        got[r.line].add((r.kind, r.name, r.value))
    assert got == LINES


def test_every_rule_has_its_hint():
    for rule in telemetry.RULES:
        bare = rule.pattern.replace("\\", "")
        assert all(part in bare for part in rule.hint.split())


def fold_rounds(rows):
    begin = trans = None
    for at, event, epoch in rows:
        if event == "begin":
            if trans and trans[0] == epoch:
                yield "grad_accum_time"
            begin = (epoch, at)
        elif begin and begin[0] + 1 == epoch:
            yield "ar_time"
            trans = (epoch, at)
        else:
            yield "error_missed_ar_step"
            begin = trans = None


def test_rounds_and_windows(spark):
    rows = [(0, "begin", 41), (3.5, "transition", 42), (5, "begin", 42), (9, "transition", 43), (10, "transition", 50), (11, "begin", 50), (12, "transition", 51)]
    df = spark.createDataFrame([("h", ts(a), e, k) for a, e, k in rows], "host string, ts timestamp, event string, epoch long")
    out = telemetry.epoch_cycle_times(df).orderBy("ts").collect()
    assert [r.name for r in out] == list(fold_rounds(rows))
    assert out[0].value == 3500 and out[1].value == 1500
    use = spark.createDataFrame([("h", ts(a), float(v)) for a, v in ((0, 1), (5, 2), (5.001, 4), (9, 8), (20, 16))], "host string, ts timestamp, value double")
    assert [r.total for r in telemetry.utilisation_windows(use).orderBy("anchor").collect()] == [3, 12]
    steps = spark.createDataFrame([("p", i, i, i + (9 if i == 2 else 0)) for i in range(8)], "peer string, step long, local long, remote long")
    assert [r.phase for r in telemetry.phase_timeline(steps, 2, 2, 5).orderBy("step").collect()] == [0, 0, 1, 1, 2, 2, 0, 0]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_task_holds_a_host(spark):
    """Random rows of one hot host and others give what plain folds give, and no plan collects or hands over a group."""
    rng = np.random.default_rng(5)
    hosts = ["hot" if rng.random() < 0.6 else f"h{rng.integers(4)}" for _ in range(3000)] + [None] * 30
    at = rng.choice(2_000_000, len(hosts), replace=False)
    rows = [(h, ts(int(a) / 100), "begin" if rng.random() < 0.4 else "transition", int(rng.integers(3)), float(rng.integers(9))) for h, a in zip(hosts, at, strict=True)]
    df = spark.createDataFrame(rows, "host string, ts timestamp, event string, epoch long, value double").repartition(7).cache()
    cycles, use = telemetry.epoch_cycle_times(df.select("host", "ts", "event", "epoch")), telemetry.utilisation_windows(df.select("host", "ts", "value"), span_ms=60_000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    got_cycles, got_use = cycles.collect(), use.collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for host in set(hosts):
        own = sorted(r[1:] for r in rows if r[0] == host)
        want = list(fold_rounds([r[:3] for r in own]))
        assert [r.name for r in sorted((r for r in got_cycles if r.host == host), key=lambda r: r.ts)] == want and len(want) > 5
        begin = trans = None
        times = []
        for t, e, k, _ in own:
            if e == "begin":
                times += [(t - trans[1]).total_seconds() * 1000] if trans and trans[0] == k else []
                begin = (k, t)
            elif begin and begin[0] + 1 == k:
                times.append((t - begin[1]).total_seconds() * 1000)
                trans = (k, t)
            else:
                times.append(1.0)
                begin = trans = None
        assert np.allclose([r.value for r in sorted((r for r in got_cycles if r.host == host), key=lambda r: r.ts)], times)
        anchor, total, sums = None, 0.0, []
        for t, _, _, v in own:
            if anchor is not None and (t - anchor).total_seconds() > 60:
                sums.append((anchor, t, total))
                anchor, total = t, 0.0
            anchor = anchor or t
            total += v
        assert sorted(tuple(r)[1:] for r in got_use if r.host == host) == sums
    assert "FlatMapGroupsInPandas" not in plan_of(cycles) + plan_of(use)
    values = [float("nan"), float("inf"), -float("inf"), -5.0, 0.0, 1e-9, 1e300] + [7.25] * 400 + list(rng.normal(0, 50, 593))
    peers = spark.createDataFrame([("hot", float(v), 1, None if i % 4 == 0 else float(v) * 2) for i, v in enumerate(values)] + [(None, 3.0, 2, None), (None, 1.0, 2, None), ("void", None, 0, None)], "host string, rtt_ms double, retrans int, delivery_mbps double")
    out = telemetry.peer_socket_summary(peers, ["host"])
    near = lambda x, f: sorted(x, key=lambda v: (v != v, v))[min(len(x) - 1, round(f * (len(x) - 1)))]
    got = {r.host: tuple(r)[1:] for r in out.collect()}
    assert got["hot"][:5] == (1000, near(values, 0.5), near(values, 0.95), 1000, near([v * 2 for i, v in enumerate(values) if i % 4], 0.5))
    assert got[None] == (2, 1.0, 3.0, 4, None, None) and got["void"] == (1, None, None, 0, None, None)
    assert "collect_list(rtt_ms" not in plan_of(out)


def test_visible_errors_and_activity(spark):
    df = spark.createDataFrame([("h", f"2026-01-01 00:00:0{i},000 - ERROR - odd {i}") for i in range(5)] + [("h", "ERROR without time")], "host string, value string")
    assert telemetry.error_capture(telemetry.parse_lines(df), 2).count() == 2


def test_registered_peers(spark):
    """Thirteen stages by three phases, then absent and expired records."""
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    for suffix, live in (("", True), ("_ghost1_3", False), ("_ghost2_3", True)):
        rows = [(f"s{k}", f"peer{k}{suffix}", ts(60)) for k in range(13)]
        got = records.live_members(spark.createDataFrame(rows, "stage string, value string, expiration timestamp"), now).count()
        assert got == (13 if live else 0)
    peers = spark.createDataFrame([("a",), ("b",), ("c",)], "peer_id string")
    book, roster = (spark.createDataFrame([(x,)], "peer_id string") for x in ("a", "c"))
    assert sorted(r.peer_id for r in records.already_registered(peers, book, roster).collect()) == ["a", "c"]
    old = spark.createDataFrame([("s", "peer1", ts(-1))], "stage string, value string, expiration timestamp")
    assert records.live_members(old, now).isEmpty()


def test_record_details(spark):
    log = spark.createDataFrame([("k", "s", "first", ts(50), ts(0)), ("k", "s", "equal", ts(50), ts(1)), ("k", "s", "lower", ts(40), ts(2)), ("k", "t", "gone", ts(-9), ts(3))], "key string, subkey string, value string, expiration timestamp, arrival timestamp")
    now = F.lit(ts(0))
    assert [r.value for r in records.latest_records(log, now).collect()] == ["first"]
    assert records.latest_subrecords(log, now).first().value == {"s": "first"}
    rows = spark.createDataFrame([("p", ["/ip/1/p2p/p", "/ip/2/p2p/q"])], "peer_id string, addresses array<string>")
    assert records.own_addresses(rows).first().addresses == ["/ip/1"]
    cand = spark.createDataFrame([("a", "true"), ("b", "false"), ("c", "?")], "peer string, value string")
    assert [r.peer for r in records.group_candidates(cand).collect()] == ["a"] and records.group_candidates(cand, False).count() == 2
    donors = spark.createDataFrame([("x.3", 1), ("x.10", 5), ("odd", None), ("x.2", 5)], "uid string, priority int")
    assert [r.uid for r in records.state_donors(donors, "uid", target="odd", me="x.2").collect()] == ["odd", "x.3", "x.10"]
    assert records.state_donors(donors).first().priority == 5
    with pytest.raises(Exception, match="no tier"):
        tiers = spark.createDataFrame([(5.0, "a")], "threshold double, label string")
        records.tier_lookup(spark.createDataFrame([(1.0,)], "v double"), tiers, "v").collect()


def test_name_lookup_of_any_key(spark):
    """Keys of many words and within words are found as by comparing all pairs; nulls in other columns lose nothing."""
    keys = ["A10", "RTX 4090", "one two three four five six seven eight nine", "eight nine ten", "x", "GB", "RTX 40", "a-10", "tx"]
    names = ["NVIDIA A100 80GB", "a 10", "zero One two-three four five six seven eight NINE ten", "GeForce RTX (4090) D", "rtx4090", "x", "", "??", "Quadro", "seven eight nine ten", None]
    df = spark.createDataFrame([(n, None if i % 2 else i) for i, n in enumerate(names * 2)], "name string, other int")
    plain = lambda x: " ".join("".join(c if c in "0123456789abcdefghijklmnopqrstuvwxyz" else " " for c in x.lower()).split())
    for some in (keys, [*keys, "-"]):
        out = records.name_contains_lookup(df, spark.createDataFrame([(k,) for k in some], "ref_name string"), "name")
        assert out.columns == ["name", "other", "ref_name"]
        want = [(n, None if i % 2 else i, None if n is None else max(((len(plain(k)), k) for k in some if plain(k) in plain(n)), default=(0, None))[1]) for i, n in enumerate(names * 2)]
        assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))


def test_vector_casts_and_quantiles(spark):
    rng = np.random.default_rng(0)
    rows = [(i, 0, [float(x) for x in rng.normal(0, 10, 40).astype(np.float32)]) for i in range(30)] + [(99, 0, [1e30, -1e30, float(np.float32(0.1))])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    out = {r.vec_id: r for r in df.select("vec_id", "embedding", vectors.clamp_fp16("embedding").alias("h"), vectors.round_bf16("embedding").alias("b")).collect()}
    for r in out.values():
        x = np.array(r.embedding, np.float32)
        assert np.array_equal(np.array(r.h, np.float32), np.clip(x, -65504, 65504).astype(np.float16).astype(np.float32))
        assert np.all(np.abs(np.array(r.b) - x) <= np.abs(x) / 256)
    assert vectors.finite_rows(spark.createDataFrame([([1.0, float("nan")],), ([float("inf")],), ([2.0],)], "embedding array<float>")).count() == 1
    codes, book = vectors.quantize_quantile8(df.where("vec_id < 99"), ["label"])
    x = np.concatenate([np.array(r[2], np.float64) for r in rows[:-1]])
    borders = np.quantile(x, np.linspace(0, 1, 257)[1:-1])
    got = {(r.vec_id, r.pos): (r.x, r.code) for r in codes.collect()}
    assert all(code == np.searchsorted(borders, v, "left") for v, code in got.values())
    assert book.agg(F.sum("n")).first()[0] == len(x)


def test_quantile_borders_are_exact(spark, data_dir):
    """Borders equal a plain computation for small, tied, tiny and huge groups, without a buffer of a whole group."""
    rng = np.random.default_rng(3)
    groups = {0: [1.5], 1: [2.0, -2.0], 2: [0.25] * 300 + [0.5], 3: list(rng.normal(0, 1e-6, 700)), 4: list(rng.choice([-1e300, 0.0, 3.0, 1e300], 90)), 5: list(rng.normal(0, 9, 1111))}
    rows = [(g, 100 * g + i, [float(x) for x in xs[i::3]]) for g, xs in groups.items() for i in range(3)]
    df = spark.createDataFrame(rows, "label int, vec_id long, embedding array<double>").repartition(5)
    for borders in (7, 100, 255):
        codes, book = vectors.quantize_quantile8(df, ["label"], borders=borders)
        assert "percentile" not in plan_of(codes)
        got = {g: [] for g in groups}
        for r in codes.collect():
            got[r.label].append((r.x, r.code))
        for g, xs in groups.items():
            x, h = np.sort(xs), (len(xs) - 1) * (np.arange(1, borders + 1) / (borders + 1))
            low, high = x[np.floor(h).astype(int)], x[np.ceil(h).astype(int)]
            cuts = np.sort(np.where(low == high, low, (np.ceil(h) - h) * low + (h - np.floor(h)) * high))
            assert sorted(got[g]) == [(v, int((cuts < v).sum())) for v in x]
    from corpusloom.plans.vector_queries import QUERIES

    assert QUERIES["quantize_quantile8_byte"](spark, data_dir).agg(F.max("code")).first()[0] == 255


def test_socket_dump(spark, tmp_path):
    (tmp_path / "ss.txt").write_text(
        "State Recv-Q Send-Q Local Address:Port Peer Address:Port\nESTAB 0 0 10.0.0.1:5 10.0.0.2:443\n\t cubic rtt:12.5/1 minrtt:10.5 retrans:0/7 delivery_rate 90.5Mbps\n"
        "ESTAB 0 0 127.0.0.1:5 127.0.0.1:9\n\t rtt:0.1/0\nESTAB 0 0 10.0.0.1:6 10.0.0.3:443\n\t rtt:20/1\n"
    )
    got = sorted((r.peer, r.rtt_ms, r.min_rtt_ms, r.retrans, r.delivery_mbps) for r in src.scan_socket_stats(spark, str(tmp_path)).collect())
    assert got == [("10.0.0.2", 12.5, 10.5, 7, 90.5), ("10.0.0.3", 20.0, None, 0, None)]


def run_stream(spark, build, rows, schema, tmp_path, mode, batches=1):
    """Rows through files and a memory sink, in ``batches`` triggers; then one far ahead to push the watermark."""
    folder = tmp_path / "in"
    for k in range(batches):
        spark.createDataFrame(rows[k::batches] if batches == 1 else rows[k * len(rows) // batches : (k + 1) * len(rows) // batches], schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder)))
    name = f"out_{abs(hash(str(tmp_path)))}"
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    query.stop()
    return spark.table(name).collect()


def test_stream_metrics_twin(spark, tmp_path):
    rows = [(x,) for x in LINES]
    got = run_stream(spark, jobs.stream_metrics, rows, "value string", tmp_path, "append")
    assert {(r.line, r.kind, r.name, r.value) for r in got} == {(x, *m) for x, ms in LINES.items() for m in ms}


def test_stream_pool_stats_twin(spark, tmp_path):
    rows = [(ts(i * 7), "p", i % 3 + 1, float(i)) for i in range(40)]
    schema = "ts timestamp, pool string, batch_size int, await_ms double"
    got = run_stream(spark, lambda s: jobs.stream_pool_stats(s), rows, schema, tmp_path, "complete")
    want = telemetry.pool_stats(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_stream_records_and_ema(spark, tmp_path):
    rows = [("k", "a", ts(100), ts(0)), ("k", "b", ts(50), ts(1)), ("k", "c", ts(200), ts(2)), ("j", "x", ts(70), ts(2))]
    got = run_stream(spark, jobs.stream_latest_records, rows, "key string, value string, expiration timestamp, arrival timestamp", tmp_path / "r", "update")
    assert {(r.key, r.value) for r in got if r.live} == {("k", "c"), ("j", "x")}
    rows = [("k", float(i + 1), 2.0, ts(i)) for i in range(6)]
    schema = "key string, interval double, size double, ts timestamp"
    got = run_stream(spark, lambda s: jobs.stream_ema(s, 0.3), rows, schema, tmp_path / "e", "update")
    want = telemetry.adjusted_ema(spark.createDataFrame(rows, schema), ["key"], "interval", "size", 0.3).first()
    assert got[-1].updates == 6 and abs(got[-1].samples_per_second - want.samples_per_second) < 1e-9


def test_stream_alerts(spark, tmp_path):
    rules = [
        {"name": "start", "pattern": "begin", "action": "set_started"},
        {"name": "reset", "pattern": "ok", "action": "reset_counters"},
        {"name": "err", "pattern": "bad", "action": "count", "threshold": 2},
        {"name": "win", "pattern": "odd", "action": "windowed_count", "threshold": 2, "window": 3},
        {"name": "hot", "pattern": r"temp=(\d+)", "action": "threshold", "above": 90},
        {"name": "idle", "pattern": "work", "action": "track_activity", "timeout": 60},
        {"name": "die", "pattern": "fatal", "action": "terminate"},
    ]
    lines = ["begin", "bad", "ok", "bad", "bad", "odd", "odd", "temp=95", "temp=5", "fatal", "work"]
    rows = [("h", ts(i), x) for i, x in enumerate(lines)] + [("h", ts(500), "late")]
    got = run_stream(spark, lambda s: jobs.stream_alerts(s, rules), rows, "host string, ts timestamp, line string", tmp_path, "append")
    assert [r.rule for r in sorted(got, key=lambda r: r.ts)] == ["err", "win", "hot", "die", "idle"]


def test_stream_ledger_and_rounds(spark, tmp_path):
    rows = [("a", "open", None, ts(0)), ("a", "done", 2.5, ts(5)), ("b", "open", None, ts(0)), ("b", "done", 1.0, ts(4)), ("b", "dropped", None, ts(5)), ("c", "open", None, ts(1))]
    got = run_stream(spark, lambda s: jobs.stream_batch_ledger(s, 60), rows, "batch string, kind string, loss double, ts timestamp", tmp_path / "l", "append")
    assert {(r.batch, r.outcome, r.loss) for r in got} == {("a", "done", 2.5), ("b", "dropped", None)}
    rows = [("h", e, k, ts(a)) for a, e, k in ((0, "begin", 41), (3.5, "transition", 42), (5, "begin", 42), (9, "transition", 50))]
    got = run_stream(spark, jobs.stream_epoch_cycles, rows, "host string, event string, epoch long, ts timestamp", tmp_path / "c", "append")
    assert [r.name for r in sorted(got, key=lambda r: r.ts)] == ["ar_time", "grad_accum_time", "error_missed_ar_step"]


def test_silent_hosts_and_stalled_batches(spark, tmp_path):
    rules = [{"name": "start", "pattern": "begin", "action": "set_started"}, {"name": "idle", "pattern": "work", "action": "track_activity", "timeout": 60}]
    rows = [("h", ts(0), "begin"), ("g", ts(1), "begin"), ("g", ts(100), "work"), ("g", ts(101), "work"), ("g", ts(102), "work"), ("g", ts(110), "x")]
    got = run_stream(spark, lambda s: jobs.stream_alerts(s, rules), rows, "host string, ts timestamp, line string", tmp_path / "a", "append", batches=3)
    assert {(r.host, r.rule) for r in got} == {("h", "idle"), ("g", "idle")}
    assert [round(r.value) for r in got if r.host == "h"] and all(r.value > 60 for r in got)
    rows = [("a", "open", None, ts(0)), ("a", "loss", 2.0, ts(5)), ("b", "open", None, ts(0)), ("b", "loss", 1.0, ts(20)), ("b", "loss", 3.0, ts(40)), ("c", "loss", 1.0, ts(41)), ("b", "done", None, ts(45)), ("a", "done", 2.0, ts(46)), ("d", "open", None, ts(300)), ("d", "dropped", None, ts(301))]
    got = run_stream(spark, lambda s: jobs.stream_batch_ledger(s, 60, 30), rows, "batch string, kind string, loss double, ts timestamp", tmp_path / "s", "append")
    assert {(r.batch, r.outcome, r.loss, r.late_reports) for r in got} == {("a", "dropped", None, 0), ("a", "late", None, 1), ("b", "done", 3.0, 0), ("c", "late", None, 1), ("d", "dropped", None, 0)}


def test_stream_cache_and_pairs(spark, tmp_path):
    rows = [("k", "1", ts(0)), ("k", "2", ts(8)), ("x", "3", ts(1)), ("y", "4", ts(60)), ("y", "4", ts(61)), ("y", "4", ts(62))]
    got = run_stream(spark, lambda s: jobs.stream_cache(s, "10 seconds"), rows, "key string, value string, ts timestamp", tmp_path / "c", "update", batches=2)
    assert {(r.key, r.value) for r in got if not r.live} == {("k", "2"), ("x", "3")}
    marks = [("h", ts(0), "start"), ("h", ts(2), "start"), ("h", ts(5), "end"), ("h", ts(6), "end"), ("g", ts(1), "start"), ("g", ts(9), "end")]
    got = run_stream(spark, jobs.stream_pair_intervals, marks, "host string, ts timestamp, mark string", tmp_path / "p", "append", batches=2)
    want = telemetry.pair_intervals(spark.createDataFrame(marks, "host string, ts timestamp, mark string"), ["host"], F.col("mark") == "start", F.col("mark") == "end")
    assert {(r.host, r.ts, r.ms) for r in got} == {(r.host, r.ts, r.ms) for r in want.collect()} and len(got) == 2


def test_validation_of_json_records(spark):
    rows = spark.createDataFrame([(json.dumps(x),) for x in ({"a": 1, "b": "x"}, {"a": "1", "b": "x"}, {"a": 1}, {"a": 1.5, "b": "x"})] + [("{",), (None,)], "value string")
    good, bad = records.validate_records(rows, {"a": "BIGINT", "b": "STRING"})
    assert good.count() == 1 and bad.count() == 5
