"""Streaming windows, caches, upserts and progress against their batch forms, over one and several triggers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import records, telemetry
from corpusloom.plans import jobs as plans
from corpusloom.streaming import jobs
from test_telemetry import run_stream, ts



@pytest.mark.parametrize("batches", [1, 4])
def test_utilisation_windows_stream(spark, tmp_path, batches):
    rng = np.random.default_rng(batches)
    rows = [(f"h{rng.integers(3)}", ts(float(t)), float(rng.integers(9))) for t in np.sort(rng.choice(4000, 300, replace=False)) / 10]
    rows += [("far", ts(100_000 + i), 0.0) for i in range(max(1, batches))]
    schema = "host string, ts timestamp, value double"
    # Rows come out of order within the delay.
    mixed = [rows[i] for k in range(0, 300, 20) for i in rng.permutation(range(k, min(300, k + 20)))] + rows[300:]
    got = run_stream(spark, lambda s: jobs.stream_utilisation(s, 5000, "30 seconds"), mixed, schema, tmp_path, "append", batches)
    want = telemetry.utilisation_windows(spark.createDataFrame(rows, schema)).where("host <> 'far'").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 30


@pytest.mark.parametrize("batches", [1, 3])
def test_bounded_cache_stream(spark, tmp_path, batches):
    rng = np.random.default_rng(batches)
    size = {k: int(rng.integers(1, 60)) for k in range(30)}
    rows = [(f"c{rng.integers(2)}", k, ts(float(t)), size[k]) for t, k in zip(np.sort(rng.choice(3000, 400, replace=False)) / 10, rng.integers(0, 30, 400).tolist(), strict=True)]
    schema = "cache string, key long, ts timestamp, nbytes long"
    got = run_stream(spark, lambda s: jobs.stream_bounded_cache(s, 8.0, 8, 200), rows, schema, tmp_path, "append", batches)
    held = {}
    for r in got:
        if r.action == "put":
            held[r.cache, r.key] = r.nbytes
        else:
            del held[r.cache, r.key]
    # Timers expire what the watermark has passed; what is left is looked at when the last put came.
    at = F.lit(rows[-1][2])
    want = {(r.cache, str(r.key)): r.nbytes for r in records.expire_batches(spark.createDataFrame(rows, schema), at, 8.0, 8, 200).collect()}
    assert want.items() <= held.items() and all(rows[-1][2] - max(x[2] for x in rows if (x[0], str(x[1])) == k) >= ts(8) - ts(0) for k in held.keys() - want.keys())
    assert {r.action for r in got} == {"put", "evicted", "expired"}


def test_a_repeated_trigger_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    schema = "role string, name string, ts timestamp, value double"
    batches = [[("r", "a", ts(1), 1.0), ("r", "b", ts(5), 2.0)], [("r", "a", ts(3), 3.0), ("r", "a", ts(2), 9.0), ("r", "b", ts(4), 7.0)], [("q", "a", ts(1), 4.0)], [("r", "a", ts(9), 5.0)]]
    put = jobs.write_metrics(path)
    assert jobs.read_metrics(spark, path) is None
    states = []
    for number, rows in enumerate(batches):
        for _ in range(2):
            put(spark.createDataFrame(rows, schema), number)
            states.append({(r["role"], r["name"]): r["value"] for r in jobs.read_metrics(spark, path).collect()})
    assert states[::2] == states[1::2]
    assert states[-1] == {("r", "a"): 5.0, ("r", "b"): 2.0, ("q", "a"): 4.0}
    changed = spark.read.parquet(f"{path}/changes/000000000003")
    assert changed.count() == 1
    lost = tmp_path / "t/changes/000000000003/_SUCCESS"
    lost.unlink()
    assert {(r["role"], r["name"]): r["value"] for r in jobs.read_metrics(spark, path).collect()} == states[-3]


def test_merged_folders_keep_the_table(spark, tmp_path):
    put = jobs.upsert(f"file://{tmp_path}/t", ("k",), merge_every=3)
    want = {}
    for number in range(8):
        rows = [(f"k{number % 4}", number), ("x", number)]
        want |= dict(rows)
        put(spark.createDataFrame(rows, "k string, v long"), number)
        assert {r["k"]: r["v"] for r in jobs.read_upserted(spark, f"file://{tmp_path}/t", ("k",)).collect()} == want
    assert len(list((tmp_path / "t/merged").iterdir())) == 2


def test_progress_follows_changed_swarms(spark, tmp_path):
    def peer(swarm, name, epoch, samples, speed, client=False, live=True):
        value = json.dumps({"epoch": epoch, "samples": samples, "speed": speed, "time": "2024-01-01T00:00:00Z", "client_mode": client})
        return f"{swarm}|{name}", value, ts(60), live

    schema = "key string, value string, expiration timestamp, live boolean"
    local = spark.createDataFrame([("a", 1, 7, 2.0), ("b", 9, 5, 1.0)], "swarm string, local_epoch long, local_samples long, local_speed double")
    path = f"file://{tmp_path}/p"
    sink = jobs.stream_progress(path, lambda: F.lit(ts(10)), 100.0, 1, local)
    sink(spark.createDataFrame([peer("a", "x", 3, 10, 1.0), peer("a", "y", 4, 20, 2.0, client=True), peer("b", "x", 2, 0, 1.0)], schema), 0)
    first = {r["swarm"]: r for r in jobs.read_progress(spark, path).collect()}
    assert (first["a"].global_epoch, first["a"].peers, first["a"].clients, first["a"].total_samples, first["a"].estimated_samples) == (3, 2, 1, 30, 60.0)
    assert (first["b"].global_epoch, first["b"].total_samples, first["b"].eta_s, first["b"].peers) == (9, 5, 95.0, 1)
    for _ in range(2):
        sink(spark.createDataFrame([peer("a", "x", 5, 1, 1.0)], schema), 1)
        assert spark.read.parquet(f"{path}/progress/changes/000000000001").count() == 1
        now = {r["swarm"]: r for r in jobs.read_progress(spark, path).collect()}
        assert now["a"].global_epoch == 5 and now["b"] == first["b"]
    sink(spark.createDataFrame([peer("a", "x", 5, 1, 1.0, live=False), peer("a", "y", 4, 20, 2.0, live=False)], schema), 2)
    now = {r["swarm"]: r for r in jobs.read_progress(spark, path).collect()}
    assert (now["a"].peers, now["a"].global_epoch, now["a"].total_samples, now["a"].eta_s) == (0, 1, 7, 46.5) and now["b"] == first["b"]


def test_progress_through_a_stream(spark, tmp_path):
    rows = [(f"s|p{i % 3}", json.dumps({"epoch": i, "samples": i, "speed": 1.0, "time": "2024-01-01T00:00:00Z", "client_mode": False}), ts(500 + i), ts(i)) for i in range(9)]
    schema = "key string, value string, expiration timestamp, arrival timestamp"
    for k in range(3):
        spark.createDataFrame(rows[3 * k : 3 * k + 3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.stream_latest_records(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    sink = jobs.stream_progress(f"file://{tmp_path}/p", lambda: F.lit(ts(0)), 100.0, 1)
    query = stream.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    query.stop()
    out = jobs.read_progress(spark, f"file://{tmp_path}/p").collect()
    assert [(r.swarm, r.global_epoch, r.peers, r.total_samples) for r in out] == [("s", 8, 3, 15)]


def test_leases_and_client_stats_stream(spark, tmp_path):
    rows = [(ts(i), float(i), ("failure", "ok")[i % 2]) for i in range(100)]
    schema = "ts timestamp, latency_ms double, outcome string"
    got = run_stream(spark, jobs.stream_client_stats, rows, schema, tmp_path / "c", "complete")
    assert sorted(map(tuple, got)) == sorted(map(tuple, telemetry.client_stats(spark.createDataFrame(rows, schema)).collect()))
    leases = [("a", k, "r", ts(k)) for k in range(5)] + [("z", 0, "r", ts(9999))]
    receipts = [("a", 1, "r", ts(5)), ("a", 1, "r", ts(6)), ("a", 3, "r", ts(900)), ("z", 0, "r", ts(9999))]
    schema = "origin string, seq long, receiver string, ts timestamp"
    for name, part in (("leases", leases), ("receipts", receipts)):
        for k in range(2):
            spark.createDataFrame(part[k::2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    read = lambda name: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    query = jobs.stream_leases(read("leases"), read("receipts")).writeStream.format("memory").queryName("leases_out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    query.stop()
    rows = [r for r in spark.table("leases_out").collect() if r.origin == "a"]
    got = {(r.origin, r.seq): r.state for r in rows}
    assert len(rows) == len(got)
    assert got[("a", 1)] == "settled" and set(got.items()) <= {(("a", k), "settled" if k == 1 else "expired") for k in range(5)}


def test_default_rules(spark, tmp_path):
    lines = [
        "Server started with 1 modules:", "accumulated 5 samples for epoch 3", "[HandlerLiveness] stale: 1, ages_s: 0.1", "[HandlerLiveness] stale: 0, ages_s: 0.1", *["[HandlerLiveness] stale: 2, ages_s: 0.1"] * 3,
        "Averaging step failed: could not find a group", "Averaged parameters with 3 peers", "Averaging step failed: could not find a group", "Used RAM mem is 0.85", "Used RAM mem is 0.9",
        "Metadata Store: Connection refused", "push metrics: Connection refused", "peer: Connection refused", "CUDA error: out of memory", "[W2WInject] data stream failed: x",
        "Encountered incorrect value in grads", *["Error in auto step: The size of tensor a (3) must match the size of tensor b (4)"] * 2, "Timed out waiting for global progress update",
    ]
    want = ["handler_stale", "ar_state_timeout", "ram_mem_usage", "connection_error", "cuda_error", "trainerless_data_stream_failure", "error_in_grads", "averaging_size_mismatch", "global_epoch_refresh_failure"]
    value = [("h", f"2024-01-01 00:{i // 60:02d}:{i % 60:02d},000 - INFO - {x}") for i, x in enumerate(lines)]
    df = spark.createDataFrame(value, "host string, value string")
    assert [r.rule for r in plans.fleet_alerts(df).orderBy("ts").collect()] == want
    late = spark.createDataFrame([*value, ("h", "2024-01-01 09:00:00,000 - INFO - x")], "host string, value string")
    assert [r.rule for r in plans.fleet_alerts(late).orderBy("ts").collect()] == [*want, "accumulate"]
    rows = [("h", ts(i), x) for i, x in enumerate(lines)]
    got = run_stream(spark, jobs.stream_alerts, rows, "host string, ts timestamp, line string", tmp_path, "append")
    assert [r.rule for r in sorted(got, key=lambda r: r.ts)] == want
