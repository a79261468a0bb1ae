"""Queries over ``events`` and the sales tables as records, telemetry and rosters, with their SQL.

An event is a record: key := user_id, subkey := event_type, value := value, arrival := ts, expiration := ts + ttl; and a
telemetry sample of host := user_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import scalar
from corpusloom.operators import records, telemetry
from corpusloom.session import table

NOW = "2024-01-31 00:00:00"
HOST = ("host",)
ORDER = ("ts", "event_id")


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ltz")


def events(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    return rows.withColumns({"ts": F.col("ts").cast("timestamp_ltz"), "host": F.concat(F.lit("h"), F.col("user_id").cast("string"))})


def log(spark: SparkSession, d: str) -> DataFrame:
    """Records that live for a time that depends on their number."""
    e = events(spark, d)
    return e.select(
        F.col("user_id").alias("key"), F.col("event_type").alias("subkey"), "value", F.col("ts").alias("arrival"), F.timestamp_add("HOUR", (F.col("event_id") % 240).cast("int"), F.date_trunc("hour", "ts")).alias("expiration")
    )


def q_latest_records(spark: SparkSession, d: str) -> DataFrame:
    return records.latest_records(log(spark, d), now())


def q_latest_subrecords(spark: SparkSession, d: str) -> DataFrame:
    out = records.latest_subrecords(log(spark, d), now())
    return out.select("key", F.array_join(F.transform(F.array_sort(F.map_keys("value")), lambda k: F.concat(k, F.lit("="), F.format_string("%.2f", F.element_at(F.col("value"), k)))), ";").alias("subs"), "expiration")


def q_visible_count(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    return records.visible_count(keys, log(spark, d), now())


def q_evict_to_size(spark: SparkSession, d: str) -> DataFrame:
    return records.evict_to_size(records.latest_records(log(spark, d), now()), 50)


def members(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    value = F.concat(F.lit("p"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 4 == 1, F.lit("_ghost1_3")).when(F.col("event_id") % 4 == 2, F.concat(F.lit("_ghost2_"), (F.col("event_id") % 9).cast("string"))).when(F.col("event_id") % 40 == 3, F.lit("?bad")).otherwise(F.lit("")))
    return e.select("event_id", value.alias("value"), F.timestamp_add("HOUR", (F.col("event_id") % 100).cast("int"), "ts").alias("expiration"))


def q_live_members(spark: SparkSession, d: str) -> DataFrame:
    return records.live_members(members(spark, d), now()).select("event_id", "peer", "phase", F.col("epoch"))


def q_validate_records(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("event_id", F.when(F.col("event_id") % 5 == 0, F.regexp_replace("props", r"(\d+)", '"$1"')).when(F.col("event_id") % 7 == 0, F.lit("{")).otherwise(F.col("props")).alias("value"))
    good, bad = records.validate_records(rows, {"k": "BIGINT"})
    return good.select("event_id", F.lit("valid").alias("state")).unionByName(bad.select("event_id", F.lit("quarantine").alias("state")))


def q_run_validators(spark: SparkSession, d: str) -> DataFrame:
    """Signed properties of events, some with another secret, none, or another owner."""
    payload = F.when(F.col("event_id") % 5 == 0, F.lit('{"k": "x"}')).otherwise(F.col("props"))
    secret = F.when(F.col("event_id") % 3 == 0, F.lit("other")).otherwise(F.lit("mine"))
    signature = F.sha2(F.concat_ws("\0", secret, F.col("host"), payload), 256)
    rows = events(spark, d).select("event_id", "host", F.when(F.col("event_id") % 11 == 0, payload).otherwise(F.concat(payload, F.lit("[signature:"), signature, F.lit("]"))).alias("value"))
    chain = [records.signature_validator("mine", "host"), records.owner_validator("host", "[0-8]$"), records.schema_validator({"k": "BIGINT"})]
    good, bad = records.run_validators(rows, chain)
    return good.select("event_id", F.lit(None).cast("string").alias("failed"), "value").unionByName(bad.select("event_id", "failed", F.lit(None).cast("string").alias("value")))


def q_tier_lookup(spark: SparkSession, d: str) -> DataFrame:
    tiers = spark.createDataFrame([(-10000.0, "none"), (0.0, "small"), (2500.0, "medium"), (7500.0, "large")], "threshold double, label string")
    return records.tier_lookup(table(spark, d, "customer").select("c_custkey", "c_acctbal"), tiers, "c_acctbal").select("c_custkey", "tier")


def q_name_contains_lookup(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    keys = parts.select(F.col("p_type").alias("ref_name")).unionByName(parts.select(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("ref_name"))).distinct()
    return records.name_contains_lookup(parts.select("p_partkey", F.concat_ws(" - ", "p_brand", F.upper("p_type"), "p_name").alias("name")), keys, "name").select("p_partkey", "ref_name")


def q_pair_leases_receipts(spark: SparkSession, d: str) -> DataFrame:
    """Views are leases, clicks of the same host receipts; the first receipt settles."""
    e = events(spark, d)
    leases = e.where("event_type = 'view'").select(F.col("host").alias("origin"), F.col("event_id").alias("lease"), "ts", F.expr("event_id % 3").alias("seq"))
    receipts = e.where("event_type = 'click'").select(F.col("host").alias("origin"), F.expr("event_id % 3").alias("seq"), "ts")
    return records.pair_leases_receipts(leases, receipts, "12 hours", ("origin", "seq")).select("lease", "state", "interval_s")


def q_exclude_banned(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    m = e.select(F.col("event_id").alias("uid"), F.expr("user_id % 5").alias("endpoint"), F.timestamp_add("DAY", F.lit(10), "ts").alias("expiration"))
    bans = e.where("event_type = 'error'").select(F.col("event_id").alias("uid"), F.expr("event_id % 5").alias("endpoint"), F.timestamp_add("DAY", (F.col("event_id") % 20).cast("int"), "ts").alias("expiration"))
    return records.exclude_banned(m, bans, now()).select("uid", "endpoint")


def q_already_registered(spark: SparkSession, d: str) -> DataFrame:
    peers = table(spark, d, "customer").select(F.col("c_custkey").alias("peer_id"))
    book = table(spark, d, "supplier").select(F.col("s_suppkey").alias("peer_id"), F.lit("2024-02-01").cast("timestamp_ltz").alias("expiration"))
    roster = log(spark, d).select(F.col("key").alias("peer_id"), "expiration")
    return records.already_registered(peers, book, roster, now=now())


def q_verify_members(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string")).alias("info"))
    return records.verify_members(c, {"segment": "BUILDING", "nation": "7"}).select("c_custkey")


def q_swarm_progress(spark: SparkSession, d: str) -> DataFrame:
    """Peers report by their last event; swarms are event types."""
    last = events(spark, d).groupBy("event_type", "user_id").agg(F.max(F.struct("ts", "event_id", "value")).alias("r"))
    peers = last.select("event_type", F.expr("r.event_id % 13").alias("epoch"), F.floor("r.value").cast("long").alias("samples"), F.round(F.col("r.value") / 1000, 3).alias("speed"), F.col("r.ts").alias("time"), F.expr("user_id % 10 = 0").alias("client_mode"))
    out = records.swarm_progress(peers, now(), 1e7, 3, ("event_type",))
    return out.select("event_type", "global_epoch", "peers", "clients", "total_samples", *[F.round(c, 3).alias(c) for c in ("total_speed", "estimated_samples", "eta_s", "next_refresh_s")])


def q_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    compute = o.select(F.col("o_custkey").alias("peer"), (F.col("o_totalprice") / 1000).alias("pflop"))
    presence = o.select(F.col("o_custkey").alias("peer"), F.expr("cast(o_orderkey % 24 as double)").alias("hours"))
    accounts = table(spark, d, "customer").select(F.col("c_custkey").alias("peer"), F.col("c_nationkey").alias("account"))
    out = records.leaderboard(compute, presence, accounts)
    return out.select("account", F.round("score", 3).alias("score"), "peers", "rank")


def q_subset_by_rank(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "customer").select(F.col("c_nationkey").alias("stage"), F.concat(F.col("c_mktsegment"), F.lit("."), F.col("c_custkey").cast("string")).alias("uid"))
    return records.subset_by_rank(s, 5, 7, "uid", ("stage",))


def q_balanced_partitions(spark: SparkSession, d: str) -> DataFrame:
    return records.balanced_partitions(table(spark, d, "customer").select("c_nationkey", "c_custkey"), 4, "c_custkey", ("c_nationkey",))


def q_join_rank(spark: SparkSession, d: str) -> DataFrame:
    first = events(spark, d).groupBy("event_type", F.col("user_id").alias("uid")).agg(F.min("ts").alias("joined"))
    return records.join_rank(first, ("event_type",)).select("event_type", "uid", "join_rank")


def q_expire_batches(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select(F.col("event_type").alias("cache"), F.expr("event_id % 500").alias("key"), "ts", F.floor("value").cast("long").alias("nbytes"))
    return records.expire_batches(e, now(), 86400.0 * 10, 200, 9000).select("cache", "key", "nbytes")


def q_batch_ledger(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    opens = e.where("event_type = 'view'").groupBy(F.col("host").alias("origin"), F.expr("event_id % 4").alias("seq")).agg(F.min("ts").alias("ts"))
    kinds = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "dropped").otherwise("loss")
    reports = e.where("event_type <> 'view'").select(F.col("host").alias("origin"), F.expr("event_id % 4").alias("seq"), kinds.alias("kind"), F.col("value").alias("loss"), "ts")
    late = reports.join(opens.select("origin", "seq", F.col("ts").alias("open_ts")), ["origin", "seq"]).where("ts >= open_ts").drop("open_ts")
    return records.batch_ledger(opens, late, 86400.0 * 3, 86400.0)


def q_pool_stats(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("ts", F.col("event_type").alias("pool"), (F.col("event_id") % 8 + 1).alias("batch_size"), F.col("value").alias("await_ms"))
    out = telemetry.pool_stats(e, "3600 seconds")
    return out.select("window_start", "pool", "batches", "examples", *[F.round(c, 6).alias(c) for c in ("avg_batch_size", "avg_await_ms", "batches_per_s", "examples_per_s")])


def q_client_stats(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "signup", "retry").when(F.col("event_type") == "click", "reject").when(F.col("event_type") == "view", "expired").otherwise("ok")
    out = telemetry.client_stats(events(spark, d).select("ts", F.col("value").alias("latency_ms"), outcome.alias("outcome")), "3600 seconds")
    return out.withColumn("mean_latency", F.round("mean_latency", 6))


def q_resource_means(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.resource_means(events(spark, d).select("ts", F.col("event_type").alias("host"), F.col("value").alias("used"), F.lit(1000.0).alias("capacity")), "1 day")


def q_running_stats(spark: SparkSession, d: str) -> DataFrame:
    out = telemetry.running_stats(events(spark, d), ["event_type"], "value")
    return out.withColumn("mean", F.round("mean", 6))


def q_peer_socket_summary(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select("host", F.col("value").alias("rtt_ms"), F.expr("event_id % 7").alias("retrans"), F.when(F.col("event_id") % 3 > 0, F.col("value") * 2).alias("delivery_mbps"))
    return telemetry.peer_socket_summary(e, ["host"])


def q_worst_peers(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select(F.col("host").alias("peer"), F.expr("event_id % 7").alias("retrans"), F.col("value").alias("rtt_ms"))
    return telemetry.worst_peers(e, 20).withColumn("excess_rtt", F.round("excess_rtt", 6))


def q_flop_totals(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.flop_totals(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", 6.5e12).withColumn("pflop", F.round("pflop", 3))


def q_tokens_per_second(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.tokens_per_second(events(spark, d).select("ts", F.expr("event_id % 5").alias("batches")), 512, 3600)


def q_median_latency_rounds(spark: SparkSession, d: str) -> DataFrame:
    out = telemetry.median_latency_rounds(events(spark, d), 8, ["host"], list(ORDER), "value")
    return out.withColumn("occupancy", F.round("occupancy", 6))


def q_pair_intervals(spark: SparkSession, d: str) -> DataFrame:
    out = telemetry.pair_intervals(events(spark, d), HOST, F.col("event_type") == "view", F.col("event_type") == "purchase", ORDER)
    return out.select("event_id", F.round("ms", 3).alias("ms"))


def q_count_since_reset(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return telemetry.count_since_reset(e, HOST, F.col("event_type") == "error", F.col("event_type") == "purchase", 3, ORDER).select("event_id", "count", "alert")


def q_windowed_count(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return telemetry.windowed_count(e, HOST, F.col("event_type") == "error", F.col("event_type") == "purchase", 5, 3, ORDER).select("event_id", F.col("count").cast("long").alias("count"), "alert")


def q_top_labels(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.top_labels(events(spark, d), ["event_type"], "host", 3).select("event_type", "host", "n", "rank")


def q_counter_deltas(spark: SparkSession, d: str) -> DataFrame:
    out = telemetry.counter_deltas(events(spark, d).withColumn("bytes", F.col("value") * 1e6), HOST, "bytes", ORDER)
    return out.select("event_id", F.round("mbps", 6).alias("mbps"))


def q_retransmit_shares(spark: SparkSession, d: str) -> DataFrame:
    """Values as readings of two counters, which go back often."""
    e = events(spark, d).withColumns({"segs": F.floor("value").cast("long"), "again": F.floor(F.col("value") / 7).cast("long")})
    out = telemetry.retransmit_shares(e, HOST, "segs", "again", ORDER)
    return out.select("event_id", "out_delta", "retrans_delta", F.round("retrans_pct", 6).alias("retrans_pct"))


def q_adjusted_ema(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("size", F.expr("event_id % 4 + 1.0D"))
    return telemetry.adjusted_ema(e, ["host"], "value", "size", 0.1, order=ORDER).withColumn("samples_per_second", F.round("samples_per_second", 6))


def q_running_totals(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumns({"batches": F.expr("event_id % 5"), "loss": F.when(F.col("event_type") == "view", F.col("value")).otherwise(0.0)})
    return telemetry.running_totals(e, HOST, "batches", "loss", 512, ORDER).select("event_id", "total_tokens", "last_loss")


def q_activity_gap(spark: SparkSession, d: str) -> DataFrame:
    out = telemetry.activity_gap(events(spark, d), HOST, F.col("event_type") == "click", 86400.0, ORDER)
    return out.select("event_id", F.round("gap_s", 3).alias("gap_s"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """A log line of each event."""
    e = events(spark, d)
    head = F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS")
    text = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("INFO - train loss = "), F.when(F.col("event_id") % 9 == 0, F.lit("0")).otherwise(F.format_string("%.2f", "value")), F.lit(", num batches process = "), F.col("event_id") % 64))
        .when(F.col("event_type") == "click", F.concat(F.lit("WARNING - Banned expert body1.0."), F.col("user_id"), F.lit(" reason=timeout duration=3600s")))
        .when(F.col("event_type") == "error", F.concat(F.lit("ERROR - "), F.when(F.col("event_id") % 2 == 0, F.lit("Read stream closed early from sender 3")).otherwise(F.lit("something unexpected"))))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("INFO - TCP retransmit: "), F.col("event_id") % 10, F.lit(" of 1000 segs retransmitted (0.500%) cc=bbr")))
        .otherwise(F.concat(F.lit("INFO - body1.0.7_forward: "), F.col("event_id") % 30, F.lit(" batches (0.47 s/batch), 56 examples (0.93 s/example), avg batch size 2.00, avg batch await time 12ms")))
    )
    return telemetry.parse_lines(e.select("event_id", "host", F.concat(head, F.lit(" - "), text).alias("value")))


def q_extract_metrics(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.extract_metrics(lines(spark, d)).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


def q_metric_lines(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.classify_lines(lines(spark, d)).withColumn("family", F.element_at(F.array(*[F.lit(r.family) for r in telemetry.RULES]), F.col("rule") + 1)).select("event_id", "level", "family")


def q_latest_gauges(spark: SparkSession, d: str) -> DataFrame:
    m = telemetry.extract_metrics(lines(spark, d)).where("kind = 'gauge'").withColumnRenamed("host", "role")
    return telemetry.latest_gauges(m).select("role", "name", "value")


def q_error_counters(spark: SparkSession, d: str) -> DataFrame:
    m = telemetry.extract_metrics(lines(spark, d)).where("kind = 'error'").withColumnRenamed("host", "role")
    return telemetry.error_counters(m)


def q_error_capture(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.error_capture(lines(spark, d), 3).select("event_id")


def q_visible_lines(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.visible_lines(lines(spark, d), order=ORDER).select("event_id", "tag")


# A line of each family of the fleet's logs, and the metrics (kind, name, value) that it holds.
FAMILY_LINES: tuple[tuple[str, str, tuple[tuple[str, str, float], ...]], ...] = (
    ("T1", "INFO - Failed to load state from peers: TimeoutError", (("error", "error_loadtimeout", 1),)),
    ("T1", "INFO - one of the variables needed for gradient computation has been modified by an inplace operation", (("error", "error_grad_version", 1),)),
    ("T1", "INFO - Accumulate buffer full, no sentinel added", (("error", "error_ar_accumulate_buffer_full", 1),)),
    ("T1", "WARNING - Dropping address-book record", (("error", "error_ms_verification_drop", 1),)),
    ("T1", "INFO - [FAILURE SIM] Inducing failure case 2", (("error", "failure_sim_mm", 1),)),
    ("T2", "INFO - Pre Max total_grad: 1.5", (("gauge", "pre_max_grad", 1.5),)),
    ("T2", "INFO - Post step total_grad: 2.25", (("gauge", "post_step_grad", 2.25),)),
    ("T3", "INFO - total_tokens_processed = 262144", (("gauge", "head_total_tokens", 262144),)),
    ("T4", "INFO - Banned expert body1.0.7 reason=timeout duration=3600s", (("label", "ban_timeout_body1.0.7", 1),)),
    ("T5", "INFO - [GhostPhase] phase: 2", (("gauge", "ghost_phase", 2),)),
    ("T6", "INFO - GPU mem size is 80Gb", (("gauge", "gpu_total", 80),)),
    ("T6", "INFO - CPU load is 0.5", (("gauge", "cpu_load", 0.5),)),
    ("T7", "INFO - Latency: 12.5 ms", (("gauge", "latency_rtt", 12.5),)),
    ("T8", "INFO - see 5 of body1.", (("gauge", "peer_vis_body1", 5),)),
    ("T9", "INFO - Sent 1.5 Rcv 2.5", (("gauge", "send_comm", 1.5), ("gauge", "recv_comm", 2.5), ("gauge", "tot_comm", 4))),
    ("T10", "INFO - Number open connections -1", (("gauge", "open_conns", -1),)),
    ("T12", "INFO - TCP peers: n=3 rtt_p50_ms=10.00 rtt_p95_ms=- retrans_total=7 delivery_rate_p50_mbps=90.00 delivery_rate_min_mbps=-", (("gauge", "tcp_peer_count", 3), ("duration", "tcp_peer_rtt_p50", 10), ("gauge", "tcp_peer_retrans_total", 7), ("gauge", "tcp_peer_delivery_p50", 90))),
    ("T13", "INFO - [Metadata Store Client Stats] Last 60s - requests: 5, mean_latency: 1.5ms, max_latency: 9.5ms, failures: 1, retries: 2", (("gauge", "ms_client_requests", 5), ("duration", "ms_client_mean_latency", 1.5), ("duration", "ms_client_max_latency", 9.5), ("gauge", "ms_client_failures", 1), ("gauge", "ms_client_retries", 2), ("gauge", "ms_client_rejects", 0), ("gauge", "ms_client_dropped_expired", 0))),
    ("T14", "INFO - [ActCache] entries: 1, bytes: 2, puts: 3, hits: 4, misses: 5, evictions_fifo: 6, evictions_ttl: 7, overwrites: 8, drops: 9", tuple(("gauge", f"act_cache_{x}", k + 1) for k, x in enumerate(("entries", "bytes", "puts", "hits", "misses", "evictions_fifo", "evictions_ttl", "overwrites", "drops")))),
    ("T15", "INFO - [W2WHop] next_hops_learned: 1, prev_hops_learned: 2, parse_errors: 3", (("gauge", "w2w_next_hops_learned", 1), ("gauge", "w2w_prev_hops_learned", 2), ("gauge", "w2w_next_hop_parse_error", 3))),
    ("T16", "INFO - [W2WInject] window: 8, occupancy: 0.5", (("gauge", "w2w_inflight_window", 8), ("gauge", "w2w_queue_occupancy", 0.5))),
    (
        "T17",
        "INFO - [W2WSend] entries: 1, accepted_forward: 2, accepted_backward: 3, busy: 4, forward_pushes: 5, backward_pushes: 6, busy_retries: 7, drops: 8, push_errors: 9, per_target: a.1=2 b.2=3",
        (*(("gauge", f"w2w_send_{x}", k + 1) for k, x in enumerate(("entries", "accepted_forward", "accepted_backward", "busy", "forward_pushes", "backward_pushes", "busy_retries", "drops", "push_errors"))), ("label", "w2w_push_fail_a.1", 2), ("label", "w2w_push_fail_b.2", 3)),
    ),
    ("T18", "INFO - [HandlerLiveness] stale: 1, ages_s: 0.1/65.0/0.2", (("gauge", "handler_stale_count", 1), ("gauge", "handler_max_age_s", 65))),
    ("T19", "INFO - accumulated 12 samples", (("gauge", "batch_step", 12),)),
    ("T21", "INFO - body1.0.7_backward: 4 batches (0.47 s/batch), 56 examples (0.93 s/example), avg batch size 2.00, avg batch await time 12ms", (("gauge", "backward_batches", 4), ("gauge", "avg_batch_size", 2), ("duration", "batch_await_time", 12))),
    ("T22", "INFO - Processed 5 batches in last 60 seconds:", (("flush", "flop", 5),)),
    ("T23", "INFO - Formed group with 3 peers out of 4 in 1.5 secs", (("gauge", "formed_groupsize", 3), ("gauge", "max_groupsize", 4), ("gauge", "mm_time", 1.5))),
    ("T24", "INFO - Averaging gradients failed with TimeoutError()", (("gauge", "grad_avg_timeout", 1), ("gauge", "grad_avg_groupsize", 0))),
    ("T24", "INFO - Averaged gradients with 6 peers", (("gauge", "grad_avg_groupsize", 6), ("gauge", "grad_avg_timeout", 0))),
    ("T25", "INFO - Averaging: received 97.5%", (("gauge", "average_pcnt", 97.5),)),
    ("T26", "INFO - Failed to receive tensors from peer p1: 3 failures, reason=timeout", (("error", "ar_peer_failure_timeout", 1),)),
    ("T27", "INFO - AR yield blocked 1.5s for sender 2 (inbound_qsize=3/8)", (("duration", "ar_yield_stall", 1.5), ("gauge", "ar_in_qsize", 3))),
    ("T27", "INFO - AR chunk gap stats sender 1: max=2.5s mean=0.5s n=3", (("gauge", "ar_chunk_gap_max", 2.5), ("gauge", "ar_chunk_gap_mean", 0.5))),
    ("T28", "INFO - Beginning optimizer step #41", (("gauge", "step", 41), ("event", "ar_begin", 41))),
    ("T28", "INFO - Transitioning to epoch 42", (("event", "ar_transition", 42),)),
    ("T1", "INFO - Read stream closed early from sender 4", (("error", "error_ar_stream_closed_early", 1),)),
    ("T1", "INFO - [FAILURE SIM] Case 3: lost connection to peer 5", (("error", "failure_sim_ar", 1),)),
    ("T1", "ERROR - something else", (("error", "error_unknown", 1),)),
    ("T2", "INFO - Pre Avg total_grad: 0.5", (("gauge", "pre_avg_grad", 0.5),)),
    ("T2", "INFO - Error norm val: 0.25", (("gauge", "error_psgd_grad", 0.25),)),
    ("T2", "INFO - Error pre-clip norm val: 0.75", (("gauge", "error_pre_psgd_grad", 0.75),)),
    ("T2", "INFO - Prepsgd norm val: 3.5", (("gauge", "pre_psgd_grad", 3.5),)),
    ("T2", "INFO - Postpsgd norm val: 4.5", (("gauge", "post_psgd_grad", 4.5),)),
    ("T2", "INFO - Pre step total_grad: 5.5", (("gauge", "pre_step_grad", 5.5),)),
    ("T3", "INFO - train loss = 2.5, num batches process = 64, internal trainer step = 12", (("gauge", "head_batches", 64), ("gauge", "head_loss", 2.5))),
    ("T3", "INFO - train loss = 1.25", (("gauge", "head_loss", 1.25),)),
    ("T6", "INFO - Allocated GPU mem is 0.5", (("gauge", "gpu_alloc", 0.5),)),
    ("T6", "INFO - Reserved GPU mem is 0.75", (("gauge", "gpu_reserve", 0.75),)),
    ("T6", "INFO - GPU utilization is 87.5", (("gauge", "gpu_util", 87.5),)),
    ("T6", "INFO - Total RAM mem is 512Gb", (("gauge", "ram_total", 512),)),
    ("T6", "INFO - Used RAM mem is 0.25", (("gauge", "ram_usage", 0.25),)),
    ("T7", "INFO - Download Speed: 90.5 Mbps", (("gauge", "download_speed", 90.5),)),
    ("T7", "INFO - Upload Speed: 45.25 Mbps", (("gauge", "upload_speed", 45.25),)),
    ("T11", "INFO - TCP retransmit: 5 of 1000 segs retransmitted (0.500%) cc=bbr", (("gauge", "tcp_retrans_segs", 5), ("gauge", "tcp_out_segs", 1000), ("gauge", "tcp_retrans_pct", 0.5), ("gauge", "cc_default_bbr", 1))),
    ("T21", "INFO - body1.0.7_forward: 28 batches (0.47 s/batch), 56 examples (0.93 s/example), avg batch size 2.00, avg batch await time 12ms", (("gauge", "forward_batches", 28), ("gauge", "avg_batch_size", 2), ("duration", "batch_await_time", 12))),
    ("T24", "INFO - Averaging parameters failed with TimeoutError()", (("gauge", "state_avg_timeout", 1),)),
    ("T24", "INFO - Averaging gradients failed with AllreduceException('Averaging step failed: could not find a group')", (("gauge", "grad_avg_groupsize", 0),)),
    ("T25", "INFO - Reducer: received 12.5% of data", (("gauge", "reducer_pcnt", 12.5),)),
    ("T26", "INFO - Banned sender 4: reason=slow", (("error", "ar_sender_banned_slow", 1),)),
    ("T26", "INFO - Rejected request from 4: reason=late", (("error", "ar_request_rejected_late", 1),)),
    ("T27", "INFO - AR barrier wait 1.25s on part 3 sender 4", (("duration", "ar_barrier_wait", 1.25),)),
    ("T27", "INFO - AR queue stats sender 3: inbound max=7/9 mean=2.5", (("gauge", "ar_in_qsize_max", 7), ("gauge", "ar_in_qsize_mean", 2.5))),
    ("T28", "INFO - All-reduce round started at local epoch #3", (("event", "state_ar_start", 3),)),
    ("T28", "INFO - All-reduce round finished at local epoch #4", (("event", "state_ar_end", 4),)),
)


def q_family_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Every event logs a line of one of all families."""
    e = events(spark, d)
    text = F.element_at(F.array(*[F.lit(line) for _, line, _ in FAMILY_LINES]), (F.col("event_id") % len(FAMILY_LINES) + 1).cast("int"))
    rows = telemetry.parse_lines(e.select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" - "), text).alias("value")))
    rows = telemetry.classify_lines(rows).withColumn("family", F.element_at(F.array(*[F.lit(r.family) for r in telemetry.RULES]), F.col("rule") + 1))
    return telemetry.extract_metrics(rows.select("event_id", "family", "line")).select("event_id", "family", "kind", "name", "value")


def q_own_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's record holds an address of its own, one of its neighbour and one without an owner."""
    c = table(spark, d, "customer")
    own = F.concat(F.lit("/ip4/10.0.0."), "c_nationkey", F.lit("/tcp/"), F.expr("c_custkey % 100"), F.lit("/p2p/p"), "c_custkey")
    rows = c.select(F.concat(F.lit("p"), "c_custkey").alias("peer_id"), F.array(own, F.concat(F.lit("/ip4/10.1.0.1/tcp/1/p2p/p"), F.col("c_custkey") + 1), F.lit("/dns/x")).alias("addresses"))
    return records.own_addresses(rows).select("peer_id", F.array_join("addresses", ",").alias("addresses"))


def q_group_candidates(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("event_type") == "view", "true").when(F.col("event_type") == "click", "false").otherwise(F.col("event_type"))
    return records.group_candidates(events(spark, d).select("event_id", value.alias("value")), only_active=False).select("event_id", "looking_for_group")


def q_state_donors(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.concat(F.lit("head.0."), "s_suppkey").alias("uid"), F.col("s_nationkey").alias("priority"))
    return records.state_donors(s, "priority", "head.0.3", "head.0.5").select("uid", "priority")


def q_rate_to_mbps(spark: SparkSession, d: str) -> DataFrame:
    unit = F.element_at(F.array(*[F.lit(u) for u in ("bps", "Kbps", "Mbps", "Gbps", "")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.round(scalar.rate_to_mbps(F.concat(F.col("p_size").cast("string"), F.lit(".5"), unit)), 9).alias("mbps"))


def q_successor_stage(spark: SparkSession, d: str) -> DataFrame:
    stage = F.element_at(F.array(*[F.lit(x) for x in ("head", "body1", "body2", "tail")]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    rows = table(spark, d, "supplier").select("s_suppkey", F.concat(stage, F.lit(".0."), "s_suppkey").alias("uid"))
    return rows.select("s_suppkey", scalar.stage_of(F.col("uid")).alias("stage"), scalar.successor_stage(F.col("uid"), 4).alias("next_stage"))


def q_flop_per_sample(spark: SparkSession, d: str) -> DataFrame:
    params = F.col("p_size") * 1e6
    return table(spark, d, "part").select("p_partkey", scalar.flop_per_sample(params, 32, 16, 128, 4096).alias("forward"), scalar.flop_per_sample(params, 32, 16, 128, 4096, True).alias("backward"))


def q_ttl_seconds(spark: SparkSession, d: str) -> DataFrame:
    return log(spark, d).groupBy("subkey").agg(F.sum(scalar.ttl_seconds(F.col("expiration"), now())).alias("ttl_s"), F.count(F.lit(1)).alias("n"))


def q_epoch_cycle_times(spark: SparkSession, d: str) -> DataFrame:
    """Views begin rounds, purchases end them."""
    e = events(spark, d).where("event_type in ('view', 'purchase')")
    return telemetry.epoch_cycle_times(e.select("host", F.when(F.col("event_type") == "view", "begin").otherwise("transition").alias("event"), F.expr("event_id % 3").alias("epoch"), F.col("ts").cast("timestamp")))


def q_utilisation_windows(spark: SparkSession, d: str) -> DataFrame:
    out = telemetry.utilisation_windows(events(spark, d).select("host", F.col("ts").cast("timestamp"), "value"), span_ms=6 * 3600 * 1000)
    return out.select("host", "anchor", "closed", F.round("total", 6).alias("total"))


def q_phase_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Hosts fall behind by the value of their events."""
    e = events(spark, d).select("host", F.col("event_id").alias("step"), F.col("event_id").alias("local"), (F.col("event_id") + F.floor("value")).alias("remote"))
    return telemetry.phase_timeline(e, 3, 2, 60, "host")


def q_latest_entries(spark: SparkSession, d: str) -> DataFrame:
    """Purchases are plain values, the other events subrecords of the same keys."""
    rows = log(spark, d).withColumn("subkey", F.nullif("subkey", F.lit("purchase")))
    out = records.latest_entries(rows, now())
    subs = F.array_join(F.transform(F.array_sort(F.map_keys("value")), lambda k: F.concat(k, F.lit("="), F.format_string("%.2f", F.element_at(F.col("value"), k)))), ";")
    return out.select("key", "plain", subs.alias("subs"), "expiration")


def label_lines(spark: SparkSession, d: str) -> DataFrame:
    """Bans and failed pushes, which tell a running total, of five roles."""
    e = events(spark, d).where("event_type in ('click', 'signup')")
    push = F.concat(F.lit("INFO - [W2WSend] entries: 1, accepted_forward: 2, accepted_backward: 3, busy: 4, forward_pushes: 5, backward_pushes: 6, busy_retries: 7, drops: 8, push_errors: 9, per_target: body1.0."), F.col("user_id"), F.lit("="), F.col("event_id"))
    ban = F.concat(F.lit("WARNING - Banned expert body1.0."), F.col("user_id"), F.lit(" reason=timeout duration=3600s"))
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" - "), F.when(F.col("event_type") == "click", ban).otherwise(push))
    return e.select(F.concat(F.lit("r"), F.col("user_id") % 5).alias("role"), text.alias("value"))


def q_bounded_labels(spark: SparkSession, d: str) -> DataFrame:
    out = telemetry.bounded_labels(telemetry.extract_metrics(telemetry.parse_lines(label_lines(spark, d))))
    return out.select("role", "metric", "name", "n", "rank")


QUERIES = {n[2:]: f for n, f in globals().items() if n.startswith("q_")}

T0 = f"TIMESTAMP '{NOW}'"
EV = "ev AS (SELECT *, 'h' || user_id AS host FROM events)"
LOG_SQL = f"{EV}, log AS (SELECT user_id AS key, event_type AS subkey, value, ts AS arrival, date_trunc('hour', ts) + to_hours((event_id % 240)::INT) AS expiration FROM ev)"
LINES_SQL = f"""{EV}, lines AS (SELECT event_id, host, event_type, value, ts, CASE
    WHEN event_type = 'view' THEN CASE WHEN event_id % 9 = 0 THEN 0.0 ELSE round(value, 2) END END AS loss FROM ev),
  metrics AS (
    SELECT event_id, host, ts, 'gauge' AS kind, 'head_batches' AS name, (event_id % 64)::DOUBLE AS value FROM lines WHERE event_type = 'view'
    UNION ALL SELECT event_id, host, ts, 'gauge', 'head_loss', loss FROM lines WHERE event_type = 'view' AND loss <> 0
    UNION ALL SELECT event_id, host, ts, 'label', 'ban_timeout_body1.0.' || user_id, 1 FROM ev WHERE event_type = 'click'
    UNION ALL SELECT event_id, host, ts, 'error', CASE WHEN event_id % 2 = 0 THEN 'error_ar_stream_closed_early' ELSE 'error_unknown' END, 1 FROM lines WHERE event_type = 'error'
    UNION ALL SELECT event_id, host, ts, 'gauge', unnest(['tcp_retrans_segs', 'tcp_out_segs', 'tcp_retrans_pct', 'cc_default_bbr']), unnest([event_id % 10, 1000, 0.5, 1]) FROM lines WHERE event_type = 'purchase'
    UNION ALL SELECT event_id, host, ts, unnest(['gauge', 'gauge', 'duration']), unnest(['forward_batches', 'avg_batch_size', 'batch_await_time']), unnest([event_id % 30, 2, 12]) FROM lines WHERE event_type = 'signup')"""
RUN = "OVER (PARTITION BY host ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

ORACLE_SQL = {
    "latest_records": f"WITH {LOG_SQL} SELECT key, value, expiration FROM log WHERE expiration > {T0} QUALIFY row_number() OVER (PARTITION BY key ORDER BY expiration DESC, arrival, value DESC) = 1",
    "latest_subrecords": f"""WITH {LOG_SQL}, l AS (SELECT * FROM log WHERE expiration > {T0} QUALIFY row_number() OVER (PARTITION BY key, subkey ORDER BY expiration DESC, arrival, value DESC) = 1)
        SELECT key, string_agg(subkey || '=' || printf('%.2f', value), ';' ORDER BY subkey) AS subs, max(expiration) AS expiration FROM l GROUP BY key""",
    "visible_count": f"WITH {LOG_SQL}, n AS (SELECT key, count(DISTINCT subkey) AS visible FROM log WHERE expiration > {T0} GROUP BY key) SELECT c_custkey AS key, coalesce(visible, 0) AS visible FROM customer LEFT JOIN n ON key = c_custkey",
    "evict_to_size": f"WITH {LOG_SQL}, l AS (SELECT key, value, expiration FROM log WHERE expiration > {T0} QUALIFY row_number() OVER (PARTITION BY key ORDER BY expiration DESC, arrival, value DESC) = 1) SELECT * FROM l ORDER BY expiration DESC, key LIMIT 50",
    "live_members": f"""SELECT event_id, 'p' || user_id AS peer, CASE WHEN event_id % 4 = 2 THEN 2 ELSE 0 END AS phase, CASE WHEN event_id % 4 = 2 THEN (event_id % 9)::INT END AS epoch
        FROM events WHERE event_id % 4 <> 1 AND event_id % 40 <> 3 AND ts + to_hours((event_id % 100)::INT) > {T0}""",
    "run_validators": """WITH f AS (SELECT event_id, props, CASE WHEN event_id % 11 = 0 OR event_id % 3 = 0 THEN 'signature' WHEN user_id % 10 = 9 THEN 'owner' WHEN event_id % 5 = 0 THEN 'schema' END AS failed FROM events)
      SELECT event_id, failed, CASE WHEN failed IS NULL THEN props END AS value FROM f""",
    "validate_records": "SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 'quarantine' ELSE 'valid' END AS state FROM events",
    "tier_lookup": "SELECT c_custkey, CASE WHEN c_acctbal >= 7500 THEN 'large' WHEN c_acctbal >= 2500 THEN 'medium' WHEN c_acctbal >= 0 THEN 'small' ELSE 'none' END AS tier FROM customer",
    "name_contains_lookup": """WITH k AS (SELECT DISTINCT p_type AS ref_name FROM part UNION SELECT DISTINCT split_part(p_type, ' ', 1) FROM part),
        n AS (SELECT p_partkey, trim(regexp_replace(lower(p_brand || ' - ' || p_type || ' - ' || p_name), '[^0-9a-z]+', ' ', 'g')) AS name FROM part)
        SELECT p_partkey, ref_name FROM n LEFT JOIN k ON contains(name, trim(regexp_replace(lower(ref_name), '[^0-9a-z]+', ' ', 'g')))
        QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(ref_name) DESC, ref_name DESC) = 1""",
    "pair_leases_receipts": """WITH l AS (SELECT event_id AS lease, user_id, event_id % 3 AS seq, ts FROM events WHERE event_type = 'view'), r AS (SELECT user_id, event_id % 3 AS seq, ts AS rts FROM events WHERE event_type = 'click')
        SELECT lease, CASE WHEN count(rts) = 0 THEN 'expired' ELSE 'settled' END AS state, CASE WHEN count(rts) > 0 THEN greatest(min(epoch_us(rts) - epoch_us(ts)) / 1e6, 1e-9) END AS interval_s
        FROM l LEFT JOIN r ON l.user_id = r.user_id AND l.seq = r.seq AND rts >= ts AND rts <= ts + INTERVAL 12 HOURS GROUP BY lease""",
    "exclude_banned": f"""SELECT event_id AS uid, user_id % 5 AS endpoint FROM events WHERE NOT (event_type = 'error' AND ts + to_days((event_id % 20)::INT) > {T0} AND event_id % 5 = user_id % 5 AND ts + to_days(10) <= ts + to_days((event_id % 20)::INT))""",
    "already_registered": f"WITH {LOG_SQL} SELECT c_custkey AS peer_id FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier) OR c_custkey IN (SELECT key FROM log WHERE expiration > {T0})",
    "verify_members": "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7",
    "swarm_progress": f"""WITH p AS (SELECT event_type, event_id % 13 AS epoch, floor(value)::BIGINT AS samples, round(value / 1000, 3) AS speed, ts AS time, user_id % 10 = 0 AS client_mode FROM events
          QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1),
        g AS (SELECT event_type, max(epoch) FILTER (NOT client_mode) AS global_epoch FROM p GROUP BY event_type),
        a AS (SELECT event_type, global_epoch, count(*) AS peers, count(*) FILTER (client_mode) AS clients, coalesce(sum(samples) FILTER (epoch >= global_epoch - 3), 0)::BIGINT AS total_samples, sum(speed) AS total_speed,
          coalesce(sum(samples + greatest(0, (epoch_us({T0}) - epoch_us(time)) / 1e6) * speed) FILTER (epoch >= global_epoch - 3), 0) AS estimated_samples FROM p JOIN g USING (event_type) GROUP BY ALL),
        e AS (SELECT *, greatest(0, 1e7 - estimated_samples) / total_speed AS eta_s FROM a)
        SELECT event_type, global_epoch, peers, clients, total_samples, round(total_speed, 3) AS total_speed, round(estimated_samples, 3) AS estimated_samples, round(eta_s, 3) AS eta_s,
        round(least(10, greatest(0.5, eta_s * peers / greatest(peers + 3, peers * 1.2))), 3) AS next_refresh_s FROM e""",
    "leaderboard": """WITH s AS (SELECT o_custkey AS peer, sum(o_totalprice / 1000) AS pflop, sum((o_orderkey % 24)::DOUBLE) AS hours FROM orders GROUP BY 1),
        p AS (SELECT c_nationkey AS account, peer, pflop + hours AS score FROM s JOIN customer ON c_custkey = peer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY hours DESC, peer) <= 5),
        t AS (SELECT account, sum(score) AS score, count(*) AS peers FROM p GROUP BY account) SELECT account, round(score, 3) AS score, peers, rank() OVER (ORDER BY score DESC)::INT AS "rank" FROM t""",
    "subset_by_rank": """WITH m AS (SELECT c_nationkey AS stage, c_mktsegment || '.' || c_custkey AS uid, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS p, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
        SELECT stage, uid FROM m WHERE (p - 35 % n + n) % n < 7""",
    "balanced_partitions": "SELECT c_nationkey, c_custkey, (ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INT AS part FROM customer",
    "join_rank": "WITH f AS (SELECT event_type, user_id AS uid, min(ts) AS joined FROM events GROUP BY 1, 2) SELECT event_type, uid, (row_number() OVER (PARTITION BY event_type ORDER BY joined, uid) - 1)::INT AS join_rank FROM f",
    "expire_batches": f"""WITH l AS (SELECT event_type AS cache, event_id % 500 AS key, ts, floor(value)::BIGINT AS nbytes FROM events QUALIFY row_number() OVER (PARTITION BY event_type, event_id % 500 ORDER BY ts DESC, floor(value) DESC) = 1),
        y AS (SELECT *, row_number() OVER w AS r, sum(nbytes) OVER w AS b FROM l WHERE (epoch_us({T0}) - epoch_us(ts)) / 1e6 < 864000 WINDOW w AS (PARTITION BY cache ORDER BY ts DESC, key DESC ROWS UNBOUNDED PRECEDING)) SELECT cache, key, nbytes FROM y WHERE r <= 200 AND b <= 9000""",
    "batch_ledger": """WITH o AS (SELECT 'h' || user_id AS origin, event_id % 4 AS seq, min(ts) AS ts FROM events WHERE event_type = 'view' GROUP BY 1, 2),
        r AS (SELECT o.*, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'dropped' ELSE 'loss' END AS kind, e.value, e.ts AS rts FROM o LEFT JOIN events e ON origin = 'h' || user_id AND seq = event_id % 4 AND event_type <> 'view' AND e.ts >= o.ts),
        a AS (SELECT origin, seq, count(*) FILTER (rts <= ts + INTERVAL 3 DAYS AND kind = 'dropped') AS d, count(*) FILTER (rts <= ts + INTERVAL 3 DAYS AND kind = 'done') AS n,
          arg_min(value, rts) FILTER (rts <= ts + INTERVAL 3 DAYS AND kind = 'done') AS l, max(rts) FILTER (rts <= ts + INTERVAL 3 DAYS) AS p, any_value(ts) AS o, count(*) FILTER (rts > ts + INTERVAL 3 DAYS) AS late_reports FROM r GROUP BY origin, seq)
        SELECT origin, seq, CASE WHEN d > 0 THEN 'dropped' WHEN n > 0 THEN 'done' WHEN coalesce(p, o) < o + INTERVAL 2 DAYS THEN 'dropped' ELSE 'timeout' END AS outcome, CASE WHEN d = 0 AND n > 0 THEN l END AS loss, late_reports FROM a""",
    "pool_stats": """SELECT date_trunc('hour', ts) AS window_start, event_type AS pool, count(*) AS batches, sum(event_id % 8 + 1)::BIGINT AS examples, round(avg(event_id % 8 + 1), 6) AS avg_batch_size, round(avg(value), 6) AS avg_await_ms,
        round(count(*) / 3600.0, 6)::DOUBLE AS batches_per_s, round(sum(event_id % 8 + 1) / 3600.0, 6)::DOUBLE AS examples_per_s FROM events GROUP BY 1, 2""",
    "client_stats": """SELECT date_trunc('hour', ts) AS window_start, count(*) AS requests, round(avg(value), 6) AS mean_latency, max(value) AS max_latency, count(*) FILTER (event_type = 'error') AS failures,
        count(*) FILTER (event_type = 'signup') AS retrys, count(*) FILTER (event_type = 'click') AS rejects, count(*) FILTER (event_type = 'view') AS expireds FROM events GROUP BY 1""",
    "resource_means": "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type AS host, round(avg(value) / 1000, 2) AS usage, count(*) AS samples FROM events GROUP BY 1, 2",
    "running_stats": "SELECT event_type, greatest(0, max(value)) AS \"max\", round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1",
    "peer_socket_summary": f"""WITH {EV}, a AS (SELECT host, count(*) AS n, list_sort(list(value)) AS r, list_sort(list(value * 2) FILTER (event_id % 3 > 0)) AS v, sum(event_id % 7)::BIGINT AS retrans_total, min(value * 2) FILTER (event_id % 3 > 0) AS delivery_min FROM ev GROUP BY host)
        SELECT host, n, r[least(len(r), 1 + round_even(0.5 * (len(r) - 1), 0)::INT)] AS rtt_p50, r[least(len(r), 1 + round_even(0.95 * (len(r) - 1), 0)::INT)] AS rtt_p95, retrans_total, v[least(len(v), 1 + round_even(0.5 * (len(v) - 1), 0)::INT)] AS delivery_p50, delivery_min FROM a""",
    "worst_peers": f"WITH {EV} SELECT host AS peer, sum(event_id % 7)::BIGINT AS retrans, round(max(value) - min(value), 6) AS excess_rtt FROM ev GROUP BY 1 ORDER BY 2 DESC, max(value) - min(value) DESC, 1 LIMIT 20",
    "flop_totals": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity) * 6.5e12 / 1e15, 3) AS pflop FROM lineitem GROUP BY 1, 2",
    "tokens_per_second": "SELECT date_trunc('hour', ts) AS window_start, sum(event_id % 5) * 512.0::DOUBLE / 3600 AS tokens_per_s FROM events GROUP BY 1",
    "median_latency_rounds": f"""WITH {EV}, r AS (SELECT host, (row_number() OVER (PARTITION BY host ORDER BY ts, event_id) - 1) // 8 AS round, value FROM ev), m AS (SELECT host, round, list_sort(list(value))[5] AS median FROM r GROUP BY 1, 2 HAVING count(*) = 8)
        SELECT host, round, median, round(8 * greatest(0, 1 - min(median) OVER (PARTITION BY host ORDER BY round) / median), 6) AS occupancy FROM m""",
    "pair_intervals": f"""WITH {EV}, m AS (SELECT *, lag(CASE WHEN event_type = 'view' THEN ts END) OVER (PARTITION BY host ORDER BY ts, event_id) AS b FROM ev WHERE event_type IN ('view', 'purchase'))
        SELECT event_id, round((epoch_us(ts) - epoch_us(b)) / 1000, 3) AS ms FROM m WHERE event_type = 'purchase' AND b IS NOT NULL""",
    "count_since_reset": f"""WITH {EV}, e AS (SELECT *, sum((event_type = 'purchase')::INT) {RUN} AS era FROM ev)
        SELECT event_id, row_number() OVER (PARTITION BY host, era ORDER BY ts, event_id) AS count, count >= 3 AS alert FROM e WHERE event_type = 'error'""",
    "windowed_count": f"""WITH {EV} SELECT event_id, sum((event_type = 'error')::INT) OVER (PARTITION BY host ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)::BIGINT AS count, count >= 3 AS alert FROM ev WHERE event_type IN ('error', 'purchase')""",
    "top_labels": f"""WITH {EV}, c AS (SELECT event_type, host, count(*) AS n, max(ts) AS last_seen FROM ev GROUP BY 1, 2) SELECT event_type, host, n, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, last_seen DESC, host)::INT AS "rank" FROM c QUALIFY "rank" <= 3""",
    "retransmit_shares": f"""WITH {EV}, l AS (SELECT event_id, floor(value)::BIGINT - lag(floor(value)::BIGINT) OVER w AS out_delta, floor(value / 7)::BIGINT - lag(floor(value / 7)::BIGINT) OVER w AS retrans_delta FROM ev WINDOW w AS (PARTITION BY host ORDER BY ts, event_id))
      SELECT *, round(CASE WHEN out_delta > 0 THEN 100.0::DOUBLE * retrans_delta / out_delta ELSE 0 END, 6) AS retrans_pct FROM l WHERE out_delta >= 0 AND retrans_delta >= 0""",
    "counter_deltas": f"""WITH {EV}, l AS (SELECT event_id, value * 1e6 - lag(value * 1e6) OVER w AS dv, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS dt FROM ev WINDOW w AS (PARTITION BY host ORDER BY ts, event_id))
        SELECT event_id, round(dv * 8 / dt / 1e6, 6) AS mbps FROM l WHERE dv >= 0 AND dt > 0""",
    "adjusted_ema": f"""WITH {EV}, b AS (SELECT host, value / (event_id % 4 + 1) AS x, row_number() OVER (PARTITION BY host ORDER BY ts DESC, event_id DESC) - 1 AS k FROM ev)
        SELECT host, count(*) AS updates, round(1 / greatest(sum(0.1 * pow(0.9, k) * x) / (1 - pow(0.9, count(*))), 1e-20), 6) AS samples_per_second FROM b GROUP BY host""",
    "running_totals": f"""WITH {EV} SELECT event_id, (sum(event_id % 5 * 512) {RUN})::BIGINT AS total_tokens, last_value(CASE WHEN event_type = 'view' AND value <> 0 THEN value END IGNORE NULLS) {RUN} AS last_loss FROM ev""",
    "activity_gap": f"""WITH {EV}, a AS (SELECT *, last_value(CASE WHEN event_type = 'click' THEN ts END IGNORE NULLS) OVER (PARTITION BY host ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS la FROM ev)
        SELECT event_id, round((epoch_us(ts) - epoch_us(la)) / 1e6, 3) AS gap_s FROM a WHERE (epoch_us(ts) - epoch_us(la)) / 1e6 > 86400""",
    "extract_metrics": f"WITH {LINES_SQL} SELECT kind, name, count(*) AS n, round(sum(value), 2) AS total FROM metrics GROUP BY 1, 2",
    "metric_lines": """SELECT event_id, CASE event_type WHEN 'click' THEN 'WARNING' WHEN 'error' THEN 'ERROR' ELSE 'INFO' END AS level, CASE event_type WHEN 'view' THEN 'T3' WHEN 'click' THEN 'T4' WHEN 'error' THEN 'T1' WHEN 'purchase' THEN 'T11' ELSE 'T21' END AS family FROM events""",
    "latest_gauges": f"WITH {LINES_SQL} SELECT host AS role, name, value FROM metrics WHERE kind = 'gauge' QUALIFY row_number() OVER (PARTITION BY host, name ORDER BY date_trunc('millisecond', ts) DESC, value DESC) = 1",
    "error_counters": f"WITH {LINES_SQL} SELECT host AS role, name, count(*) AS total FROM metrics WHERE kind = 'error' GROUP BY 1, 2",
    "error_capture": f"WITH {EV} SELECT event_id FROM ev WHERE event_type = 'error' AND event_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY host ORDER BY date_trunc('millisecond', ts), event_id) <= 3",
    "visible_lines": "SELECT event_id, CASE event_type WHEN 'click' THEN 'WARNING' ELSE 'ERROR' END AS tag FROM events WHERE event_type IN ('click', 'error')",
    "family_metrics": f"""WITH f(k, family, kind, name, value) AS (VALUES {", ".join(f"({k}, '{family}', '{kind}', '{name}', {value}::DOUBLE)" for k, (family, _, found) in enumerate(FAMILY_LINES) for kind, name, value in found)})
        SELECT event_id, family, kind, name, f.value AS value FROM events JOIN f ON event_id % {len(FAMILY_LINES)} = k""",
    "epoch_cycle_times": f"""WITH RECURSIVE {EV}, e AS (SELECT host, ts, CASE event_type WHEN 'view' THEN 'begin' ELSE 'transition' END AS event, event_id % 3 AS epoch,
        row_number() OVER (PARTITION BY host ORDER BY ts, CASE event_type WHEN 'view' THEN 'begin' ELSE 'transition' END, event_id % 3) AS i FROM ev WHERE event_type IN ('view', 'purchase')),
      f AS (SELECT host, i, ts, CASE WHEN event = 'begin' THEN epoch END AS be, CASE WHEN event = 'begin' THEN ts END AS bt, NULL::BIGINT AS te, NULL::TIMESTAMP AS tt,
          CASE WHEN event = 'transition' THEN 'error_missed_ar_step' END AS name, 1.0::DOUBLE AS value FROM e WHERE i = 1
        UNION ALL SELECT e.host, e.i, e.ts,
          CASE WHEN e.event = 'begin' THEN e.epoch WHEN f.be + 1 = e.epoch THEN f.be END, CASE WHEN e.event = 'begin' THEN e.ts WHEN f.be + 1 = e.epoch THEN f.bt END,
          CASE WHEN e.event = 'begin' THEN f.te WHEN f.be + 1 = e.epoch THEN e.epoch END, CASE WHEN e.event = 'begin' THEN f.tt WHEN f.be + 1 = e.epoch THEN e.ts END,
          CASE WHEN e.event = 'begin' THEN CASE WHEN f.te = e.epoch THEN 'grad_accum_time' END WHEN f.be + 1 = e.epoch THEN 'ar_time' ELSE 'error_missed_ar_step' END,
          CASE WHEN e.event = 'begin' THEN (epoch_us(e.ts) - epoch_us(f.tt)) / 1000.0 WHEN f.be + 1 = e.epoch THEN (epoch_us(e.ts) - epoch_us(f.bt)) / 1000.0 ELSE 1.0 END
          FROM f JOIN e ON e.host = f.host AND e.i = f.i + 1)
      SELECT host, ts, CASE name WHEN 'error_missed_ar_step' THEN 'error' ELSE 'duration' END AS kind, name, value FROM f WHERE name IS NOT NULL""",
    "utilisation_windows": f"""WITH RECURSIVE {EV}, a AS (SELECT host, min(ts) AS anchor FROM ev GROUP BY host
        UNION ALL SELECT a.host, min(ev.ts) FROM a JOIN ev ON ev.host = a.host AND ev.ts > a.anchor + INTERVAL 6 HOUR GROUP BY a.host, a.anchor),
      w AS (SELECT host, anchor, lead(anchor) OVER (PARTITION BY host ORDER BY anchor) AS closed FROM a)
      SELECT w.host, anchor, closed, round(sum(value), 6) AS total FROM w JOIN ev ON ev.host = w.host AND ts >= anchor AND ts < closed GROUP BY ALL""",
    "phase_timeline": f"""WITH RECURSIVE {EV}, e AS (SELECT host, event_id AS step, floor(value) > 60 AS stale, row_number() OVER (PARTITION BY host ORDER BY event_id) AS i FROM ev),
      f AS (SELECT host, i, step, CASE WHEN stale THEN 1 ELSE 0 END AS phase, CASE WHEN stale THEN 2 ELSE 0 END AS togo FROM e WHERE i = 1
        UNION ALL SELECT e.host, e.i, e.step, CASE WHEN phase = 0 THEN CASE WHEN stale THEN 1 ELSE 0 END WHEN togo > 0 THEN phase WHEN phase = 1 THEN 2 ELSE 0 END,
          CASE WHEN phase = 0 THEN CASE WHEN stale THEN 2 ELSE 0 END WHEN togo > 0 THEN togo - 1 WHEN phase = 1 THEN 1 ELSE 0 END FROM f JOIN e ON e.host = f.host AND e.i = f.i + 1)
      SELECT host, step, phase FROM f""",
    "latest_entries": f"""WITH RECURSIVE {LOG_SQL}, r AS (SELECT key, nullif(subkey, 'purchase') AS subkey, value, expiration, arrival,
        row_number() OVER (PARTITION BY key ORDER BY arrival, nullif(subkey, 'purchase') NULLS FIRST, value) AS i FROM log WHERE expiration >= arrival),
      f AS (SELECT key, i, expiration AS most, subkey IS NULL AS is_plain, i AS since FROM r WHERE i = 1
        UNION ALL SELECT r.key, r.i, greatest(most, r.expiration), CASE WHEN r.expiration > most AND r.subkey IS NULL THEN true WHEN r.expiration > most THEN false ELSE is_plain END,
          CASE WHEN r.expiration > most AND (r.subkey IS NULL OR is_plain) THEN r.i ELSE since END FROM f JOIN r ON r.key = f.key AND r.i = f.i + 1),
      l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY i DESC) = 1),
      s AS (SELECT r.* FROM l JOIN r ON r.key = l.key AND r.i >= l.since WHERE NOT l.is_plain AND r.subkey IS NOT NULL AND r.expiration > {T0}
        QUALIFY row_number() OVER (PARTITION BY r.key, r.subkey ORDER BY r.expiration DESC, r.arrival, r.value DESC) = 1)
      SELECT l.key, r.value AS plain, NULL::VARCHAR AS subs, r.expiration FROM l JOIN r ON r.key = l.key AND r.i = l.since WHERE l.is_plain AND r.expiration > {T0}
      UNION ALL SELECT key, NULL, string_agg(printf('%s=%.2f', subkey, value), ';' ORDER BY subkey), max(expiration) FROM s GROUP BY key""",
    "bounded_labels": """WITH c AS (SELECT 'r' || user_id % 5 AS role, 'ban' AS metric, 'ban_timeout_body1.0.' || user_id AS name, count(*)::DOUBLE AS n, max(date_trunc('millisecond', ts)) AS seen FROM events WHERE event_type = 'click' GROUP BY user_id
        UNION ALL SELECT 'r' || user_id % 5, 'w2w_push_fail', 'w2w_push_fail_body1.0.' || user_id, arg_max(event_id, (date_trunc('millisecond', ts), event_id))::DOUBLE, max(date_trunc('millisecond', ts)) FROM events WHERE event_type = 'signup' GROUP BY user_id)
      SELECT role, metric, name, n, row_number() OVER (PARTITION BY role, metric ORDER BY n DESC, seen DESC, name)::INT AS "rank" FROM c QUALIFY "rank" <= 3""",
    "own_addresses": "SELECT 'p' || c_custkey AS peer_id, '/ip4/10.0.0.' || c_nationkey || '/tcp/' || c_custkey % 100 AS addresses FROM customer",
    "group_candidates": "SELECT event_id, event_type = 'view' AS looking_for_group FROM events WHERE event_type IN ('view', 'click')",
    "state_donors": "SELECT 'head.0.' || s_suppkey AS uid, s_nationkey AS priority FROM supplier WHERE s_suppkey <> 5",
    "rate_to_mbps": "SELECT p_partkey, CASE p_partkey % 5 WHEN 4 THEN NULL ELSE round((p_size + 0.5)::DOUBLE * [1.0, 1e3, 1e6, 1e9][p_partkey % 5 + 1] / 1e6, 9) END AS mbps FROM part",
    "successor_stage": "SELECT s_suppkey, ['head', 'body1', 'body2', 'tail'][s_suppkey % 4 + 1] AS stage, ['body1', 'body2', 'tail', NULL][s_suppkey % 4 + 1] AS next_stage FROM supplier",
    "flop_per_sample": "SELECT p_partkey, (2.0 * p_size * 1e6 + 4.0 * 32 * 16 * 128 * 4096)::DOUBLE * 4096 AS forward, (4.0 * p_size * 1e6 + 8.0 * 32 * 16 * 128 * 4096)::DOUBLE * 4096 AS backward FROM part",
    "ttl_seconds": f"WITH {LOG_SQL} SELECT subkey, sum(greatest(0, (epoch_us(expiration) - epoch_us({T0})) / 1e6)) AS ttl_s, count(*) AS n FROM log GROUP BY subkey",
}
