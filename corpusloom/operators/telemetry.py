"""Log lines to metrics, and ordered analytics over metrics and events.

A parsed line has ``ts, level, msg`` and the whole ``line``; a metric is ``kind`` (gauge, duration, error), ``name``, ``value``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import scalar
from corpusloom.plans.folds import ordered_fold, phases, window_sums
from corpusloom.plans.ranking import at_ranks


@dataclass(frozen=True)
class Rule:
    """``hint`` is text that every matching line holds; ``metrics`` are (kind, name, group) with group 0 for the value 1.

    A name ending in ``{k}`` takes group k; ``falls_through`` lets later rules see the line too.
    """

    family: str
    hint: str
    pattern: str
    metrics: tuple[tuple[str, str, int], ...]
    falls_through: bool = False


def gauges(*names: str) -> tuple[tuple[str, str, int], ...]:
    return tuple(("gauge", n, i + 1) for i, n in enumerate(names))


def error(name: str) -> tuple[tuple[str, str, int], ...]:
    return (("error", name, 0),)


# The line formats and metric names of the fleet's logs, in the order in which they are tried.
RULES: tuple[Rule, ...] = (
    Rule("T1", "TimeoutError", r"(?s)Failed to load state from peers.*TimeoutError", error("error_loadtimeout")),
    Rule("T1", "inplace operation", r"\bone of the variables needed for gradient computation has been modified by an inplace operation\b", error("error_grad_version")),
    Rule("T1", "Accumulate buffer", r"Accumulate buffer full, no sentinel added", error("error_ar_accumulate_buffer_full")),
    Rule("T1", "Read stream", r"Read stream closed early from sender", error("error_ar_stream_closed_early")),
    Rule("T1", "Dropping", r"Dropping (?:Metadata Store|address-book) record", error("error_ms_verification_drop")),
    Rule("T1", "FAILURE SIM", r"\[FAILURE SIM\] Case \d+: .* to peer \d+", error("failure_sim_ar")),
    Rule("T1", "FAILURE SIM", r"\[FAILURE SIM\] Inducing failure case \d+", error("failure_sim_mm")),
    Rule("T1", "ERROR", r"ERROR", error("error_unknown")),
    Rule("T2", "Pre Max", r"Pre Max total_grad:\s*([\d.]+)", gauges("pre_max_grad")),
    Rule("T2", "Pre Avg", r"Pre Avg total_grad:\s*([\d.]+)", gauges("pre_avg_grad")),
    Rule("T2", "Error norm", r"Error norm val:\s*([\d.]+)", gauges("error_psgd_grad")),
    Rule("T2", "Error pre-clip", r"Error pre-clip norm val:\s*([\d.]+)", gauges("error_pre_psgd_grad")),
    Rule("T2", "Prepsgd", r"Prepsgd norm val:\s*([\d.]+)", gauges("pre_psgd_grad")),
    Rule("T2", "Postpsgd", r"Postpsgd norm val:\s*([\d.]+)", gauges("post_psgd_grad")),
    Rule("T2", "Pre step", r"Pre step total_grad:\s*([\d.]+)", gauges("pre_step_grad")),
    Rule("T2", "Post step", r"Post step total_grad:\s*([\d.]+)", gauges("post_step_grad")),
    Rule("T3", "num batches process", r"num batches process = (\d+)", gauges("head_batches"), falls_through=True),
    Rule("T3", "train loss", r"train loss = ([0-9]+\.?[0-9]*)", gauges("head_loss")),
    Rule("T3", "total_tokens_processed", r"total_tokens_processed = (\d+)", gauges("head_total_tokens")),
    Rule("T4", "Banned expert", r"Banned expert\s+([\w.]+)\s+reason=(\w+)\s+duration=([\d.]+)s", (("label", "ban_{2}_{1}", 0),)),
    Rule("T5", "[GhostPhase]", r"\[GhostPhase\] phase: (\d)", gauges("ghost_phase")),
    Rule("T6", "GPU mem size", r"GPU mem size is (\d+)Gb", gauges("gpu_total")),
    Rule("T6", "Allocated GPU", r"Allocated GPU mem is (0\.\d+)", gauges("gpu_alloc")),
    Rule("T6", "Reserved GPU", r"Reserved GPU mem is (0\.\d+)", gauges("gpu_reserve")),
    Rule("T6", "GPU utilization", r"GPU utilization is (\d+\.?\d*)", gauges("gpu_util")),
    Rule("T6", "Total RAM", r"Total RAM mem is (\d+)Gb", gauges("ram_total")),
    Rule("T6", "Used RAM", r"Used RAM mem is (0\.\d+)", gauges("ram_usage")),
    Rule("T6", "CPU load", r"CPU load is (\d+\.\d+)", gauges("cpu_load")),
    Rule("T7", "Latency:", r"Latency:\s*([\d.]+)\s*ms", gauges("latency_rtt")),
    Rule("T7", "Download Speed", r"Download Speed:\s*([\d.]+)\s*Mbps", gauges("download_speed")),
    Rule("T7", "Upload Speed", r"Upload Speed:\s*([\d.]+)\s*Mbps", gauges("upload_speed")),
    Rule("T8", "see", r"see\s+(\d+)\s+of\s+([a-zA-Z0-9]+)\.", (("gauge", "peer_vis_{2}", 1),)),
    Rule("T9", "Sent", r"(?s)^(?=.*Sent\s+(\d+\.\d+))(?=.*Rcv\s+(\d+\.\d+))", gauges("send_comm", "recv_comm")),
    Rule("T10", "open connections", r"Number open connections (-?\d+)", gauges("open_conns")),
    Rule("T11", "TCP retransmit", r"TCP retransmit: (\d+) of (\d+) segs retransmitted \(([\d.]+)%\) cc=(\S+)", (*gauges("tcp_retrans_segs", "tcp_out_segs", "tcp_retrans_pct"), ("gauge", "cc_default_{4}", 0))),
    Rule(
        "T12",
        "TCP peers",
        r"TCP peers: n=(\d+) rtt_p50_ms=([\d.]+|-) rtt_p95_ms=([\d.]+|-) retrans_total=(\d+) delivery_rate_p50_mbps=([\d.]+|-) delivery_rate_min_mbps=([\d.]+|-)",
        (("gauge", "tcp_peer_count", 1), ("duration", "tcp_peer_rtt_p50", 2), ("duration", "tcp_peer_rtt_p95", 3), ("gauge", "tcp_peer_retrans_total", 4), ("gauge", "tcp_peer_delivery_p50", 5), ("gauge", "tcp_peer_delivery_min", 6)),
    ),
    Rule(
        "T13",
        "[Metadata Store Client Stats]",
        r"\[Metadata Store Client Stats\] Last 60s - requests: (\d+), mean_latency: ([\d.]+)ms, max_latency: ([\d.]+)ms, failures: (\d+), retries: (\d+)(?:, rejects: (\d+), dropped_expired: (\d+))?",
        (("gauge", "ms_client_requests", 1), ("duration", "ms_client_mean_latency", 2), ("duration", "ms_client_max_latency", 3), ("gauge", "ms_client_failures", 4), ("gauge", "ms_client_retries", 5), ("gauge_or_0", "ms_client_rejects", 6), ("gauge_or_0", "ms_client_dropped_expired", 7)),
    ),
    Rule(
        "T14",
        "[ActCache]",
        r"\[ActCache\] entries: (\d+), bytes: (\d+), puts: (\d+), hits: (\d+), misses: (\d+), evictions_fifo: (\d+), evictions_ttl: (\d+), overwrites: (\d+), drops: (\d+)",
        gauges("act_cache_entries", "act_cache_bytes", "act_cache_puts", "act_cache_hits", "act_cache_misses", "act_cache_evictions_fifo", "act_cache_evictions_ttl", "act_cache_overwrites", "act_cache_drops"),
    ),
    Rule("T15", "[W2WHop]", r"\[W2WHop\] next_hops_learned: (\d+), prev_hops_learned: (\d+), parse_errors: (\d+)", gauges("w2w_next_hops_learned", "w2w_prev_hops_learned", "w2w_next_hop_parse_error")),
    Rule("T16", "[W2WInject]", r"\[W2WInject\] window: (\d+), occupancy: ([\d.]+)", gauges("w2w_inflight_window", "w2w_queue_occupancy")),
    Rule(
        "T17",
        "[W2WSend]",
        r"\[W2WSend\] entries: (\d+), accepted_forward: (\d+), accepted_backward: (\d+), busy: (\d+), forward_pushes: (\d+), backward_pushes: (\d+), busy_retries: (\d+), drops: (\d+), push_errors: (\d+)",
        gauges("w2w_send_entries", "w2w_send_accepted_forward", "w2w_send_accepted_backward", "w2w_send_busy", "w2w_send_forward_pushes", "w2w_send_backward_pushes", "w2w_send_busy_retries", "w2w_send_drops", "w2w_send_push_errors"),
    ),
    Rule("T18", "[HandlerLiveness]", r"\[HandlerLiveness\] stale: (\d+), ages_s: (\d+\.\d(?:/\d+\.\d)*)", (("gauge", "handler_stale_count", 1), ("max", "handler_max_age_s", 2))),
    Rule("T19", "accumulated", r"accumulated (\d+) samples", gauges("batch_step")),
    Rule("T20", "_forward:", r"\.\d+\.\d+_forward:\s*(\d+)", gauges("forward_batches"), falls_through=True),
    Rule("T20", "_backward:", r"\.\d+\.\d+_backward:\s*(\d+)", gauges("backward_batches"), falls_through=True),
    Rule("T21", "_forward:", r"_forward:.*?(\d+)\s+examples.*?avg batch size ([\d.]+).*?avg batch await time (\d+)", (("gauge", "avg_batch_size", 2), ("duration", "batch_await_time", 3))),
    Rule("T21", "_backward:", r"_backward:.*?(\d+)\s+examples.*?avg batch size ([\d.]+).*?avg batch await time (\d+)", (("gauge", "avg_batch_size", 2), ("duration", "batch_await_time", 3))),
    Rule("T22", "Processed", r"Processed (\d+) batches", (("flush", "flop", 1),)),
    Rule("T23", "Formed group", r"Formed group with (\d+) peers out of (\d+) in ([\d.]+) secs", gauges("formed_groupsize", "max_groupsize", "mm_time")),
    Rule("T24", "Averaging gradients", r"INFO - Averaging gradients failed with TimeoutError\(\)", (("gauge", "grad_avg_timeout", 0), ("zero", "grad_avg_groupsize", 0))),
    Rule("T24", "Averaging parameters", r"INFO - Averaging parameters failed with TimeoutError\(\)", (("gauge", "state_avg_timeout", 0),)),
    Rule("T24", "Averaging gradients", r"INFO - Averaging gradients failed with AllreduceException\('Averaging step failed: could not find a group'\)", (("zero", "grad_avg_groupsize", 0),)),
    Rule("T24", "Averaged gradients", r"INFO - Averaged gradients with (\d+) peers", (("gauge", "grad_avg_groupsize", 1), ("zero", "grad_avg_timeout", 0))),
    Rule("T25", "Averaging: received", r"Averaging: received (\d+(?:\.\d+)?)%", gauges("average_pcnt")),
    Rule("T25", "Reducer: received", r"Reducer: received (\d+(?:\.\d+)?)%", gauges("reducer_pcnt")),
    Rule("T26", "Failed to receive", r"Failed to receive tensors from peer \S+: \d+ failures, reason=(\w+)", error("ar_peer_failure_{1}")),
    Rule("T26", "Banned sender", r"Banned sender \S+: reason=(\w+)", error("ar_sender_banned_{1}")),
    Rule("T26", "Rejected request", r"Rejected request from \S+: reason=(\w+)", error("ar_request_rejected_{1}")),
    Rule("T28", "All-reduce round", r"INFO - All-reduce round started at local epoch #(\d+)", (("event", "state_ar_start", 1),)),
    Rule("T27", "AR yield", r"AR yield blocked ([0-9.]+)s for sender \d+ \(inbound_qsize=(\d+)/\d+\)", (("duration", "ar_yield_stall", 1), ("gauge", "ar_in_qsize", 2))),
    Rule("T27", "AR barrier", r"AR barrier wait ([0-9.]+)s on part \d+ sender \d+", (("duration", "ar_barrier_wait", 1),)),
    Rule("T27", "AR queue", r"AR queue stats sender \d+: inbound max=(\d+)/\d+ mean=([0-9.]+)", gauges("ar_in_qsize_max", "ar_in_qsize_mean")),
    Rule("T27", "AR chunk", r"AR chunk gap stats sender \d+: max=([0-9.]+)s mean=([0-9.]+)s n=\d+", gauges("ar_chunk_gap_max", "ar_chunk_gap_mean")),
    Rule("T28", "All-reduce round", r"INFO - All-reduce round finished at local epoch #(\d+)", (("event", "state_ar_end", 1),)),
    Rule("T28", "Beginning optimizer", r"INFO - Beginning optimizer step #(\d+)", (("gauge", "step", 1), ("event", "ar_begin", 1))),
    Rule("T28", "Transitioning", r"INFO - Transitioning to epoch (\d+)", (("event", "ar_transition", 1),)),
)
PER_TARGET = r"\[W2WSend\] .*, per_target: ((?:[\w.]+=\d+)(?: [\w.]+=\d+)*)"
# How records begin, on the console and in files (where a block tells who wrote a warning or worse).
HEAD = r"^(?:\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d{3} - \w+ - |[A-Z][a-z]{2} \d\d \d\d:\d\d:\d\d\.\d{3} \[\w+\] )"
LINE = r"(?s)^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d{3}) - (\w+) - (.*)$"
FILE_LINE = r"(?s)^([A-Z][a-z]{2} \d\d \d\d:\d\d:\d\d\.\d{3}) \[(\w+)\] (?:(?<=(?:WARNING|ERROR|CRITICAL)\] )\[([^\]]*)\] )?(.*)$"


def parse_lines(df: DataFrame, line: str = "value", year: int | None = None) -> DataFrame:
    """Split ``timestamp - LEVEL - message`` or ``timestamp [LEVEL] [caller] message`` into ``ts, level, caller, msg``.

    The second form has no year: without ``year`` it has no ``ts``.  A line that fits neither keeps its text as message.
    """
    part = [F.regexp_extract(line, LINE, k) for k in (1, 2, 3)]
    own = [F.regexp_extract(line, FILE_LINE, k) for k in (1, 2, 3, 4)]
    fits, filed = F.col(line).rlike(LINE), F.col(line).rlike(FILE_LINE)
    at = scalar.parse_log_ts(F.date_format(F.try_to_timestamp(F.concat(F.lit(f"{year} "), own[0]), F.lit("yyyy MMM dd HH:mm:ss.SSS")), "yyyy-MM-dd HH:mm:ss,SSS")) if year else F.lit(None)
    pick = lambda a, b: F.when(fits, a).when(filed, b)
    return df.withColumns(
        {"ts": pick(scalar.parse_log_ts(part[0]), at), "level": pick(part[1], own[1]), "caller": F.when(filed & ~fits, F.nullif(own[2], F.lit(""))), "msg": F.coalesce(pick(part[2], own[3]), F.col(line)), "line": F.col(line)}
    )


def _matches(rule: Rule, line: Column) -> Column:
    return line.contains(rule.hint) & line.rlike(rule.pattern)


def classify_lines(df: DataFrame, rules: Sequence[Rule] = RULES, line: str = "line") -> DataFrame:
    """Add ``rule``: the number of the first rule that stops at the line, or null."""
    found = F.lit(None).cast("int")
    for number in range(len(rules) - 1, -1, -1):
        if not rules[number].falls_through:
            found = F.when(_matches(rules[number], F.col(line)), F.lit(number)).otherwise(found)
    return df.withColumn("rule", found)


def _metric(rule: Rule, kind: str, name: str, group: int, line: Column) -> Column:
    get = lambda k: F.regexp_extract(line, rule.pattern, k)
    parts = []
    rest = name
    while "{" in rest:
        before, _, rest = rest.partition("{")
        k, _, rest = rest.partition("}")
        parts += [F.lit(before), get(int(k))]
    label = F.concat(*parts, F.lit(rest)) if parts else F.lit(name)
    if kind == "zero":
        kind, value = "gauge", F.lit(0.0)
    elif kind == "max":
        kind, value = "gauge", scalar.max_age(get(group))
    elif kind == "gauge_or_0":
        kind, value = "gauge", F.coalesce(get(group).try_cast("double"), F.lit(0.0))
    else:
        value = get(group).try_cast("double") if group else F.lit(1.0)
    return F.struct(F.lit(kind).alias("kind"), label.alias("name"), value.alias("value"))


def extract_metrics(df: DataFrame, rules: Sequence[Rule] = RULES, line: str = "line") -> DataFrame:
    """One row per metric of each line: ``kind, name, value`` beside the line's columns.

    The first rule that matches ends a line, except for those that fall through.  Absent values ("-", or a loss of 0) give none.
    """
    text = F.col(line)
    numbered = classify_lines(df, rules, line)
    empty = F.array().cast("array<struct<kind:string,name:string,value:double>>")
    main = empty
    for number in range(len(rules) - 1, -1, -1):
        rule = rules[number]
        if not rule.falls_through:
            main = F.when(F.col("rule") == number, F.array(*[_metric(rule, *m, text) for m in rule.metrics])).otherwise(main)
    extra = []
    for number, rule in enumerate(rules):
        if rule.falls_through:
            seen = (F.col("rule").isNull() | (F.col("rule") > number)) & _matches(rule, text)
            extra.append(F.when(seen, F.array(*[_metric(rule, *m, text) for m in rule.metrics])).otherwise(empty))
    both = next((i for i, r in enumerate(rules) if r.family == "T9"), None)
    if both is not None:
        total = F.aggregate(main, F.lit(0.0), lambda s, m: s + m["value"])
        extra.append(F.when(F.col("rule") == both, F.array(F.struct(F.lit("gauge").alias("kind"), F.lit("tot_comm").alias("name"), total.alias("value")))).otherwise(empty))
    send = next((i for i, r in enumerate(rules) if r.family == "T17"), None)
    if send is not None:
        pairs = F.split(F.regexp_extract(text, PER_TARGET, 1), " ")
        failed = F.transform(F.filter(pairs, lambda p: p != ""), lambda p: F.struct(F.lit("label").alias("kind"), F.concat(F.lit("w2w_push_fail_"), F.split_part(p, F.lit("="), F.lit(1))).alias("name"), F.split_part(p, F.lit("="), F.lit(2)).cast("double").alias("value")))
        extra.append(F.when(F.col("rule") == send, failed).otherwise(empty))
    out = numbered.withColumn("_m", F.explode(F.concat(main, *extra)))
    kept = [c for c in df.columns if c not in ("kind", "name", "value")]
    out = out.select(*kept, F.col("_m.kind").alias("kind"), F.col("_m.name").alias("name"), F.col("_m.value").alias("value"))
    return out.where(F.col("value").isNotNull() & ~((F.col("name") == "head_loss") & (F.col("value") == 0)))


def error_capture(df: DataFrame, most: int = 10, by: Sequence[str] = ("host",)) -> DataFrame:
    """The first ``most`` unknown errors of each group that carry a timestamp (a limit that is the feature)."""
    known = [r for r in RULES if r.family == "T1"][:-1]
    unknown = F.col("line").contains("ERROR")
    for rule in known:
        unknown = unknown & ~_matches(rule, F.col("line"))
    rows = df.where(unknown & F.col("ts").isNotNull())
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("ts", "line"))).where(F.col("_k") <= most).drop("_k")


def latest_gauges(metrics: DataFrame, by: Sequence[str] = ("role", "name")) -> DataFrame:
    """Last value per role and operation; of equal times the largest."""
    return metrics.groupBy(*by).agg(F.max(F.struct("ts", "value")).alias("_l")).select(*by, F.col("_l.value").alias("value"), F.col("_l.ts").alias("ts"))


def error_counters(metrics: DataFrame, by: Sequence[str] = ("role", "name")) -> DataFrame:
    return metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))


def pool_stats(df: DataFrame, window: str = "60 seconds") -> DataFrame:
    """Per window and pool, of ``pool, ts, batch_size, await_ms``: batches, examples, averages and rates."""
    length = pd.Timedelta(window).total_seconds()
    rows = df.groupBy(F.window("ts", window).alias("w"), "pool").agg(F.count(F.lit(1)).alias("batches"), F.sum("batch_size").alias("examples"), F.avg("batch_size").alias("avg_batch_size"), F.avg("await_ms").alias("avg_await_ms"))
    return rows.select(F.col("w.start").alias("window_start"), "pool", "batches", "examples", "avg_batch_size", "avg_await_ms", (F.col("batches") / length).alias("batches_per_s"), (F.col("examples") / length).alias("examples_per_s"))


def client_stats(df: DataFrame, window: str = "60 seconds") -> DataFrame:
    """Per window, of ``ts, latency_ms, outcome``: requests, latencies, failures, retries, rejects, expired drops."""
    rows = df.groupBy(F.window("ts", window).alias("w")).agg(
        F.count(F.lit(1)).alias("requests"),
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("mean_latency"),
        F.coalesce(F.max("latency_ms"), F.lit(0.0)).alias("max_latency"),
        *[F.count_if(F.col("outcome") == x).alias(f"{x}s") for x in ("failure", "retry", "reject", "expired")],
    )
    return rows.select(F.col("w.start").alias("window_start"), *[c for c in rows.columns if c != "w"])


def resource_means(df: DataFrame, window: str = "15 seconds") -> DataFrame:
    """Per window and host, mean of ``used`` over ``capacity``, two decimals."""
    rows = df.groupBy(F.window("ts", window).alias("w"), "host").agg(F.round(F.avg("used") / F.max("capacity"), 2).alias("usage"), F.count(F.lit(1)).alias("samples"))
    return rows.select(F.col("w.start").alias("window_start"), "host", "usage", "samples")


def running_stats(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.greatest(F.lit(0.0), F.max(value)).alias("max"), F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.count(value).alias("n"))


def peer_socket_summary(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per host, of one row per peer: count, round-trip quantiles by nearest rank, retransmits, delivery rates.

    A host may have any number of rows: the quantiles come from ranks by buckets of values, for both columns at once.
    """

    def ranks(n: Column) -> Column:
        return F.array(*[F.least(n - 1, F.bround(F.lit(f) * (n - 1)).cast("long")) for f in (0.5, 0.95)])

    rows = df.groupBy(F.struct(*by).alias("_by")).agg(F.count(F.lit(1)).alias("n"), F.sum("retrans").alias("retrans_total"), F.min("delivery_mbps").alias("delivery_min"))
    long = df.select(F.struct(*by).alias("_by"), F.explode(F.array(*[F.struct(F.lit(c).alias("of"), F.col(c).cast("double").alias("x")) for c in ("rtt_ms", "delivery_mbps")])).alias("_v")).select("_by", "_v.*")
    found = at_ranks(long, ["_by", "of"], "x", ranks)
    at = found.groupBy("_by").agg(*[F.max(F.when(F.col("of") == c, F.col("at"))).alias(f"_{c}") for c in ("rtt_ms", "delivery_mbps")])
    kind = dict(df.dtypes)
    value = lambda c, i: F.get(f"_{c}", F.lit(i)).cast(kind[c])
    met = rows.join(at, "_by", "left")
    return met.select("_by.*", "n", value("rtt_ms", 0).alias("rtt_p50"), value("rtt_ms", 1).alias("rtt_p95"), "retrans_total", value("delivery_mbps", 0).alias("delivery_p50"), "delivery_min")


def worst_peers(df: DataFrame, k: int) -> DataFrame:
    """The ``k`` peers with most retransmits, then most delay (a top-k report)."""
    rows = df.groupBy("peer").agg(F.sum("retrans").alias("retrans"), (F.max("rtt_ms") - F.min("rtt_ms")).alias("excess_rtt"))
    return rows.orderBy(F.col("retrans").desc(), F.col("excess_rtt").desc(), "peer").limit(k)


def flop_totals(df: DataFrame, by: Sequence[str], examples: str, factor: float) -> DataFrame:
    return df.groupBy(*by).agg((F.sum(examples) * F.lit(factor) / 1e15).alias("pflop"))


def tokens_per_second(df: DataFrame, seq: int, window_s: int) -> DataFrame:
    rows = df.groupBy(F.window("ts", f"{window_s} seconds").alias("w")).agg((F.sum("batches") * F.lit(float(seq)) / window_s).alias("tokens_per_s"))
    return rows.select(F.col("w.start").alias("window_start"), "tokens_per_s")


def median_latency_rounds(df: DataFrame, n: int, by: Sequence[str], order: Sequence[str], value: str = "latency") -> DataFrame:
    """Rounds of ``n`` completions: upper median, and occupancy n*max(0, 1 - best median so far/median)."""
    number = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    rows = df.withColumn("round", F.floor(number / n).cast("long")).groupBy(*by, "round").agg(F.array_sort(F.collect_list(value)).alias("_v"))
    rows = rows.where(F.size("_v") == n).withColumn("median", F.element_at("_v", n // 2 + 1))
    best = F.min("median").over(Window.partitionBy(*by).orderBy("round").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(*by, "round", "median", (F.lit(float(n)) * F.greatest(F.lit(0.0), 1 - best / F.col("median"))).alias("occupancy"))


def pair_intervals(df: DataFrame, by: Sequence[str], start: Column, end: Column, order: Sequence[str] = ("ts",)) -> DataFrame:
    """From the last start before each end, to that end; a start is used once.  Rows: the end's columns and ``ms``."""
    marks = df.withColumns({"_s": start, "_e": end}).where("_s or _e")
    # An end clears the start, so what counts is whether the mark just before an end is a start.
    before = F.lag(F.when(F.col("_s"), F.col("ts"))).over(Window.partitionBy(*by).orderBy(*order))
    rows = marks.withColumn("_before", before).where("_e and _before is not null")
    return rows.withColumn("ms", scalar.ms_between(F.col("_before"), F.col("ts"))).drop("_s", "_e", "_before")


def count_since_reset(df: DataFrame, by: Sequence[str], match: Column, reset: Column, threshold: int, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Running count of matches since the last reset, and whether it has reached the threshold."""
    along = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumns({"_m": match, "_era": F.sum(reset.cast("int")).over(along)})
    since = Window.partitionBy(*by, "_era").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("count", F.sum(F.col("_m").cast("int")).over(since)).where("_m").withColumn("alert", F.col("count") >= threshold).drop("_m", "_era")


def windowed_count(df: DataFrame, by: Sequence[str], match: Column, reset: Column, n: int, threshold: int, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Matches among the last ``n`` matches and resets."""
    rows = df.withColumn("_flag", F.when(match, 1).when(reset, 0)).where("_flag is not null")
    last = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(n - 1), 0)
    return rows.withColumn("count", F.sum("_flag").over(last)).withColumn("alert", F.col("count") >= threshold).drop("_flag")


def top_labels(df: DataFrame, by: Sequence[str], label: str, most: int = 3, count: Column | None = None) -> DataFrame:
    """Per metric the ``most`` labels with the highest counts, ties to the last updated (a top-k report).

    A row counts 1; ``count`` is another aggregate, such as the last value of labels that carry a cumulative count.
    """
    counts = df.groupBy(*by, label).agg((F.count(F.lit(1)) if count is None else count).alias("n"), F.max("ts").alias("last_seen"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("n").desc(), F.col("last_seen").desc(), label))
    return counts.withColumn("rank", rank).where(F.col("rank") <= most)


#: Metrics whose labels name peers: bans add up, failed pushes tell their total each time.
LABEL_METRICS = {"ban": F.sum, "w2w_push_fail": lambda value: F.max_by(value, F.struct("ts", value))}


def bounded_labels(metrics: DataFrame, by: Sequence[str] = ("role",), most: int = 3) -> DataFrame:
    """Of ``label`` metrics, per metric of its own the ``most`` labels with the highest count: ``by, metric, name, n, last_seen, rank``."""
    out = None
    for metric, count in LABEL_METRICS.items():
        own = metrics.where((F.col("kind") == "label") & F.startswith("name", F.lit(f"{metric}_"))).withColumn("metric", F.lit(metric))
        found = top_labels(own, [*by, "metric"], "name", most, count(F.col("value")))
        out = found if out is None else out.unionByName(found)
    return out


# The batches that a worker has done, with their direction and examples.
WORK = r"_(forward|backward):.*?(\d+)\s+examples.*?avg batch size [\d.]+.*?avg batch await time \d+"


def worked_examples(parsed: DataFrame) -> DataFrame:
    """``direction, examples`` beside the columns of lines that report finished batches."""
    rows = classify_lines(parsed)
    numbers = [i for i, r in enumerate(RULES) if r.family == "T21"]
    return rows.where(F.col("rule").isin(numbers)).withColumns({"direction": F.regexp_extract("line", WORK, 1), "examples": F.regexp_extract("line", WORK, 2).try_cast("double")}).drop("rule")


def flop_flushes(parsed: DataFrame, by: Sequence[str], flop: dict[str, float]) -> DataFrame:
    """``ts, value`` per "Processed N batches" line: PFLOP of the batches since the line before, where there were any.

    ``flop`` is what one example costs by direction.  Work after the last such line is not told yet.
    """
    work = worked_examples(parsed).select(*by, "ts", "line", F.lit(False).alias("_flush"), F.col("examples") * F.when(F.col("direction") == "forward", flop["forward"]).otherwise(flop["backward"]))
    work = work.toDF(*by, "ts", "line", "_flush", "_flop")
    number = next(i for i, r in enumerate(RULES) if r.family == "T22")
    flush = classify_lines(parsed).where(F.col("rule") == number).select(*by, "ts", "line", F.lit(True).alias("_flush"), F.lit(None).cast("double").alias("_flop"))
    before = Window.partitionBy(*by).orderBy("ts", "_flush", "line").rowsBetween(Window.unboundedPreceding, -1)
    rows = work.unionByName(flush).withColumn("_era", F.coalesce(F.sum(F.col("_flush").cast("int")).over(before), F.lit(0)))
    sums = rows.groupBy(*by, "_era").agg(F.max(F.when(F.col("_flush"), F.col("ts"))).alias("ts"), F.sum("_flop").alias("_flop"))
    return sums.where("ts is not null and _flop is not null").select(*by, "ts", (F.col("_flop") / 1e15).alias("value"))


def counter_deltas(df: DataFrame, by: Sequence[str], counter: str, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Deltas of a byte counter as Mbps; a counter that went back was reset and gives no row."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumns({"_d": F.col(counter) - F.lag(counter).over(w), "_t": (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) / 1e6})
    return rows.where("_d >= 0 and _t > 0").withColumn("mbps", F.col("_d") * 8 / F.col("_t") / 1e6).drop("_d", "_t")


def retransmit_shares(df: DataFrame, by: Sequence[str], out: str, retrans: str, order: Sequence[str] = ("ts",)) -> DataFrame:
    """``out_delta, retrans_delta, retrans_pct`` between readings of two counters; where either went back there is no row, and nothing sent is 0 %."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = df.withColumns({f"{name}_delta": F.col(c) - F.lag(c).over(w) for name, c in (("out", out), ("retrans", retrans))})
    share = F.when(F.col("out_delta") > 0, 100.0 * F.col("retrans_delta") / F.col("out_delta")).otherwise(0.0)
    return rows.where("out_delta >= 0 and retrans_delta >= 0").withColumn("retrans_pct", share)


def adjusted_ema(df: DataFrame, by: Sequence[str], interval: str, size: str, alpha: float, eps: float = 1e-20, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Bias-corrected mean time per sample, as samples per second, after all rows of each key.

    The recurrence s = a*x + (1-a)*s is a weighted sum, so no fold is needed: row i of n weighs a*(1-a)^(n-i).
    """
    w = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    rows = df.withColumn("_back", F.row_number().over(w) - 1)
    weight = F.lit(alpha) * F.pow(F.lit(1 - alpha), F.col("_back"))
    out = rows.groupBy(*by).agg(F.sum(weight * F.col(interval) / F.col(size)).alias("_s"), F.count(F.lit(1)).alias("updates"))
    mean = F.col("_s") / (1 - F.pow(F.lit(1 - alpha), F.col("updates")))
    return out.select(*by, "updates", (1 / F.greatest(mean, F.lit(eps))).alias("samples_per_second"))


def running_totals(df: DataFrame, by: Sequence[str], batches: str, loss: str, seq: int, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Cumulative tokens, and the last loss that is not 0."""
    along = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"total_tokens": F.sum(F.col(batches) * F.lit(seq)).over(along), "last_loss": F.last(F.nullif(F.col(loss), F.lit(0.0)), ignorenulls=True).over(along)})


def activity_gap(df: DataFrame, by: Sequence[str], active: Column, timeout_s: float, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Rows that come more than ``timeout_s`` after the last activity line."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("last_active", F.last(F.when(active, F.col("ts")), ignorenulls=True).over(before))
    rows = rows.withColumn("gap_s", (F.unix_micros("ts") - F.unix_micros("last_active")) / 1e6)
    return rows.where(F.col("gap_s") > timeout_s)


def epoch_cycle_times(events: DataFrame, by: str = "host") -> DataFrame:
    """Round times from ``event`` (begin or transition), ``epoch``, ``ts``, in order per host.

    A transition to begin+1 ends an all-reduce (``ar_time``); a begin at the last transition's epoch ends accumulation
    (``grad_accum_time``); any other transition is ``missed_ar_step`` and forgets both.

    No fold is needed: a transition is good if it and all others since the last begin fit that begin, and what a begin
    meets is the transition before it, if that was good.  The windows keep a host's rows on disk, not in memory.
    """
    w = Window.partitionBy(by).orderBy(*[F.asc_nulls_last(c) for c in ("ts", "event", "epoch")])
    along = w.rowsBetween(Window.unboundedPreceding, 0)
    begins = F.coalesce(F.col("event") == "begin", F.lit(False))
    rows = events.select(F.col(by).cast("string").alias(by), "ts", "event", "epoch").withColumns({"_b": begins, "_i": F.row_number().over(w)})
    rows = rows.withColumn("_begin", F.last(F.when(F.col("_b"), F.struct("epoch", "ts", "_i")), ignorenulls=True).over(along))
    fits = F.coalesce(F.col("_begin.epoch") + 1 == F.col("epoch"), F.lit(False))
    rows = rows.withColumn("_miss", F.last(F.when(~F.col("_b") & ~fits, F.col("_i")), ignorenulls=True).over(along))
    rows = rows.withColumn("_good", ~F.col("_b") & fits & F.coalesce(F.col("_miss") < F.col("_begin._i"), F.lit(True)))
    rows = rows.withColumn("_trans", F.last(F.when(~F.col("_b"), F.struct("epoch", "ts", "_good")), ignorenulls=True).over(along))
    accumulated = F.col("_b") & F.coalesce(F.col("_trans._good") & (F.col("_trans.epoch") == F.col("epoch")), F.lit(False))
    kind = F.when(accumulated | F.col("_good"), "duration").when(~F.col("_b"), "error")
    name = F.when(accumulated, "grad_accum_time").when(F.col("_good"), "ar_time").otherwise("error_missed_ar_step")
    value = F.when(accumulated, scalar.ms_between(F.col("_trans.ts"), F.col("ts"))).when(F.col("_good"), scalar.ms_between(F.col("_begin.ts"), F.col("ts"))).otherwise(1.0)
    return rows.where(accumulated | ~F.col("_b")).select(by, F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), name.alias("name"), value.alias("value"))


def utilisation_windows(df: DataFrame, by: str = "host", span_ms: float = 5000) -> DataFrame:
    """Sums of ``value`` from an anchor line on; a line more than ``span_ms`` later closes the sum and is the next anchor.

    An ordered fold that carries the anchor and its sum, and searches the next anchor in a batch by bisection.  Lines without
    time are not placed and left out.
    """

    def step(state: tuple[int, float] | None, rows: pa.RecordBatch) -> tuple[tuple[int, float] | None, list]:
        state, closed = window_sums(state, rows.column("us").to_numpy(), rows.column("value").to_numpy(zero_copy_only=False), span_ms * 1000)
        return state, [pa.array([c[i] for c in closed], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))]

    rows = df.select(by, F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value").cast("double").alias("value")).where("us is not null")
    out = ordered_fold(rows, by, ["us", F.asc_nulls_last("value")], step, "anchor long, closed long, total double")
    return out.select(by, F.timestamp_micros("anchor").alias("anchor"), F.timestamp_micros("closed").alias("closed"), "total")


def phase_timeline(df: DataFrame, phase1: int, phase2: int, max_stale: int, by: str = "peer") -> DataFrame:
    """Phase per step of ``step, local, remote`` epochs: 1 when too far behind, 2 after ``phase1`` steps, then off.

    An ordered fold that carries the phase and its steps left; stretches of one phase are filled at once.  An unknown epoch is
    not behind.  Steps that are repeated count each.
    """

    def step(state: tuple[int, int] | None, rows: pa.RecordBatch) -> tuple[tuple[int, int], list]:
        state, found = phases(state, rows.column("stale").to_numpy(zero_copy_only=False), phase1, phase2)
        return state, [rows.column("step"), pa.array(found)]

    stale = F.coalesce(F.col("remote") - F.col("local") > max_stale, F.lit(False)).alias("stale")
    rows = df.select(by, F.col("step").cast("long").alias("step"), stale)
    return ordered_fold(rows, by, ["step", "stale"], step, "step long, phase int")


# What the console view shows, in the order in which it is tried, and the lines of the synchronisation phases.
SHOWN: tuple[tuple[str, str], ...] = (
    ("SERVER", r"\w+ starting\. Verbose logs are written to: (.+)"),
    ("SERVER", r"^Node name: (\S+)"),
    ("DOWNLOAD", r"Starting state download with (\d+) threads"),
    ("DOWNLOAD", r"State download progress: ([\d.]+)%, speed: ([\d.]+) MB/s, ETA: (\S+)"),
    ("DOWNLOAD", r"State \((\d+) MB\) downloaded in ([\d.]+) sec"),
    ("AUTH", r"On waitlist\. Position: (\d+)\."),
    ("AUTH", r"Authorization queue\. Position: (\d+), Estimated wait: (.+)$"),
    ("AUTH", r"Access for user (\S+) has been granted until (.+) UTC"),
    ("NETWORK", r"Testing internet speed\.\.\."),
    ("NETWORK", r"Download Speed: ([\d.]+) Mbps"),
    ("NETWORK", r"Upload Speed: ([\d.]+) Mbps"),
    ("NETWORK", r"Latency: ([\d.]+) ms"),
    ("NETWORK", r"Running DHT node on \['/ip4/([^/]+)/tcp/(\d+)/p2p/([^']+)'\]"),
    ("SERVER", r"Initializing expert"),
    ("SERVER", r"Server started with (\d+) modules?:"),
    ("SERVER", r"^([^:]+):\s+\w+,\s+([\d,]+)\s+parameters$"),
    ("TRAINING", r"Transitioning to epoch (\d+)"),
    ("TRAINING", r"All-reduce round finished at local epoch #(\d+)"),
    ("PROGRESS", r"^Processed (\d+) batches in last (\d+) seconds:$"),
    ("SERVER", r"^Shutting down \w+\.\.\.$"),
)
PHASE = (r"Ghost phase 1 will last (\d+) steps, ending at local epoch (\d+)", r"Ghost phase 2 will last (\d+) steps, ending at local epoch (\d+)", r"Exiting ghost mode at \d+ local epoch")


def visible_lines(df: DataFrame, by: Sequence[str] = ("host",), order: Sequence[str] = ("ts",)) -> DataFrame:
    """Lines that a console shows, with ``tag``, of parsed lines.

    Warnings and errors always; other lines only by the patterns above.  "Processed 0 batches" is hidden in synchronisation
    phase 1, and the end of the phases is shown only if one was entered.
    """
    message = F.col("msg")
    loud = F.col("level").isin("WARNING", "ERROR", "CRITICAL")
    mark = F.when(~loud, F.when(message.rlike(PHASE[0]), 1).when(message.rlike(PHASE[1]), 2).when(message.rlike(PHASE[2]), 0))
    before = F.last("_mark", ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_mark", mark).withColumn("_phase", F.coalesce(before, F.lit(0)))
    tag = F.lit(None).cast("string")
    for name, pattern in reversed(SHOWN):
        tag = F.when(message.rlike(pattern), F.lit(name)).otherwise(tag)
    idle = (F.col("_phase") == 1) & message.rlike(r"^Processed 0 batches in last \d+ seconds:$")
    synced = F.when((F.col("_mark") > 0) | (F.col("_phase") > 0), "SYNC")
    shown = F.when(loud, F.when(F.col("level") == "WARNING", "WARNING").otherwise("ERROR")).when(F.col("_mark").isNotNull(), synced).when(~idle, tag)
    return rows.withColumn("tag", shown).where("tag is not null").drop("_mark", "_phase")
