"""Streaming twins of the batch operators.

Each takes and returns streaming DataFrames (``upsert``, ``write_metrics`` and ``stream_progress`` are ``foreachBatch`` sinks).  Late rows
are dropped behind a watermark of at least ``CLOCK_SLACK_S`` seconds.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.functions.scalar import CLOCK_SLACK_S
from corpusloom.operators import records, telemetry
from corpusloom.plans.folds import window_sums
from corpusloom.sources.token_chunks import resolve

DELAY = f"{CLOCK_SLACK_S} seconds"


def stream_metrics(lines: DataFrame, start: Column | None = None) -> DataFrame:
    """Metrics of log lines as they come; ``start`` gates them."""
    out = telemetry.extract_metrics(telemetry.parse_lines(lines))
    return out.where(start) if start is not None else out


def stream_pool_stats(events: DataFrame, window: str = "60 seconds", delay: str = DELAY) -> DataFrame:
    return telemetry.pool_stats(events.withWatermark("ts", delay), window)


def stream_client_stats(events: DataFrame, window: str = "60 seconds", delay: str = DELAY) -> DataFrame:
    return telemetry.client_stats(events.withWatermark("ts", delay), window)


def stream_leases(leases: DataFrame, receipts: DataFrame, ttl: str = "60 seconds", delay: str = DELAY) -> DataFrame:
    """Outer interval join of two streams: an unanswered lease comes out when the watermark has passed its ttl.

    A receipt that is sent again within the delay is dropped, so a lease is settled once.
    """
    by = ["origin", "seq", "receiver"]
    once = receipts.withWatermark("ts", delay).dropDuplicatesWithinWatermark(by)
    met = records.leases_met(leases.withWatermark("ts", delay), once, ttl, tuple(by))
    return records.with_lease_state(met)


def stream_latest_records(log: DataFrame, delay: str = DELAY) -> DataFrame:
    """Changes of the latest record per key: ``key, value, expiration, live``; an entry is dropped at its own expiration.

    ``log`` has string ``key`` and ``value``, and ``expiration``, ``arrival`` timestamps.
    """

    def update(key: tuple[Any, ...], rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["key", "value", "expiration", "live"]
        if state.hasTimedOut:
            value, expiration = state.get
            state.remove()
            yield pd.DataFrame([(key[0], value, pd.Timestamp(expiration, unit="us"), False)], columns=columns)
            return
        best = state.get if state.exists else None
        for part in rows:
            for value, expiration in part.sort_values("arrival", kind="stable")[["value", "expiration"]].itertuples(index=False):
                micros = expiration.value // 1000
                if best is None or micros > best[1]:
                    best = (value, micros)
        now = state.getCurrentWatermarkMs()
        if best and best[1] // 1000 > now:
            state.update(best)
            state.setTimeoutTimestamp(best[1] // 1000)
            yield pd.DataFrame([(key[0], best[0], pd.Timestamp(best[1], unit="us"), True)], columns=columns)

    rows = log.withWatermark("arrival", delay).select("key", "value", "expiration", "arrival")
    return rows.groupBy("key").applyInPandasWithState(update, "key string, value string, expiration timestamp, live boolean", "value string, expiration long", "update", GroupStateTimeout.EventTimeTimeout)


def stream_ema(events: DataFrame, alpha: float, eps: float = 1e-20) -> DataFrame:
    """Bias-corrected rate per ``key`` of ``interval, size`` rows, in order of ``ts`` within a trigger."""

    def update(key: tuple[Any, ...], rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean, n = state.get if state.exists else (0.0, 0)
        for part in rows:
            for interval, size in part.sort_values("ts", kind="stable")[["interval", "size"]].itertuples(index=False):
                mean, n = alpha * interval / size + (1 - alpha) * mean, n + 1
        state.update((mean, n))
        yield pd.DataFrame([(key[0], n, 1 / max(mean / (1 - (1 - alpha) ** n), eps))], columns=["key", "updates", "samples_per_second"])

    return events.select("key", "interval", "size", "ts").groupBy("key").applyInPandasWithState(update, "key string, updates long, samples_per_second double", "mean double, n long", "update", GroupStateTimeout.NoTimeout)


def idle_alerts(rules: list[dict], state: dict, ts: float) -> list[tuple[str, float]]:
    """Started hosts that have been silent for longer than a rule's timeout; the silence then counts anew."""
    out = []
    for rule in rules:
        if rule["action"] == "track_activity" and state.get("started") and state.get("active") is not None and ts - state["active"] > rule["timeout"]:
            out.append((rule["name"], ts - state["active"]))
            state["active"] = ts
    return out


def alert_fold(rules: list[dict], state: dict, line: str, ts: float) -> list[tuple[str, float]]:
    """One line through the alert rules; ``state`` holds counters, windows and activity of a host.

    Rules are dicts with ``name, pattern, action`` and what the action needs: ``terminate``; ``count`` (threshold);
    ``windowed_count`` (threshold, window); ``threshold`` (the captured value is at least ``above`` or at most ``below``); ``track_activity``
    (timeout); ``reset_counters``; ``set_started``.  The first rule that matches decides.
    """
    import re

    out = idle_alerts(rules, state, ts)
    for rule in rules:
        match = re.search(rule["pattern"], line)
        if not match:
            continue
        name, action = rule["name"], rule["action"]
        counts, windows = state.setdefault("counts", {}), state.setdefault("windows", {})
        if action == "terminate":
            out.append((name, 1.0))
        elif action == "count":
            counts[name] = counts.get(name, 0) + 1
            if counts[name] >= rule["threshold"]:
                out.append((name, float(counts[name])))
        elif action == "windowed_count":
            windows[name] = [*windows.get(name, []), 1][-rule["window"] :]
            if sum(windows[name]) >= rule["threshold"]:
                out.append((name, float(sum(windows[name]))))
        elif action == "threshold":
            value = float(match.group(1))
            if ("above" in rule and value >= rule["above"]) or ("below" in rule and value <= rule["below"]):
                out.append((name, value))
        elif action == "track_activity":
            state["active"] = ts
        elif action == "reset_counters":
            for other in rule.get("resets", list(counts)):
                counts.pop(other, None)
            for other in windows:
                if other in rule.get("resets", [other]):
                    size = next(r["window"] for r in rules if r["name"] == other)
                    windows[other] = [*windows[other], 0][-size:]
        elif action == "set_started":
            state["started"], state["active"] = True, ts
        break
    return out


def stream_alerts(lines: DataFrame, rules: list[dict] | None = None, delay: str = DELAY) -> DataFrame:
    """Alert rows ``host, ts, rule, value`` of parsed lines (``host, ts, line``), in order of time within a trigger.

    Without ``rules``, those of ``plans.jobs.ALERT_RULES``.

    A host that falls silent is noticed by a timer: it alerts as soon as the watermark, which other hosts' lines move on, has
    passed its activity by the timeout.
    """
    if rules is None:
        from corpusloom.plans.jobs import ALERT_RULES

        rules = list(ALERT_RULES)
    idle = [r for r in rules if r["action"] == "track_activity"]

    def update(key: tuple[Any, ...], rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else {}
        out = []
        if state.hasTimedOut:
            now = state.getCurrentWatermarkMs() * 1000
            out += [(key[0], now, name, value) for name, value in idle_alerts(rules, kept, now / 1e6)]
        for part in rows:
            for us, line in part.sort_values(["us", "line"], kind="stable")[["us", "line"]].itertuples(index=False):
                out += [(key[0], us, name, value) for name, value in alert_fold(rules, kept, line, us / 1e6)]
        state.update((json.dumps(kept),))
        if idle and kept.get("started") and kept.get("active") is not None:
            due = int((kept["active"] + min(r["timeout"] for r in idle)) * 1000) + 1
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["host", "us", "rule", "value"])

    rows = lines.withWatermark("ts", delay).select("host", "ts", F.unix_micros("ts").alias("us"), "line")
    out = rows.groupBy("host").applyInPandasWithState(update, "host string, us long, rule string, value double", "kept string", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("host", F.timestamp_micros("us").alias("ts"), "rule", "value")


def stream_batch_ledger(events: DataFrame, timeout_s: float, stall_timeout_s: float = float("inf"), delay: str = DELAY) -> DataFrame:
    """Outcome of each batch of a union of opens and reports: ``batch, kind, loss, ts``, kind ``open`` for the open.

    Any report is progress.  ``dropped`` beats ``done`` within a trigger; a batch without progress for ``stall_timeout_s`` is
    ``dropped``, one without either by its deadline is ``timeout``.  Reports of unknown batches and after an outcome are
    counted and come out as ``late``.
    """
    columns = ["batch", "outcome", "loss", "late_reports"]

    def due(deadline: int, progress: int) -> tuple[int, str]:
        stall = progress + stall_timeout_s * 1000
        return (int(stall), "dropped") if stall < deadline else (deadline, "timeout")

    def update(key: tuple[Any, ...], rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            deadline, progress, loss, closed, late = state.get
            if closed or not deadline:
                state.remove()
                yield pd.DataFrame([], columns=columns)
            else:
                state.update((0, 0, None, True, late))
                state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + max(1, int(timeout_s * 1000)))
                yield pd.DataFrame([(key[0], due(deadline, progress)[1], None, late)], columns=columns)
            return
        deadline, progress, loss, closed, late = state.get if state.exists else (0, 0, None, False, 0)
        kinds, out, ends, known = [], [], [], late
        for part in rows:
            kinds += part.sort_values("ms", kind="stable")[["ms", "kind", "loss"]].itertuples(index=False)
        # An open comes before reports of its own millisecond.
        for ms, kind, value in sorted(kinds, key=lambda k: (k[0], k[1] != "open")):
            if kind == "open":
                if not closed and not deadline:
                    deadline, progress = int(ms + timeout_s * 1000), int(ms)
                continue
            if deadline and not closed and not ends and ms > due(deadline, progress)[0]:
                out.append((key[0], due(deadline, progress)[1], None, late))
                closed = True
            if closed or not deadline:
                late += 1
                continue
            progress = int(ms)
            if kind in ("done", "dropped"):
                ends.append(kind)
            if kind in ("done", "loss") and value is not None and value == value:
                loss = float(value)
        if ends:
            outcome = "dropped" if "dropped" in ends else "done"
            out.append((key[0], outcome, loss if outcome == "done" else None, late))
            closed = True
        if late > known:
            out.append((key[0], "late", None, late))
        state.update((deadline, progress, loss, closed, late))
        at = due(deadline, progress)[0] if deadline and not closed else state.getCurrentWatermarkMs() + int(timeout_s * 1000)
        state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=columns)

    rows = events.withWatermark("ts", delay).select("batch", "kind", "loss", "ts", F.unix_millis("ts").alias("ms"))
    kept = "deadline long, progress long, loss double, closed boolean, late long"
    return rows.groupBy("batch").applyInPandasWithState(update, "batch string, outcome string, loss double, late_reports long", kept, "append", GroupStateTimeout.EventTimeTimeout)


def stream_cache(puts: DataFrame, ttl: str, delay: str = DELAY) -> DataFrame:
    """Changes of a cache of ``key, value, ts`` puts: an entry lives for ``ttl`` after its last put (``live`` false: expired)."""
    log = puts.select("key", "value", (F.col("ts") + F.expr(f"interval {ttl}")).alias("expiration"), F.col("ts").alias("arrival"))
    return stream_latest_records(log, delay)


def stream_pair_intervals(marks: DataFrame) -> DataFrame:
    """Time from the last start before each end of ``host, ts, mark`` rows (``start``, ``end``); a start is used once.

    State is the last start of a host; rows are taken in order of time within a trigger.
    """

    def update(key: tuple[Any, ...], rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (begun,) = state.get if state.exists else (None,)
        out = []
        for part in rows:
            for us, mark in part.sort_values(["us", "mark"], ascending=[True, False], kind="stable")[["us", "mark"]].itertuples(index=False):
                if mark == "start":
                    begun = int(us)
                elif mark == "end" and begun is not None:
                    out.append((key[0], us, (us - begun) / 1000))
                    begun = None
        state.update((begun,))
        yield pd.DataFrame(out, columns=["host", "us", "ms"])

    rows = marks.select("host", F.unix_micros("ts").alias("us"), "mark")
    out = rows.groupBy("host").applyInPandasWithState(update, "host string, us long, ms double", "begun long", "append", GroupStateTimeout.NoTimeout)
    return out.select("host", F.timestamp_micros("us").alias("ts"), "ms")


def stream_epoch_cycles(events: DataFrame) -> DataFrame:
    """Round times per host as ``operators.telemetry.epoch_cycle_times`` folds them; state is the last begin and transition."""

    def update(key: tuple[Any, ...], rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        b_epoch, b_ts, t_epoch, t_ts = state.get if state.exists else (-1, 0, -1, 0)
        out = []
        for part in rows:
            for event, epoch, ts in part.sort_values(["ts", "event"], kind="stable")[["event", "epoch", "ts"]].itertuples(index=False):
                now = ts.value // 1000
                if event == "begin":
                    if t_epoch == epoch:
                        out.append((key[0], ts, "duration", "grad_accum_time", (now - t_ts) / 1000))
                    b_epoch, b_ts = epoch, now
                elif b_epoch >= 0 and b_epoch + 1 == epoch:
                    out.append((key[0], ts, "duration", "ar_time", (now - b_ts) / 1000))
                    t_epoch, t_ts = epoch, now
                else:
                    out.append((key[0], ts, "error", "error_missed_ar_step", 1.0))
                    b_epoch = t_epoch = -1
        state.update((b_epoch, b_ts, t_epoch, t_ts))
        yield pd.DataFrame(out, columns=["host", "ts", "kind", "name", "value"])

    return events.select("host", "event", "epoch", "ts").groupBy("host").applyInPandasWithState(update, "host string, ts timestamp, kind string, name string, value double", "b_epoch long, b_ts long, t_epoch long, t_ts long", "append", GroupStateTimeout.NoTimeout)


def stream_utilisation(lines: DataFrame, span_ms: float = 5000, delay: str = DELAY) -> DataFrame:
    """Windows of ``host, ts, value`` lines as ``operators.telemetry.utilisation_windows`` sums them: ``host, anchor, closed, total``.

    State is a host's anchor, its sum, and the lines that the watermark has not passed yet; a timer at the first of these takes
    them in order of time once no earlier line can come.  So triggers may cut the lines anywhere, and come in any order within
    the delay; lines later than that are dropped.
    """

    def update(key: tuple[Any, ...], rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else {"window": None, "waiting": []}
        now = state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut:
            for part in rows:
                kept["waiting"] += [[int(us), float(value)] for us, value in part[["us", "value"]].itertuples(index=False) if us > now or now <= 0]
        ready = sorted(r for r in kept["waiting"] if r[0] <= now)
        closed = []
        if ready:
            window, closed = window_sums(tuple(kept["window"]) if kept["window"] else None, np.array([r[0] for r in ready]), np.array([r[1] for r in ready]), span_ms * 1000)
            kept["window"], kept["waiting"] = window, [r for r in kept["waiting"] if r[0] > now]
        state.update((json.dumps(kept),))
        if kept["waiting"]:
            state.setTimeoutTimestamp(max(min(r[0] for r in kept["waiting"]) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *c) for c in closed], columns=["host", "anchor", "closed", "total"])

    rows = lines.withWatermark("ts", delay).select("host", "ts", F.unix_micros("ts").alias("us"), F.col("value").cast("double").alias("value"))
    out = rows.groupBy("host").applyInPandasWithState(update, "host string, anchor long, closed long, total double", "kept string", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("host", F.timestamp_micros("anchor").alias("anchor"), F.timestamp_micros("closed").alias("closed"), "total")


def stream_bounded_cache(puts: DataFrame, ttl_s: float, most_rows: int, most_bytes: int, delay: str = DELAY) -> DataFrame:
    """Changes of each ``cache`` of ``key, ts, nbytes`` puts: ``cache, key, ts, nbytes, action`` (put, expired, evicted).

    A put replaces its key's entry and is the newest; entries of ``ttl_s`` age go, then the oldest until both limits hold, which may
    be the put itself.  State is the entries in order, at most ``most_rows`` of them; a timer expires the oldest.  Puts are taken
    in order of time within a trigger.  What stays is what ``operators.records.expire_batches`` keeps, as long as no key's later put is smaller.
    """

    def update(key: tuple[Any, ...], rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entries: dict[str, list[int]] = dict(json.loads(state.get[0])) if state.exists else {}
        out: list[tuple] = []

        def expire(now: int) -> None:
            for k in [k for k, (us, _) in entries.items() if now - us >= ttl_s * 1e6]:
                out.append((key[0], k, *entries.pop(k), "expired"))

        watermark = state.getCurrentWatermarkMs() * 1000
        if state.hasTimedOut:
            expire(watermark)
        else:
            taken = sorted(r for part in rows for r in part[["us", "key", "nbytes"]].itertuples(index=False, name=None))
            for us, k, n in taken:
                expire(int(us))
                entries.pop(k, None)
                entries[k] = [int(us), int(n)]
                out.append((key[0], k, int(us), int(n), "put"))
                total = sum(size for _, size in entries.values())
                while len(entries) > most_rows or total > most_bytes:
                    oldest = next(iter(entries))
                    at, size = entries.pop(oldest)
                    out.append((key[0], oldest, at, size, "evicted"))
                    total -= size
        state.update((json.dumps(list(entries.items())),))
        if entries:
            state.setTimeoutTimestamp(max(int((min(us for us, _ in entries.values()) + ttl_s * 1e6) // 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["cache", "key", "us", "nbytes", "action"])

    rows = puts.withWatermark("ts", delay).select(F.col("cache").cast("string").alias("cache"), "ts", F.unix_micros("ts").alias("us"), F.col("key").cast("string").alias("key"), F.col("nbytes").cast("long").alias("nbytes"))
    out = rows.groupBy("cache").applyInPandasWithState(update, "cache string, key string, us long, nbytes long, action string", "kept string", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("cache", "key", F.timestamp_micros("us").alias("ts"), "nbytes", "action")


def upsert(path: str, keys: Sequence[str], order: str | None = None, merge_every: int = 50) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink of a keyed table: each trigger writes the changed keys only, under its own number.

    A row replaces its key's if its ``order`` column is greater, or equal (or there is none) and its trigger later.  A trigger that is
    repeated replaces its own rows, so the table does not change; one that was lost half-way has no ``_SUCCESS`` and does not count.
    Every ``merge_every`` triggers all keys are written together, so that a read never takes more than so many folders.
    """

    def write(batch: DataFrame, number: int) -> None:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*([F.desc(order)] if order else []), *[F.desc(c) for c in sorted(set(batch.columns) - {*keys, order})]))
        own = batch.withColumn("_rank", rank).where("_rank = 1").drop("_rank").withColumn("_trigger", F.lit(number).cast("long"))
        own.write.mode("overwrite").parquet(f"{path}/changes/{number:012d}")
        if number % merge_every == merge_every - 1:
            merged = _merged(batch.sparkSession, path, keys, order, number)
            merged.write.mode("overwrite").parquet(f"{path}/merged/{number:012d}")

    return write


def _complete(folder: str) -> list[tuple[int, str]]:
    """Numbered folders below ``folder`` whose write was finished."""
    store, base = resolve(folder)
    names = [f.base_name for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.type == fs.FileType.Directory]
    return sorted((int(n), f"{folder}/{n}") for n in names if n.isdigit() and store.get_file_info(f"{base}/{n}/_SUCCESS").type != fs.FileType.NotFound)


def _merged(spark: SparkSession, path: str, keys: Sequence[str], order: str | None, upto: int) -> DataFrame | None:
    whole = [x for x in _complete(f"{path}/merged") if x[0] < upto][-1:]
    since = whole[0][0] if whole else -1
    folders = [f for n, f in [*whole, *((n, f) for n, f in _complete(f"{path}/changes") if since < n <= upto)]]
    if not folders:
        return None
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*([F.desc_nulls_last(order)] if order else []), F.desc("_trigger")))
    return spark.read.parquet(*folders).withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def read_upserted(spark: SparkSession, path: str, keys: Sequence[str], order: str | None = None) -> DataFrame | None:
    """The keyed table as of the last finished trigger, or None before the first."""
    out = _merged(spark, path, keys, order, 1 << 62)
    return out.drop("_trigger") if out is not None else None


def write_metrics(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink: the latest value per role and name, upserted by its time; ``read_metrics`` gives the table."""
    put = upsert(path, ("role", "name"), "ts")
    return lambda batch, number: put(telemetry.latest_gauges(batch), number)


def read_metrics(spark: SparkSession, path: str) -> DataFrame | None:
    return read_upserted(spark, path, ("role", "name"), "ts")


PEER = "epoch long, samples long, speed double, time timestamp, client_mode boolean"


def stream_progress(path: str, now: Callable[[], Column], target: float, stale_allow: int, local: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink over ``stream_latest_records``: progress per swarm, from peers that are live.

    Keys are ``swarm|peer``, values JSON (``PEER``).  A trigger upserts the peers that changed and computes only their swarms anew, from
    the table of peers and not from the log; ``read_progress`` gives the table.  A swarm whose peers are all gone has no peers left (with
    ``local``, as in ``operators.records.swarm_progress``, its own progress).
    """
    peers, told = upsert(f"{path}/peers", ("key",)), upsert(f"{path}/progress", ("swarm",))
    swarm = F.split_part("key", F.lit("|"), F.lit(1)).alias("swarm")

    def write(batch: DataFrame, number: int) -> None:
        peers(batch.select("key", "value", "live"), number)
        touched = batch.select(swarm).distinct()
        known = _merged(batch.sparkSession, f"{path}/peers", ("key",), None, number)
        live = known.where("live").select(swarm, F.from_json("value", PEER).alias("p")).join(touched, "swarm", "left_semi").select("swarm", "p.*")
        mine = local.join(touched, "swarm", "left_semi") if local is not None else None
        progress = records.swarm_progress(live, now(), target, stale_allow, ("swarm",), mine)
        told(touched.join(progress, "swarm", "left").na.fill(0, ["peers", "clients"]), number)

    return write


def read_progress(spark: SparkSession, path: str) -> DataFrame | None:
    return read_upserted(spark, f"{path}/progress", ("swarm",))
