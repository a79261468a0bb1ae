"""Expiring record logs, rosters and what is computed from them.

A log has ``key, subkey, value, expiration, arrival``; ``now`` is a timestamp column.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import scalar


def latest_records(log: DataFrame, now: Column, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """Per key the value with the greatest expiration; of equal expirations the first to arrive; expired ones go."""
    # Ordered by expiration, then by earliest arrival: a later write needs a strictly greater expiration to win.
    order = F.struct("expiration", (-F.unix_micros("arrival")).alias("early"), "value")
    rows = log.where(F.col("expiration") > now).groupBy(*by).agg(F.max(order).alias("_r"))
    return rows.select(*by, F.col("_r.value").alias("value"), F.col("_r.expiration").alias("expiration"))


def latest_subrecords(log: DataFrame, now: Column) -> DataFrame:
    """Per key a map of its live subrecords; it expires with the last of them."""
    rows = latest_records(log, now, ("key", "subkey"))
    return rows.groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("subkey", "value")))).alias("value"), F.max("expiration").alias("expiration"))


def latest_entries(log: DataFrame, now: Column) -> DataFrame:
    """Per key what it holds: ``key, plain, value, expiration``, a plain value (rows without subkey) or a map of subrecords.

    The two kinds compete: a plain value needs a greater expiration than all before it to replace a map (which expires with the last
    of its subrecords), and so does a subrecord to replace a plain value; the map then begins anew.  Into a map, subrecords go as
    in ``latest_subrecords``.  Rows that are expired on arrival are refused.

    What a key expires at is the greatest expiration so far, whatever was refused, so which plain value came last and which
    subrecords came after it are running maxima.  Only keys that have rows of both kinds are put in order.
    """
    rows = log.where(F.col("expiration") >= F.col("arrival"))
    kinds = rows.groupBy("key").agg(F.bool_and(F.col("subkey").isNull()).alias("_plain"), F.bool_and(F.col("subkey").isNotNull()).alias("_map"))
    mixed = rows.join(kinds.where("not _plain and not _map").select("key"), "key")
    before = Window.partitionBy("key").orderBy("arrival", F.col("subkey").asc_nulls_first(), "value")
    so_far = before.rowsBetween(Window.unboundedPreceding, -1)
    ordered = mixed.withColumns({"_most": F.max("expiration").over(so_far), "_upto": F.max("expiration").over(before.rowsBetween(Window.unboundedPreceding, 0))})
    replaces = F.col("subkey").isNull() & F.coalesce(F.col("expiration") > F.col("_most"), F.lit(True))
    ordered = ordered.withColumns({"_replaces": replaces, "_last": F.max(F.when(replaces, F.col("expiration"))).over(Window.partitionBy("key"))})
    # The last plain value's expiration is the greatest of the plain values that replaced anything.
    still_plain = ordered.where(F.col("_replaces") & (F.col("expiration") == F.col("_last")))
    after = ordered.where(F.col("subkey").isNotNull() & F.coalesce(F.col("_upto") > F.col("_last"), F.lit(True)))
    plain = rows.join(kinds.where("_plain").select("key"), "key").select("key", "value", "expiration", "arrival")
    plain = plain.unionByName(still_plain.join(after.select("key").distinct(), "key", "left_anti").select("key", "value", "expiration", "arrival"))
    maps = rows.join(kinds.where("_map").select("key"), "key").select("key", "subkey", "value", "expiration", "arrival")
    maps = maps.unionByName(after.select("key", "subkey", "value", "expiration", "arrival"))
    held = latest_subrecords(maps, now)
    kept = latest_records(plain, now).select("key", F.col("value").alias("plain"), F.lit(None).cast(dict(held.dtypes)["value"]).alias("value"), "expiration")
    return kept.unionByName(held.select("key", F.lit(None).cast(dict(kept.dtypes)["plain"]).alias("plain"), "value", "expiration"))


def live_members(rows: DataFrame, now: Column, value: str = "value") -> DataFrame:
    """Members parsed from their values: phase 1 and malformed ones go, phase 2 stays, expired ones go."""
    parsed = rows.withColumn("_m", scalar.member_value(F.col(value)))
    good = F.col(value).rlike(r"^[A-Za-z0-9]+(_ghost[12]_[0-9]+)?$")
    return parsed.where(good & (F.col("expiration") > now) & (F.col("_m.phase") != 1)).withColumns({"peer": F.col("_m.peer"), "phase": F.col("_m.phase"), "epoch": F.col("_m.epoch")}).drop("_m")


def validate_records(rows: DataFrame, types: dict[str, str], owner: tuple[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Split JSON ``value`` rows into valid and quarantined: every field present and of its type, nothing coerced.

    ``types`` maps field names to variant types such as ``BIGINT``, ``STRING``; ``owner`` is (column, regex).
    """
    parsed = F.try_parse_json(F.col("value"))
    good = parsed.isNotNull()
    for name, kind in types.items():
        field = F.try_variant_get(parsed, f"$.{name}", "variant")
        good = good & F.coalesce(F.schema_of_variant(field) == kind, F.lit(False))
    if owner:
        good = good & F.col(owner[0]).rlike(owner[1])
    good = F.coalesce(good, F.lit(False))
    return rows.where(good), rows.where(~good)


@dataclass(frozen=True)
class Validator:
    """One link of a chain: ``good`` tells whether a record's ``value`` may pass, ``strip`` what the next link sees of it."""

    name: str
    good: Callable[[Column], Column]
    strip: Callable[[Column], Column] = lambda value: value


def schema_validator(types: dict[str, str]) -> Validator:
    """JSON with every field of ``types`` present and of its variant type."""

    def good(value: Column) -> Column:
        parsed = F.try_parse_json(value)
        out = parsed.isNotNull()
        for name, kind in types.items():
            out = out & F.coalesce(F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant")) == kind, F.lit(False))
        return out

    return Validator("schema", good)


def owner_validator(column: str, pattern: str) -> Validator:
    return Validator("owner", lambda value: F.col(column).rlike(pattern))


def signature_validator(secret: str, *signed: str) -> Validator:
    """A trailing ``[signature:<hex>]``: SHA-256 of the secret, the ``signed`` columns and the value before it, which is then taken off."""
    bare = lambda value: F.regexp_replace(value, r"\[signature:[0-9a-f]*\]$", "")

    def good(value: Column) -> Column:
        told = F.regexp_extract(value, r"\[signature:([0-9a-f]*)\]$", 1)
        return told == F.sha2(F.concat_ws("\0", F.lit(secret), *[F.col(c).cast("string") for c in signed], bare(value)), 256)

    return Validator("signature", good, bare)


def run_validators(rows: DataFrame, chain: Sequence[Validator], value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Records that pass the whole chain, their values stripped by it, and those that don't, with the link that ``failed``.

    Links are tried in order, each on what the one before left of the value; a null value passes none.
    """
    seen, failed = F.col(value), F.lit(None).cast("string")
    checks = []
    for link in chain:
        checks.append((link.name, F.coalesce(link.good(seen), F.lit(False))))
        seen = link.strip(seen)
    for name, good in reversed(checks):
        failed = F.when(~good, F.lit(name)).otherwise(failed)
    told = rows.withColumns({"failed": failed, "_stripped": seen})
    return told.where("failed is null").withColumn(value, F.col("_stripped")).drop("failed", "_stripped"), told.where("failed is not null").drop("_stripped")


def own_addresses(rows: DataFrame, addresses: str = "addresses", owner: str = "peer_id") -> DataFrame:
    """Addresses without their ``/p2p/<id>`` suffix, of the record's owner only."""
    own = F.filter(addresses, lambda a: F.split_part(a, F.lit("/p2p/"), F.lit(2)) == F.col(owner))
    return rows.withColumn(addresses, F.transform(own, lambda a: F.split_part(a, F.lit("/p2p/"), F.lit(1))))


def group_candidates(latest: DataFrame, only_active: bool = True) -> DataFrame:
    """Peers of a step's roster; values that do not parse are skipped."""
    wanted = F.col("value").cast("string").rlike("^(true|false)$")
    rows = latest.where(wanted).withColumn("looking_for_group", F.col("value").cast("string") == "true")
    return rows.where("looking_for_group") if only_active else rows


def tier_lookup(df: DataFrame, tiers: DataFrame, value: str, name: str = "tier") -> DataFrame:
    """Largest threshold not above the value (``threshold, label``); none is an error.

    Tiers are a short configured list: they are gathered into one array and broadcast with a size check.
    """
    listed = [(r["threshold"], r["label"]) for r in tiers.orderBy("threshold").limit(1001).collect()]
    if len(listed) > 1000:
        raise ValueError("more than 1000 tiers")
    found = F.lit(None).cast(tiers.schema["label"].dataType)
    for threshold, label in listed:
        found = F.when(F.col(value) >= threshold, F.lit(label)).otherwise(found)
    return df.withColumn(name, F.coalesce(found, F.raise_error(F.concat(F.lit("no tier for "), F.col(value).cast("string"))).cast(tiers.schema["label"].dataType)))


def name_contains_lookup(df: DataFrame, reference: DataFrame, name: str, key: str = "ref_name") -> DataFrame:
    """The longest reference key contained in each normalised name; keys have any length and may lie within words.

    No pair of tables is compared in full: where a name has the first three characters of some key, only the stretches as
    long as such keys are looked up, by equality.  Of keys of equal length the last by code point wins.
    """
    keys = reference.select(F.col(key), scalar.normalize_name(F.col(key)).alias("_k")).where("_k is not null").distinct()
    begins = keys.select(F.substring("_k", 1, 3).alias("_g"), F.length("_k").alias("_n")).distinct()
    names = df.select(F.col(name).alias("_name")).where("_name is not null").distinct().withColumn("_text", scalar.normalize_name(F.col("_name")))
    places = names.withColumn("_p", F.explode(F.sequence(F.lit(1), F.greatest(F.length("_text"), F.lit(1)))))
    # A key of no or few characters begins with all of them; the empty key is tried once.
    grams = F.array(F.when(F.col("_p") == 1, F.lit("")), *[F.substring(F.col("_text"), F.col("_p"), F.lit(n)) for n in (1, 2, 3)])
    met = places.withColumn("_g", F.explode(F.array_distinct(grams))).join(begins, "_g").where("_p + _n - 1 <= length(_text)")
    found = met.select("_name", F.substring(F.col("_text"), F.col("_p"), F.col("_n")).alias("_k")).join(keys, "_k")
    best = found.groupBy("_name").agg(F.max_by(F.col(key), F.struct(F.length("_k"), F.col(key))).alias(key))
    return df.join(best, F.col(name) == F.col("_name"), "left").drop("_name")


def pair_leases_receipts(leases: DataFrame, receipts: DataFrame, ttl: str = "60 seconds", by: tuple[str, ...] = ("origin", "seq", "receiver")) -> DataFrame:
    """Leases with their first receipt: settled within ``ttl`` (interval in seconds, at least 1e-9), else expired.

    A lease is settled once, whatever receipts follow; leases that agree in all columns are one.
    """
    met = leases_met(leases, receipts, ttl, by).groupBy(*leases.columns).agg(F.min("receipt_ts").alias("receipt_ts"))
    return with_lease_state(met)


def with_lease_state(met: DataFrame) -> DataFrame:
    seconds = (F.unix_micros("receipt_ts") - F.unix_micros("ts")) / 1e6
    return met.withColumns({"state": F.when(F.col("receipt_ts").isNull(), "expired").otherwise("settled"), "interval_s": F.when(F.col("receipt_ts").isNotNull(), F.greatest(seconds, F.lit(1e-9)))})


def leases_met(leases: DataFrame, receipts: DataFrame, ttl: str, by: tuple[str, ...]) -> DataFrame:
    """Outer interval join: each lease with each receipt in time; it also runs stream to stream under watermarks."""
    r = receipts.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("ts").alias("receipt_ts"))
    on = (F.col("receipt_ts") >= F.col("ts")) & (F.col("receipt_ts") <= F.col("ts") + F.expr(f"interval {ttl}"))
    for c in by:
        on = on & (F.col(c) == F.col(f"_{c}"))
    return leases.join(r, on, "left").drop(*[f"_{c}" for c in by])


def exclude_banned(members: DataFrame, bans: DataFrame, now: Column) -> DataFrame:
    """Members without a live ban; one from another endpoint, or a record newer than the ban, lifts it."""
    b = bans.select(F.col("uid"), F.col("endpoint").alias("ban_endpoint"), F.col("expiration").alias("ban_expiration"))
    banned = (F.col("ban_expiration") > now) & (F.col("ban_endpoint") == F.col("endpoint")) & (F.col("expiration") <= F.col("ban_expiration"))
    return members.join(b, "uid", "left").where(~F.coalesce(banned, F.lit(False))).drop("ban_endpoint", "ban_expiration")


def already_registered(peers: DataFrame, addresses: DataFrame, roster: DataFrame, key: str = "peer_id", now: Column | None = None) -> DataFrame:
    """Peers that an address book or a roster knows already; with ``now``, by records that have not expired."""
    if now is not None:
        addresses, roster = addresses.where(F.col("expiration") > now), roster.where(F.col("expiration") > now)
    return peers.join(addresses.select(key).unionByName(roster.select(key)).distinct(), key, "left_semi")


def verify_members(members: DataFrame, expected: dict[str, str], info: str = "info") -> DataFrame:
    """Members whose map column has every expected key with the expected value."""
    good = F.lit(True)
    for k, v in expected.items():
        good = good & F.coalesce(F.try_element_at(info, F.lit(k)) == v, F.lit(False))
    return members.where(good)


def swarm_progress(records: DataFrame, now: Column, target: float, stale_allow: int, by: tuple[str, ...] = (), local: DataFrame | None = None, eps: float = 0.0, refresh_s: float = 3.0) -> DataFrame:
    """Progress of a swarm from ``epoch, samples, speed, time, client_mode`` rows, one per peer.

    The epoch is the largest of non-client peers; samples count for peers at most ``stale_allow`` behind; speed counts
    for all, and ``eps`` once; estimates add what peers did since they reported.  ETA and next refresh follow.

    ``local`` (``by, local_epoch, local_samples, local_speed``) is the asker's own progress: no epoch is less than its, and a swarm
    without peers or without samples has its epoch, samples and ETA, to be looked at again after ``refresh_s``.
    """
    if not by:
        one = local.withColumn("_swarm", F.lit(0)) if local is not None else None
        return swarm_progress(records.withColumn("_swarm", F.lit(0)), now, target, stale_allow, ("_swarm",), one, eps, refresh_s).drop("_swarm")
    top = records.groupBy(*by).agg(F.max(F.when(~F.col("client_mode"), F.col("epoch"))).alias("global_epoch"))
    if local is not None:
        top = top.join(local.select(*by, "local_epoch"), list(by), "full").withColumn("global_epoch", F.greatest("global_epoch", "local_epoch")).drop("local_epoch")
    met = records.join(top, list(by))
    fresh = F.col("epoch") >= F.col("global_epoch") - stale_allow
    since = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros("time")) / 1e6)
    out = met.groupBy(*by, "global_epoch").agg(
        F.count(F.lit(1)).alias("peers"),
        F.count_if("client_mode").alias("clients"),
        F.coalesce(F.sum(F.when(fresh, F.col("samples"))), F.lit(0)).alias("total_samples"),
        (F.sum("speed") + F.lit(eps)).alias("total_speed"),
        F.coalesce(F.sum(F.when(fresh, F.col("samples") + since * F.col("speed"))), F.lit(0.0)).alias("estimated_samples"),
    )
    eta = F.greatest(F.lit(0.0), F.lit(float(target)) - F.col("estimated_samples")) / F.col("total_speed")
    out = out.withColumn("eta_s", F.when(F.col("total_speed") > 0, eta))
    factor = F.col("peers") / F.greatest(F.col("peers") + 3, F.col("peers") * 1.2)
    out = out.withColumn("next_refresh_s", F.least(F.lit(10.0), F.greatest(F.lit(0.5), F.col("eta_s") * factor)))
    if local is None:
        return out
    idle = F.coalesce(F.col("total_samples"), F.lit(0)) == 0
    own = F.greatest(F.lit(0.0), F.lit(float(target)) - F.col("local_samples")) / F.when(F.col("local_speed") > 0, F.col("local_speed"))
    out = out.join(local.select(*by, "local_epoch", "local_samples", "local_speed"), list(by), "full").na.fill(0, ["peers", "clients"])
    mine = idle & F.col("local_epoch").isNotNull()
    told = {"global_epoch": F.col("local_epoch"), "total_samples": F.col("local_samples"), "estimated_samples": F.col("local_samples").cast("double"), "eta_s": own, "next_refresh_s": F.lit(refresh_s)}
    out = out.withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in told.items()}).withColumn("total_speed", F.coalesce("total_speed", F.lit(eps)))
    return out.drop("local_epoch", "local_samples", "local_speed")


def leaderboard(compute: DataFrame, presence: DataFrame, peers: DataFrame, most_active: int = 5) -> DataFrame:
    """Score per account: compute PFLOP plus one per active hour, over at most ``most_active`` peers of an account."""
    score = compute.groupBy("peer").agg(F.sum("pflop").alias("pflop")).join(presence.groupBy("peer").agg(F.sum("hours").alias("hours")), "peer", "full").na.fill(0.0)
    per = peers.join(score.withColumn("score", F.col("pflop") + F.col("hours")), "peer")
    best = F.row_number().over(Window.partitionBy("account").orderBy(F.col("hours").desc(), "peer"))
    total = per.withColumn("_k", best).where(F.col("_k") <= most_active).groupBy("account").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("peers"))
    # Accounts are ranked as a whole; the table has a row for each account only.
    return total.withColumn("rank", F.rank().over(Window.orderBy(F.col("score").desc())))


def visible_count(keys: DataFrame, log: DataFrame, now: Column) -> DataFrame:
    """Live subrecords under each key, 0 when there are none."""
    n = latest_records(log, now, ("key", "subkey")).groupBy("key").agg(F.count(F.lit(1)).alias("visible"))
    return keys.join(n, "key", "left").na.fill(0, ["visible"])


def evict_to_size(live: DataFrame, most: int) -> DataFrame:
    """At most ``most`` keys, those that expire last (a limit that is the feature)."""
    return live.orderBy(F.col("expiration").desc(), "key").limit(most)


def subset_by_rank(members: DataFrame, rank: int, k: int, uid: str = "uid", by: tuple[str, ...] = ()) -> DataFrame:
    """``k`` members from position ``rank*k mod n`` on, wrapping; ordered by the number in the uid."""
    number = F.regexp_extract(uid, r"([0-9]+)$", 1).cast("long")
    w = Window.partitionBy(*by)
    rows = members.withColumns({"_n": F.count(F.lit(1)).over(w), "_p": F.row_number().over(w.orderBy(number, uid)) - 1})
    return rows.where(F.pmod(F.col("_p") - F.pmod(F.lit(rank * k), F.col("_n")), F.col("_n")) < k).drop("_n", "_p")


def balanced_partitions(df: DataFrame, parts: int, order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Contiguous near-equal parts, the first ones longer by one; as many parts as rows when there are fewer."""
    return df.withColumn("part", F.ntile(parts).over(Window.partitionBy(*by).orderBy(order)) - 1)


def join_rank(members: DataFrame, by: tuple[str, ...], joined: str = "joined", member: str = "uid") -> DataFrame:
    """How many other members of the group were there before."""
    return members.withColumn("join_rank", F.row_number().over(Window.partitionBy(*by).orderBy(joined, member)) - 1)


def state_donors(df: DataFrame, strategy: str = "priority", target: str | None = None, me: str | None = None) -> DataFrame:
    """Donors in the order to ask them: an explicit target first, the asker left out."""
    rows = df.where(F.col("uid") != me) if me else df
    first = [F.when(F.col("uid") == target, 0).otherwise(1)] if target else []
    number = F.regexp_extract("uid", r"([0-9]+)$", 1)
    then = [F.col("priority").desc_nulls_last(), F.md5("uid")] if strategy == "priority" else [F.when(number != "", number.cast("long")).asc_nulls_last(), F.col("uid")]
    return rows.orderBy(*first, *then)


def expire_batches(df: DataFrame, now: Column, ttl_s: float, most_rows: int, most_bytes: int, by: tuple[str, ...] = ("cache",)) -> DataFrame:
    """Entries of each cache that stay: latest per key, younger than ``ttl_s``, and of these the newest within both limits."""
    latest = df.groupBy(*by, "key").agg(F.max(F.struct("ts", "nbytes")).alias("_e")).select(*by, "key", F.col("_e.ts").alias("ts"), F.col("_e.nbytes").alias("nbytes"))
    young = latest.where((F.unix_micros(now) - F.unix_micros("ts")) / 1e6 < ttl_s)
    newest = Window.partitionBy(*by).orderBy(F.col("ts").desc(), F.col("key").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = young.withColumns({"_rows": F.count(F.lit(1)).over(newest), "_bytes": F.sum("nbytes").over(newest)})
    return rows.where((F.col("_rows") <= most_rows) & (F.col("_bytes") <= most_bytes)).drop("_rows", "_bytes")


def batch_ledger(opens: DataFrame, reports: DataFrame, timeout_s: float, stall_timeout_s: float) -> DataFrame:
    """Outcome per (origin, seq): dropped, done, dropped for stalling, or timeout; late reports are counted.

    A batch stalls when its last report in time (or its open) lies more than ``stall_timeout_s`` before its deadline.
    """
    r = reports.select("origin", "seq", "kind", "loss", F.col("ts").alias("report_ts"))
    met = opens.join(r, ["origin", "seq"], "left")
    age = (F.unix_micros("report_ts") - F.unix_micros("ts")) / 1e6
    in_time = age <= timeout_s
    out = met.groupBy("origin", "seq", "ts").agg(
        F.count_if(in_time & (F.col("kind") == "dropped")).alias("_dropped"),
        F.min_by("loss", F.when(in_time & (F.col("kind") == "done"), F.struct("report_ts", "loss"))).alias("_loss"),
        F.count_if(in_time & (F.col("kind") == "done")).alias("_done"),
        F.count_if(age > timeout_s).alias("late_reports"),
        F.coalesce(F.max(F.when(in_time, age)), F.lit(0.0)).alias("_progress"),
    )
    outcome = F.when(F.col("_dropped") > 0, "dropped").when(F.col("_done") > 0, "done").when(timeout_s - F.col("_progress") > stall_timeout_s, "dropped").otherwise("timeout")
    return out.select("origin", "seq", outcome.alias("outcome"), F.when((F.col("_dropped") == 0) & (F.col("_done") > 0), F.col("_loss")).alias("loss"), "late_reports")


def loss_records(df: DataFrame, window: str) -> DataFrame:
    """Per-origin metrics as records that expire after ``window``: ``key, subkey, value, expiration, arrival``.

    A loss of 0 or none is no sample, but its batches and tokens still count.
    """
    value = F.to_json(F.struct("mode", "step", F.nullif(F.col("loss"), F.lit(0.0)).alias("loss"), "tps"))
    return df.select(F.lit("metrics").alias("key"), F.col("origin").alias("subkey"), value.alias("value"), (F.col("ts") + F.expr(f"interval {window}")).alias("expiration"), F.col("ts").alias("arrival"))
