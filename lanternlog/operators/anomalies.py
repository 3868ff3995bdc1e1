"""Baseline anomalies: sources first seen after a baseline, and accounts that reach more hosts than any did before."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lanternlog.functions.entities import unmapped_ip
from lanternlog.operators.batches import by_groups, codes
from lanternlog.operators.bursts import distinct_in_windows, ends_of_windows
from lanternlog.operators.hits import ENTITIES
from lanternlog.plans.rulebook import Rule

AUTH_EVENTS = [4624, 4625, 4648, 4768, 4769, 4771, 4776]
NO_SOURCE = ["", "-", "::1", "127.0.0.1", "0.0.0.0"]
HOUR_US = 3_600_000_000
FIRST_SEEN = Rule("ll-a001", "First-seen authentication source", "medium", tags=["attack.initial_access", "attack.t1078"], meta={"kill_chain": "Initial Access"}, kind="anomaly")
FAN_OUT = Rule("ll-a002", "Account reaching unusually many hosts", "medium", tags=["attack.lateral_movement", "attack.t1021"], meta={"kill_chain": "Lateral Movement"}, kind="anomaly")


def split_at(events: DataFrame, fraction: float) -> tuple[DataFrame, int]:
    """Authentication events with `us`, and the instant up to which they are baseline: a fraction of the span of all events. One row comes to the driver."""
    span = events.agg(F.min(F.unix_micros("TimeCreated")).alias("a"), F.max(F.unix_micros("TimeCreated")).alias("b"), F.count_if(F.col("EventID").isin(AUTH_EVENTS)).alias("n")).first()
    auth = events.where(F.col("EventID").isin(AUTH_EVENTS) & F.col("TimeCreated").isNotNull()).withColumn("us", F.unix_micros("TimeCreated"))
    if span.a is None or span.n < 20:
        return auth.limit(0), 0
    return auth, span.a + int((span.b - span.a) * fraction)


def first_seen(auth: DataFrame, cutoff: int) -> DataFrame:
    """source, start_ts, end_ts, actor, host, n_events, n_accounts, event_rids of sources that the baseline lacks."""
    rows = auth.withColumn("source", F.coalesce(unmapped_ip(F.col("IpAddress")), F.lit("")))
    known = rows.where(F.col("us") <= cutoff).select("source").distinct()
    new = rows.where((F.col("us") > cutoff) & ~F.col("source").isin(NO_SOURCE)).join(known, "source", "left_anti")
    at = F.struct("us", "_rid")
    return new.groupBy("source").agg(
        F.min("TimeCreated").alias("start_ts"), F.max("TimeCreated").alias("end_ts"), F.min_by(F.coalesce("TargetUserName", F.lit("")), at).alias("actor"), F.min_by(F.coalesce("Computer", F.lit("")), at).alias("host"),
        F.count(F.lit(1)).alias("n_events"), F.count_distinct(F.nullif("TargetUserName", F.lit(""))).alias("n_accounts"), F.transform(F.array_sort(F.collect_list(at)), lambda x: x["_rid"]).alias("event_rids"))


def _reach(table: pa.Table, group: np.ndarray) -> pa.Table:
    """The number of distinct hosts within an hour from each own event of an account's bucket."""
    us, own = table["us"].to_numpy(), table["own"].to_numpy(zero_copy_only=False).astype(bool)
    host = codes(table["Computer"])
    hosts = distinct_in_windows(group * (host.max(initial=0) + 1) + host, ends_of_windows(us, np.full(len(us), HOUR_US), group))
    # an hour takes in events of equal time before this one in the order
    new = np.ones(len(us), bool)
    new[1:] = (us[1:] != us[:-1]) | (group[1:] != group[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(us)), 0))
    return table.select(["account", "us", "Computer", "_rid", "IpAddress"]).append_column("n_hosts", pa.array(hosts[first], pa.int64())).filter(pa.array(own))


def fan_out(auth: DataFrame) -> DataFrame:
    """account, us, n_hosts: each account's earliest hour with most distinct hosts, of network and remote logons.

    Hosts are first put on whole-hour buckets; an hour from any event lies in
    two of them, so no more than an account's two hours are looked at together.
    """
    account = F.lower("TargetUserName")
    rows = auth.where((F.col("EventID") == 4624) & F.trim("LogonType").isin("3", "10") & (F.col("TargetUserName") != "")).select(account.alias("account"), "us", "Computer", "_rid", "IpAddress")
    bucket = F.floor(F.col("us") / HOUR_US)
    seen = rows.select("*", F.explode(F.array(F.struct(bucket.alias("b"), F.lit(True).alias("own")), F.struct((bucket - 1).alias("b"), F.lit(False).alias("own")))).alias("_at")).select("*", "_at.*").drop("_at")
    counted = by_groups(seen.withColumn("Computer", F.coalesce("Computer", F.lit(""))), ["account", "b"], ["us", "_rid"], _reach, "account string, us long, Computer string, _rid long, IpAddress string, n_hosts long")
    best = F.struct((-F.col("n_hosts")).alias("m"), "us", "_rid")
    return counted.groupBy("account").agg(F.min(best).alias("x"), F.min_by("Computer", best).alias("host"), F.min_by("IpAddress", best).alias("source"), F.min_by("_rid", best).alias("_rid")).select("account", F.col("x.us").alias("us"), (-F.col("x.m")).alias("n_hosts"), "host", "source", "_rid")


def fan_out_verdict(auth: DataFrame, cutoff: int) -> DataFrame:
    """Accounts with at least max(4, baseline's most + 2) hosts in an hour after the baseline."""
    base = fan_out(auth.where(F.col("us") <= cutoff)).agg(F.coalesce(F.max("n_hosts"), F.lit(0)).alias("most")).first().most
    return fan_out(auth.where(F.col("us") > cutoff)).where(F.col("n_hosts") >= max(4, base + 2)).withColumn("baseline_most", F.lit(base).cast("long"))


def _as_detections(rows: DataFrame, rule: Rule) -> DataFrame:
    return rows.select(
        F.xxhash64(F.lit(rule.id), F.element_at("event_rids", 1), "actor", "source").alias("det_id"), F.lit(rule.id).alias("rule_id"), F.lit(rule.title).alias("title"), F.lit("anomaly").alias("kind"), F.lit(rule.level).alias("level"), F.lit(rule.kill_chain).alias("kill_chain"),
        F.array(*map(F.lit, rule.techniques)).alias("techniques"), "start_ts", "end_ts", "actor", "host", "source", "event_rids", F.array().cast(ENTITIES).alias("extra_entities"), F.array().cast("array<string>").alias("targets"), F.lit(rule.risk).alias("risk"))


def anomalies(events: DataFrame, fraction: float = 0.25) -> DataFrame:
    """Both kinds as detections; none with fewer than 20 authentication events."""
    auth, cutoff = split_at(events, fraction)
    wide = fan_out_verdict(auth, cutoff).select(F.timestamp_micros("us").alias("start_ts"), F.timestamp_micros("us").alias("end_ts"), F.col("account").alias("actor"), F.coalesce("host", F.lit("")).alias("host"), F.coalesce("source", F.lit("")).alias("source"), F.array("_rid").alias("event_rids"))
    return _as_detections(first_seen(auth, cutoff), FIRST_SEEN).unionByName(_as_detections(wide, FAN_OUT))
