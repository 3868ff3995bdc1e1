"""Rule hits: many rules over one scan.

All predicates of a batch are one projection whose array of hits is exploded,
so a scan serves a whole batch; fields are folded to lower case once. Batches
are kept small enough for whole-stage code generation and hold rules of the
same event ids, so that in a lake sorted by event id they share out one scan.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from lanternlog.functions.entities import filled, pick
from lanternlog.functions.match import Event, compile_rule, fold_columns
from lanternlog.operators.bursts import bursts
from lanternlog.operators.coverage import channel_key, requirements
from lanternlog.plans.rulebook import Rule, RuleError, candidate_events, fields_read
from lanternlog.session import Tables

BATCH = 50


def live_rules(events: DataFrame, rules: list[Rule]) -> list[Rule]:
    """Rules without those that can't match for lack of their event ids or channel. One pass over two columns; the names of rules come back."""
    need, ids = requirements(events.sparkSession, rules)
    seen = Tables(events.sparkSession, "seen").put(events.select("EventID", channel_key().alias("channel")).distinct())
    heard = seen.agg(F.collect_set("channel").alias("heard")).withColumn("_one", F.lit(1))
    arrives = ids.join(seen.select(F.col("EventID").alias("event_id")), "event_id", "left_semi").select("rule_id").distinct().withColumn("arrives", F.lit(True))
    served = (F.size("channels") == 0) | F.array_contains("heard", "") | F.arrays_overlap("channels", "heard")
    kept = need.withColumn("_one", F.lit(1)).join(heard, "_one").join(arrives, "rule_id", "left").where(served & (F.col("any_event") | F.col("arrives")))
    names = {r.rule_id for r in kept.select("rule_id").collect()}
    return [r for r in rules if r.id in names]


def batches_of(rules: list[Rule], size: int) -> list[list[tuple[int, Rule]]]:
    """(place in `rules`, rule) in batches of rules with the same event ids as far as can be, so that each batch's scan skips what others read."""
    ids = {i: candidate_events(r) for i, r in enumerate(rules)}
    order = sorted(ids, key=lambda i: (ids[i] is None, sorted(ids[i] or ())))
    return [[(i, rules[i]) for i in order[at : at + size]] for at in range(0, len(order), size)] or [[]]


def narrowed(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """Only the columns and event ids that some rule can read; the filter reaches the scan."""
    wanted = [fields_read(r) for r in rules]
    if all(w is not None for w in wanted):
        need = {n.lower() for n in set().union(*wanted) | {"_rid", "EventID", "TimeCreated", "Channel", "_platform"}}
        missing = need - {c.lower() for c in events.columns}
        events = events.select(*[c for c in events.columns if c.lower() in need or (c == "fields" and missing)])
    ids = [candidate_events(r) for r in rules]
    if ids and all(i is not None for i in ids):
        events = events.where(F.col("EventID").isin(sorted(set().union(*ids))))
    return events


def _by_rule(part: list[tuple[int, Rule]], asks, build) -> Column:
    """build(asks(rule)) where `rule_no` is the rule's; a column is built once for all rules that ask alike."""
    groups: dict[object, list[int]] = {}
    for i, rule in part:
        groups.setdefault(asks(rule), []).append(i)
    columns = [(numbers, build(asked)) for asked, numbers in groups.items()]
    if len(columns) == 1:
        return columns[0][1]
    out = F.lit(None)
    for numbers, column in columns:
        out = F.when(F.col("rule_no").isin(numbers), column).otherwise(out)
    return out


def rule_hits(events: DataFrame, rules: list[Rule], batch: int = BATCH) -> DataFrame:
    """rule_no, _rid, TimeCreated, actor, host, source, target, burst_key, burst_value: a row a rule and matching event.

    rule_no is the rule's place in `rules`, which must be signatures. Events
    need `_rid`, EventID, TimeCreated; other columns and the map `fields` are
    used as far as they are there.
    """
    if any(r.kind != "signature" for r in rules):
        raise RuleError("only signature rules match events")
    out = []
    for part in batches_of(rules, batch):
        own = [r for _, r in part]
        rows, event = fold_columns(narrowed(events, own), own)
        matched = F.array_compact(F.array(*[F.when(compile_rule(r, event), F.lit(i)) for i, r in part])) if part else F.array().cast("array<int>")
        text = Event(rows.columns, rows.sparkSession).text
        burst = lambda r, what: (r.threshold or {}).get(what)
        none = F.lit(None).cast("string")
        columns = {w: _by_rule(part, lambda r, w=w: tuple(r.pick(w)), lambda names, text=text: pick([text(n) for n in names])) for w in ("actor", "host", "source")}
        columns["target"] = _by_rule(part, lambda r: r.meta.get("collect_targets"), lambda name, text=text: filled(text(name)) if name else none)
        columns["burst_key"] = _by_rule(part, lambda r: tuple(burst(r, "group_by") or ()), lambda names, text=text: F.concat_ws("\x1f", *[F.coalesce(text(n), F.lit("")) for n in names]) if names else F.lit(""))
        columns["burst_value"] = _by_rule(part, lambda r: burst(r, "distinct"), lambda name, text=text: F.lower(F.coalesce(text(name), F.lit(""))) if name else none)
        rows = rows.withColumn("rule_no", F.explode(matched))
        out.append(rows.select("rule_no", "_rid", "TimeCreated", *[c.cast("string").alias(name) for name, c in columns.items()]))
    return functools.reduce(DataFrame.unionAll, out)


def rule_table(spark, rules: list[Rule]) -> DataFrame:
    """One row a rule; as many as there are rules."""
    rows = [(i, r.id, r.title, r.kind, r.level, r.kill_chain, r.techniques, r.risk) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_no int, rule_id string, title string, kind string, level string, kill_chain string, techniques array<string>, risk int")


DETECTION = ["det_id", "rule_id", "title", "kind", "level", "kill_chain", "techniques", "start_ts", "end_ts", "actor", "host", "source", "event_rids", "extra_entities", "targets", "risk"]
ENTITIES = "array<struct<kind:string,value:string>>"


def detections(events: DataFrame, rules: list[Rule], batch: int = BATCH) -> DataFrame:
    """Detections of signature rules: one a hit, or one a burst for rules with a threshold.

    Actor, host and source are those of the first event. det_id is a hash of
    rule and first event, so it is the same in every run.
    """
    spark = events.sparkSession
    hits = rule_hits(events, rules, batch)
    burst_rules = [i for i, r in enumerate(rules) if r.threshold]
    single = hits.where(~F.col("rule_no").isin(burst_rules)) if burst_rules else hits
    rows = single.select("rule_no", F.col("TimeCreated").alias("start_ts"), F.col("TimeCreated").alias("end_ts"), "actor", "host", "source", F.array("_rid").alias("event_rids"), F.array_compact(F.array("target")).alias("targets"))
    if burst_rules:
        specs = [(i, int(rules[i].threshold["count"]), int(rules[i].threshold.get("within_seconds", 60)) * 1_000_000, bool(rules[i].threshold.get("distinct"))) for i in burst_rules]
        held = hits.where(F.col("rule_no").isin(burst_rules))
        rows = rows.unionByName(bursts(held, specs).select("rule_no", "start_ts", "end_ts", "actor", "host", "source", "event_rids", "targets"))
    rows = rows.join(F.broadcast(rule_table(spark, rules)), "rule_no")
    return rows.withColumn("det_id", F.xxhash64("rule_id", F.element_at("event_rids", 1))).withColumn("extra_entities", F.array().cast(ENTITIES)).select(*DETECTION)
