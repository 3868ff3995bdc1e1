"""Incidents: detections linked through shared entities within a time window, with scores, phases and entity risk.

Per entity, detections in time order break into islands wherever one starts
later than the window after all ends before it. The running latest end is
taken in two levels, over ranges of time that hold equally many rows and inside
a range, so a hot entity isn't one task. Incidents are the connected components of the detections and
their islands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lanternlog.functions.entities import entity, filled, short_host
from lanternlog.operators.components import ONE_TASK, components
from lanternlog.operators.ranges import bounds, numbered
from lanternlog.plans.rulebook import ALERT_LEVELS, KIND_WEIGHT, LEVEL_SCORE, TACTICS
from lanternlog.session import Tables

WINDOW_US, WIDTH = 6 * 3_600_000_000, 1 << 16
KINDS = ["actor", "source", "host"]
FLAG_SCORE, FLAG_TECHNIQUES, FLAG_PHASES = 300, 4, 3


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def level_score(column: Column) -> Column:
    return F.coalesce(literal_map(LEVEL_SCORE)[column], F.lit(3))


def kind_weight(column: Column) -> Column:
    return F.coalesce(literal_map(KIND_WEIGHT)[column], F.lit(1.0))


def risk_of(risk: Column, level: Column, kind: Column) -> Column:
    """A rule's own risk, or its level's, by the kind's weight, cut off."""
    return (F.coalesce(risk.cast("double"), level_score(level) * 10.0) * kind_weight(kind)).cast("int")


def entities(found: DataFrame) -> DataFrame:
    """det_id, kind, value, norm: the distinct entities of each detection; empty ones are none."""
    own = [F.when(filled(F.col(k)).isNotNull(), F.struct(F.lit(k).alias("kind"), F.col(k).alias("value"))) for k in KINDS]
    every = F.array_distinct(F.array_compact(F.concat(F.array(*own), F.coalesce(F.col("extra_entities"), F.array().cast("array<struct<kind:string,value:string>>")))))
    rows = found.select("det_id", F.inline(every)).where(filled(F.col("value")).isNotNull())
    return rows.withColumn("norm", entity(F.col("value"), F.col("kind") == "host")).where("norm <> ''")


def islands(found: DataFrame, keys: DataFrame, window_us: int = WINDOW_US, width: int = WIDTH) -> DataFrame:
    """det_id, kind, norm, island: the island of each detection and entity; island is the first start in it, in microseconds."""
    times = found.select("det_id", F.unix_micros("start_ts").alias("a"), F.unix_micros(F.coalesce("end_ts", "start_ts")).alias("e"))
    rows, seen = Tables(found.sparkSession, "islands").put_seen(keys.select("det_id", "kind", "norm").distinct().join(times.where("a is not null"), "det_id"), n=F.count(F.lit(1)))
    rows = numbered(rows, "a", bounds(rows.select("a"), "a", width, rows=seen["n"]), "b")
    entity_key = ["kind", "norm"]
    before = Window.partitionBy(*entity_key).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*entity_key, "b").agg(F.max("e").alias("_e")).withColumn("_carry", F.max("_e").over(before)).drop("_e")
    inside = Window.partitionBy(*entity_key, "b").orderBy("a", "det_id")
    seen = rows.join(carried, [*entity_key, "b"]).withColumn("_last", F.greatest(F.col("_carry"), F.max("e").over(inside.rowsBetween(Window.unboundedPreceding, -1))))
    breaks = seen.withColumn("_new", F.col("_last").isNull() | (F.col("a") - F.col("_last") > window_us)).withColumn("_start", F.max(F.when(F.col("_new"), F.col("a"))).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    opened = breaks.groupBy(*entity_key, "b").agg(F.max("_start").alias("_s")).withColumn("_open", F.max("_s").over(before)).drop("_s")
    return breaks.join(opened, [*entity_key, "b"]).select("det_id", *entity_key, F.coalesce("_start", "_open").alias("island"))


def correlate(found: DataFrame, window_us: int = WINDOW_US) -> DataFrame:
    """det_id, incident_id; an incident is named by its smallest det_id. Detections without entities are incidents of their own; those without a start are left out."""
    keys = entities(found)
    links = islands(found, keys, window_us)
    # a star from the smallest detection of each island, found by aggregation rather than by a window over a hot island
    least = links.groupBy("kind", "norm", "island").agg(F.min("det_id").alias("v"))
    edges = links.join(least, ["kind", "norm", "island"]).where("det_id <> v").select(F.col("det_id").alias("u"), "v").distinct()
    groups = components(edges, ONE_TASK)
    own = found.where("start_ts is not null").select("det_id")
    return own.join(groups, own["det_id"] == groups["id"], "left").select("det_id", F.coalesce("component", "det_id").alias("incident_id"))


def tactic_rank(column: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, TACTICS)), column)
    return F.when(at > 0, at - 1).otherwise(99)


def summarize(members: DataFrame) -> DataFrame:
    """One row an incident: start_ts, end_ts, n_detections, phases, techniques, score, severity, confidence, accounts, sources, hosts, targeted.

    members: detections with incident_id. phases are in order of first
    occurrence of medium and higher alerts that are no sequences (of all that
    are none where there is none), ties by tactic; sequences only add theirs.
    """
    keys = entities(members).join(members.select("det_id", "incident_id"), "det_id")
    names = keys.groupBy("incident_id").agg(*[F.sort_array(F.collect_set(F.when(F.col("kind") == k, F.col("value")))).alias(n) for k, n in (("actor", "accounts"), ("source", "sources"), ("host", "hosts"))])
    # the first occurrence of each phase is an aggregate, so the ordered part has a row a phase
    firsts = members.withColumn("_story", F.when(F.col("kind") == "sequence", 2).when(F.col("level").isin(ALERT_LEVELS), 0).otherwise(1))
    firsts = firsts.groupBy("incident_id", "_story", F.coalesce("kill_chain", F.lit("Unknown")).alias("phase")).agg(F.min(F.struct(F.unix_micros("start_ts").alias("us"), tactic_rank(F.col("kill_chain")).alias("tactic"))).alias("at"))
    ordered = firsts.groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("_story", "at", "phase"))).alias("p"))
    has = F.exists("p", lambda x: x["_story"] == 0)
    used = F.filter("p", lambda x: (x["_story"] == 2) | (x["_story"] == F.when(has, 0).otherwise(1)))
    ordered = ordered.select("incident_id", F.array_distinct(F.transform(used, lambda x: x["phase"])).alias("phases"))
    techniques = members.select("incident_id", F.explode("techniques").alias("t")).groupBy("incident_id").agg(F.sort_array(F.collect_set("t")).alias("techniques"))
    targets = members.select("incident_id", F.explode("targets").alias("t")).groupBy("incident_id").agg(F.sort_array(F.collect_set("t")).alias("targeted")) if "targets" in members.columns else None
    base = members.groupBy("incident_id").agg(
        F.min("start_ts").alias("start_ts"), F.max(F.coalesce("end_ts", "start_ts")).alias("end_ts"), F.count(F.lit(1)).alias("n_detections"),
        F.sum(level_score(F.col("level")) * kind_weight(F.col("kind"))).alias("_base"), F.max((F.col("kind") == "sequence").cast("int")).alias("_sequence"))
    out = base.join(ordered, "incident_id").join(techniques, "incident_id", "left").join(names, "incident_id", "left")
    out = out.join(targets, "incident_id", "left") if targets is not None else out.withColumn("targeted", F.array().cast("array<string>"))
    score = (F.col("_base") + 5 * F.size("phases")).cast("long")
    none = F.array().cast("array<string>")
    return out.withColumn("score", score).select(
        "incident_id", "start_ts", "end_ts", "n_detections", "phases", *[F.coalesce(c, none).alias(c) for c in ("techniques", "accounts", "sources", "hosts", "targeted")], "score",
        severity(F.col("score")).alias("severity"), confidence(F.col("_sequence") == 1, F.size("phases")).alias("confidence"))


def severity(score: Column) -> Column:
    return F.when(score >= 40, "Critical").when(score >= 20, "High").when(score >= 10, "Medium").otherwise("Low")


def confidence(has_sequence: Column, phases: Column) -> Column:
    return F.when(has_sequence, "High (confirmed multi-stage sequence)").when(phases >= 3, "Medium (multiple correlated phases)").otherwise("Low (single-stage signal)")


def entity_risk(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """kind, norm, value, score, detections, techniques, phases, flagged; by: columns of `found` to group by too."""
    by = by or []
    rows = entities(found).join(found.select("det_id", *by, "techniques", "kill_chain", "start_ts", risk_of(F.col("risk"), F.col("level"), F.col("kind")).alias("_risk")), "det_id")
    base = rows.groupBy(*by, "kind", "norm").agg(F.min_by("value", F.struct("start_ts", "det_id", "value")).alias("value"), F.sum("_risk").alias("score"), F.count(F.lit(1)).alias("detections"), F.collect_set(F.coalesce("kill_chain", F.lit("Unknown"))).alias("phases"), F.array_distinct(F.flatten(F.collect_set("techniques"))).alias("techniques"))
    flagged = (F.col("score") >= FLAG_SCORE) | ((F.size("techniques") >= FLAG_TECHNIQUES) & (F.size("phases") >= FLAG_PHASES))
    return base.select(*by, "kind", "norm", "value", "score", "detections", F.sort_array("techniques").alias("techniques"), F.sort_array("phases").alias("phases"), flagged.alias("flagged"))


def alert_groups(members: DataFrame) -> DataFrame:
    """incident_id, rule_id, host_key, title, level, host, kill_chain, techniques, first_at, last_at, n, actors, risk: detections of one rule on one host."""
    at = F.struct("start_ts", "det_id")
    rows = members.withColumn("host_key", F.lower(F.coalesce(short_host(F.col("host")), F.lit(""))))
    return rows.groupBy("incident_id", "rule_id", "host_key").agg(
        F.min_by("title", at).alias("title"), F.min_by("level", at).alias("level"), F.min_by("host", at).alias("host"), F.min_by("kill_chain", at).alias("kill_chain"), F.min_by("techniques", at).alias("techniques"), F.min("start_ts").alias("first_at"), F.max(F.coalesce("end_ts", "start_ts")).alias("last_at"),
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(filled(F.col("actor")))).alias("actors"), F.sum(risk_of(F.col("risk"), F.col("level"), F.col("kind"))).alias("risk"))


def entity_rollup(members: DataFrame) -> DataFrame:
    """kind, norm, n_detections, n_incidents, first_at, last_at, risk, n_techniques of every entity."""
    rows = entities(members).select("det_id", "kind", "norm").distinct().join(members.select("det_id", "incident_id", "techniques", "start_ts", "end_ts", risk_of(F.col("risk"), F.col("level"), F.col("kind")).alias("_risk")), "det_id")
    return rows.groupBy("kind", "norm").agg(F.count(F.lit(1)).alias("n_detections"), F.count_distinct("incident_id").alias("n_incidents"), F.min("start_ts").alias("first_at"), F.max(F.coalesce("end_ts", "start_ts")).alias("last_at"), F.sum("_risk").alias("risk"), F.size(F.array_distinct(F.flatten(F.collect_set("techniques")))).cast("long").alias("n_techniques"))


def co_occurrence(found: DataFrame) -> DataFrame:
    """kind_a, norm_a, kind_b, norm_b, n: how many detections two entities share, both ways.

    The pairs are made inside a detection, which has a handful of entities.
    """
    per = entities(found).groupBy("det_id").agg(F.collect_set(F.struct("kind", "norm")).alias("k"))
    pairs = F.flatten(F.transform("k", lambda a: F.transform(F.filter("k", lambda b: b != a), lambda b: F.struct(a["kind"].alias("kind_a"), a["norm"].alias("norm_a"), b["kind"].alias("kind_b"), b["norm"].alias("norm_b")))))
    return per.select(F.inline(pairs)).groupBy("kind_a", "norm_a", "kind_b", "norm_b").agg(F.count(F.lit(1)).alias("n"))


def graph_edges(members: DataFrame, per_kind: int = 10) -> DataFrame:
    """incident_id, from_key, to_key, n_techniques: source to actor to host (source to host without actor), between each incident's entities of highest risk."""
    risk = entity_risk(members, ["incident_id"])
    top = Window.partitionBy("incident_id", "kind").orderBy(F.desc("score"), "norm")
    keep = risk.withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= per_kind).select("incident_id", F.concat_ws(":", "kind", "norm").alias("key"))
    key = lambda k: F.when(filled(F.col(k)).isNotNull(), F.concat(F.lit(k + ":"), entity(F.col(k), k == "host")))
    rows = members.where((F.col("kind") != "sequence") & F.col("level").isin(ALERT_LEVELS)).select("incident_id", key("source").alias("s"), key("actor").alias("a"), key("host").alias("h"), F.coalesce(F.get("techniques", F.lit(0)), F.substring("title", 1, 28)).alias("t"))
    pair = lambda x, y: F.struct(F.col(x).alias("from_key"), F.col(y).alias("to_key"))
    edges = rows.select("incident_id", "t", F.inline(F.when(F.col("a").isNotNull(), F.array(pair("s", "a"), pair("a", "h"))).otherwise(F.array(pair("s", "h"))))).where("from_key is not null and to_key is not null")
    edges = edges.groupBy("incident_id", "from_key", "to_key").agg(F.count_distinct("t").alias("n_techniques"))
    a, b = keep.select(F.col("incident_id").alias("_i"), F.col("key").alias("_k")), keep.select(F.col("incident_id").alias("_j"), F.col("key").alias("_l"))
    return edges.join(a, (F.col("incident_id") == F.col("_i")) & (F.col("from_key") == F.col("_k")), "left_semi").join(b, (F.col("incident_id") == F.col("_j")) & (F.col("to_key") == F.col("_l")), "left_semi")


def technique_counts(found: DataFrame) -> DataFrame:
    return found.select(F.explode("techniques").alias("technique")).groupBy("technique").agg(F.count(F.lit(1)).alias("n"))
