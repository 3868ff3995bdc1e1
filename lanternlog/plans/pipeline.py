"""The whole hunt: events to detections to incidents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from lanternlog.operators import incidents as I
from lanternlog.operators import suppression
from lanternlog.operators.anomalies import anomalies
from lanternlog.operators.hits import DETECTION, detections, live_rules
from lanternlog.operators.sequences import sequences
from lanternlog.plans.rulebook import ALERT_LEVELS, Rule
from lanternlog.session import Tables


@dataclass
class Hunt:
    signatures: DataFrame  # with suppressed_by
    detections: DataFrame  # what is left, sequences and anomalies too
    members: DataFrame  # detections with incident_id
    incidents: DataFrame


def hunt(events: DataFrame, rules: list[Rule], sups: list | None = None, window_us: int = I.WINDOW_US, min_score: int = 0, with_anomalies: bool = True) -> Hunt:
    """Signatures that can match what arrives, sequences over them, suppression, anomalies, correlation. Written stage by stage to the shared folder."""
    tables = Tables(events.sparkSession, "hunt")
    signatures = live_rules(events, [r for r in rules if r.kind == "signature"])
    found = tables.put(detections(events, signatures))
    sequenced = sequences(rules, found, events)
    marked = suppression.apply(found, sups or [], events)
    every = marked.where("suppressed_by is null").select(*DETECTION)
    if sequenced is not None:
        every = every.unionByName(sequenced)
    if with_anomalies:
        every = every.unionByName(anomalies(events).select(*DETECTION))
    every = tables.put(every)
    members = tables.put(every.join(I.correlate(every, window_us), "det_id"))
    summary = I.summarize(members).where(F.col("score") >= min_score)
    return Hunt(marked, every, members, summary.orderBy(F.desc("score"), "start_ts", "incident_id"))


def campaign_summary(result: Hunt, n_events: int) -> dict:
    """What one campaign came to."""
    alerts = result.signatures.where(F.col("level").isin(ALERT_LEVELS)).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rule_id").alias("rules")).first()
    top = result.incidents.limit(1).collect()
    seqs = [r.rule_id for r in result.detections.where("kind = 'sequence'").select("rule_id").distinct().orderBy("rule_id").collect()]
    return {"events": n_events, "detections": alerts.n, "rules_fired": alerts.rules, "incidents": result.incidents.count(), "top_severity": top[0].severity if top else "none", "sequences": seqs}
