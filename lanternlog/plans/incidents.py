"""Queries of incidents, entities, suppression and lineage, over the stored detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lanternlog.operators import incidents as I
from lanternlog.operators import processes, suppression
from lanternlog.plans.rules import _norm, events
from lanternlog.session import Tables
from lanternlog.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def found(spark: SparkSession, d: str) -> DataFrame:
    """Stored detections; rule spellings made one."""
    rows = table(spark, d, "detections")
    return rows.withColumns({"rule_id": F.lower(F.trim("rule_id")), "targets": F.array().cast("array<string>")})


def members(spark: SparkSession, d: str) -> DataFrame:
    """Detections with their incident, written once."""
    rows = found(spark, d)
    return Tables(spark, "members").put(rows.join(I.correlate(rows), "det_id"))


_ENT = f"""
ent AS (SELECT DISTINCT det_id, kind, value, CASE WHEN kind = 'host' THEN {_norm('value', True)} ELSE {_norm('value', False)} END AS norm FROM (
  SELECT det_id, 'actor' AS kind, actor AS value FROM detections UNION ALL SELECT det_id, 'source', source FROM detections UNION ALL SELECT det_id, 'host', host FROM detections
  UNION ALL SELECT det_id, e.kind, e.value FROM (SELECT det_id, unnest(extra_entities) AS e FROM detections)) WHERE value IS NOT NULL AND value NOT IN ('', '-')),
k AS (SELECT DISTINCT e.det_id, e.kind, norm, epoch_us(start_ts) AS a, epoch_us(coalesce(end_ts, start_ts)) AS z FROM ent e JOIN detections d ON d.det_id = e.det_id WHERE norm <> '')"""
COMP_SQL = f"""WITH RECURSIVE {_ENT},
o AS (SELECT *, max(z) OVER (PARTITION BY kind, norm ORDER BY a, det_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pz FROM k),
i AS (SELECT *, sum(CASE WHEN pz IS NULL OR a - pz > {I.WINDOW_US} THEN 1 ELSE 0 END) OVER (PARTITION BY kind, norm ORDER BY a, det_id) AS isl FROM o),
m AS (SELECT kind, norm, isl, min(det_id) AS v FROM i GROUP BY 1, 2, 3),
l AS (SELECT i.det_id AS a, m.v AS b FROM i JOIN m USING (kind, norm, isl) WHERE i.det_id <> m.v UNION SELECT m.v, i.det_id FROM i JOIN m USING (kind, norm, isl) WHERE i.det_id <> m.v),
r AS (SELECT det_id AS s, det_id AS x FROM detections UNION SELECT r.s, l.b FROM r JOIN l ON r.x = l.a),
comp AS (SELECT s AS det_id, min(x) AS incident_id FROM r GROUP BY 1),
mem AS (SELECT d.*, comp.incident_id, CASE level WHEN 'informational' THEN 1 WHEN 'low' THEN 2 WHEN 'medium' THEN 4 WHEN 'high' THEN 7 WHEN 'critical' THEN 10 ELSE 3 END AS ls, CASE kind WHEN 'sequence' THEN 1.5 WHEN 'anomaly' THEN 0.5 ELSE 1.0 END AS kw FROM detections d JOIN comp USING (det_id))"""


@query(COMP_SQL + " SELECT det_id, incident_id FROM comp")
def incident_components(spark: SparkSession, d: str) -> DataFrame:
    return I.correlate(found(spark, d))


_TACTICS = "list_position(['Reconnaissance', 'Resource Development', 'Initial Access', 'Execution', 'Persistence', 'Privilege Escalation', 'Defense Evasion', 'Stealth', 'Defense Impairment', 'Credential Access', 'Discovery', 'Lateral Movement', 'Collection', 'Command and Control', 'Exfiltration', 'Impact'], kill_chain)"
SUM_SQL = COMP_SQL + f""",
ph0 AS (SELECT incident_id, CASE WHEN kind = 'sequence' THEN 2 WHEN level IN ('medium', 'high', 'critical') THEN 0 ELSE 1 END AS st, coalesce(kill_chain, 'Unknown') AS phase, min((epoch_us(start_ts), coalesce({_TACTICS}, 100))) AS ats FROM mem GROUP BY 1, 2, 3),
ph1 AS (SELECT * FROM ph0 p WHERE st = 2 OR st = (SELECT min(st) FROM ph0 q WHERE q.incident_id = p.incident_id AND st < 2)),
ph2 AS (SELECT incident_id, phase, min((st, ats)) AS o FROM ph1 GROUP BY 1, 2),
ph AS (SELECT incident_id, string_agg(phase, ' > ' ORDER BY o) AS phases, count(*) AS np FROM ph2 GROUP BY 1),
te AS (SELECT incident_id, count(DISTINCT t) AS n_techniques FROM (SELECT incident_id, unnest(techniques) AS t FROM mem) GROUP BY 1),
b AS (SELECT incident_id, count(*) AS n_detections, min(start_ts) AS start_ts, max(coalesce(end_ts, start_ts)) AS end_ts, sum(ls * kw) AS base, bool_or(kind = 'sequence') AS sq FROM mem GROUP BY 1)"""
SEV_SQL = "CASE WHEN {0} >= 40 THEN 'Critical' WHEN {0} >= 20 THEN 'High' WHEN {0} >= 10 THEN 'Medium' ELSE 'Low' END"


@query(SUM_SQL + f""" SELECT b.incident_id, n_detections, start_ts, end_ts, phases, coalesce(n_techniques, 0) AS n_techniques, CAST(floor(base + 5 * np) AS BIGINT) AS score,
{SEV_SQL.format('floor(base + 5 * np)')} AS severity, CASE WHEN sq THEN 'High (confirmed multi-stage sequence)' WHEN np >= 3 THEN 'Medium (multiple correlated phases)' ELSE 'Low (single-stage signal)' END AS confidence
FROM b JOIN ph ON b.incident_id = ph.incident_id LEFT JOIN te ON b.incident_id = te.incident_id""")
def incident_summary(spark: SparkSession, d: str) -> DataFrame:
    """Score, phases, severity and confidence of every incident."""
    out = I.summarize(members(spark, d))
    return out.select("incident_id", "n_detections", "start_ts", "end_ts", F.array_join("phases", " > ").alias("phases"), F.size("techniques").cast("long").alias("n_techniques"), "score", "severity", "confidence")


RISK_SQL = "CAST(trunc(coalesce(CAST(risk AS DOUBLE), ls * 10) * kw) AS INT)"
_LS = "CASE level WHEN 'informational' THEN 1 WHEN 'low' THEN 2 WHEN 'medium' THEN 4 WHEN 'high' THEN 7 WHEN 'critical' THEN 10 ELSE 3 END AS ls, CASE kind WHEN 'sequence' THEN 1.5 WHEN 'anomaly' THEN 0.5 ELSE 1.0 END AS kw"


@query(f"""WITH {_ENT}, rd AS (SELECT *, {RISK_SQL} AS r FROM (SELECT *, {_LS} FROM detections)),
j AS (SELECT e.kind, e.norm, e.value, d.det_id, d.r, d.techniques, coalesce(d.kill_chain, 'Unknown') AS ph FROM ent e JOIN rd d USING (det_id) WHERE e.norm <> ''),
t AS (SELECT kind, norm, count(DISTINCT t) AS nt FROM (SELECT kind, norm, unnest(techniques) AS t FROM j) GROUP BY 1, 2),
g AS (SELECT kind, norm, CAST(sum(r) AS BIGINT) AS score, count(*) AS detections, count(DISTINCT ph) AS n_phases FROM j GROUP BY 1, 2)
SELECT g.kind, g.norm, score, detections, n_phases, coalesce(nt, 0) AS n_techniques, score >= 300 OR (coalesce(nt, 0) >= 4 AND n_phases >= 3) AS flagged FROM g LEFT JOIN t ON g.kind = t.kind AND g.norm = t.norm""")
def entity_risk(spark: SparkSession, d: str) -> DataFrame:
    out = I.entity_risk(found(spark, d))
    return out.select("kind", "norm", "score", "detections", F.size("phases").cast("long").alias("n_phases"), F.size("techniques").cast("long").alias("n_techniques"), "flagged")


@query(COMP_SQL + f""" SELECT incident_id, lower(trim(rule_id)) AS rule_id, lower(CASE WHEN host IS NULL THEN '' WHEN regexp_full_match(host, '[0-9.]*') THEN host ELSE split_part(host, '.', 1) END) AS host_key, count(*) AS n,
min(start_ts) AS first_at, max(coalesce(end_ts, start_ts)) AS last_at, count(DISTINCT CASE WHEN actor NOT IN ('', '-') THEN actor END) AS n_actors, CAST(sum({RISK_SQL}) AS BIGINT) AS risk FROM mem GROUP BY 1, 2, 3""")
def alert_groups(spark: SparkSession, d: str) -> DataFrame:
    return I.alert_groups(members(spark, d)).select("incident_id", "rule_id", "host_key", "n", "first_at", "last_at", F.size("actors").cast("long").alias("n_actors"), "risk")


@query(COMP_SQL + f""", e2 AS (SELECT DISTINCT det_id, kind AS ek, norm FROM ent WHERE norm <> ''), j AS (SELECT e2.ek, e2.norm, m.*, {RISK_SQL} AS r FROM e2 JOIN mem m USING (det_id)),
t AS (SELECT ek, norm, count(DISTINCT t) AS nt FROM (SELECT ek, norm, unnest(techniques) AS t FROM j) GROUP BY 1, 2)
SELECT j.ek AS kind, j.norm, count(*) AS n_detections, count(DISTINCT incident_id) AS n_incidents, min(start_ts) AS first_at, max(coalesce(end_ts, start_ts)) AS last_at, CAST(sum(r) AS BIGINT) AS risk, coalesce(any_value(nt), 0) AS n_techniques
FROM j LEFT JOIN t ON j.ek = t.ek AND j.norm = t.norm GROUP BY 1, 2""")
def entity_rollup(spark: SparkSession, d: str) -> DataFrame:
    return I.entity_rollup(members(spark, d))


@query(f"WITH {_ENT}, e AS (SELECT DISTINCT det_id, kind, norm FROM ent WHERE norm <> '') SELECT a.kind AS kind_a, a.norm AS norm_a, b.kind AS kind_b, b.norm AS norm_b, count(*) AS n FROM e a JOIN e b ON a.det_id = b.det_id AND (a.kind, a.norm) <> (b.kind, b.norm) GROUP BY 1, 2, 3, 4")
def entity_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return I.co_occurrence(found(spark, d))


def _key(kind: str) -> str:
    return f"CASE WHEN {kind} IS NOT NULL AND {kind} NOT IN ('', '-') THEN '{kind}:' || {_norm(kind, kind == 'host')} END"


@query(COMP_SQL + f""", er AS (SELECT m.incident_id, e.kind, e.norm, sum(trunc(coalesce(CAST(m.risk AS DOUBLE), m.ls * 10) * m.kw)) AS s FROM ent e JOIN mem m USING (det_id) WHERE e.norm <> '' GROUP BY 1, 2, 3),
keep AS (SELECT incident_id, kind || ':' || norm AS k FROM er QUALIFY row_number() OVER (PARTITION BY incident_id, kind ORDER BY s DESC, norm) <= 10),
p AS (SELECT incident_id, {_key('source')} AS s, {_key('actor')} AS a, {_key('host')} AS h, coalesce(techniques[1], left(title, 28)) AS t FROM mem WHERE kind <> 'sequence' AND level IN ('medium', 'high', 'critical')),
x AS (SELECT incident_id, t, CASE WHEN a IS NOT NULL THEN s ELSE s END AS f, CASE WHEN a IS NOT NULL THEN a ELSE h END AS g FROM p UNION ALL SELECT incident_id, t, a, h FROM p WHERE a IS NOT NULL)
SELECT incident_id, f AS from_key, g AS to_key, count(DISTINCT t) AS n_techniques FROM x WHERE f IS NOT NULL AND g IS NOT NULL AND (incident_id, f) IN (SELECT (incident_id, k) FROM keep) AND (incident_id, g) IN (SELECT (incident_id, k) FROM keep) GROUP BY 1, 2, 3""")
def graph_edges_topk(spark: SparkSession, d: str) -> DataFrame:
    return I.graph_edges(members(spark, d))


@query("SELECT t AS technique, count(*) AS n FROM (SELECT unnest(techniques) AS t FROM detections) GROUP BY 1")
def technique_counts(spark: SparkSession, d: str) -> DataFrame:
    return I.technique_counts(found(spark, d))


SUPPRESSIONS = [
    suppression.Suppression("s-001", "qx-0010", {"host": "qdc-a1*"}, "known scanner"),
    suppression.Suppression("s-002", "*", {"actor": "*svc_mirror*"}, "replication service", allow_broad=True),
    suppression.Suppression("s-003", "qx-0009", {}, "expired", expires="2020-01-01"),
    suppression.Suppression("s-004", "*", {"host": "srv00?"}, "not allowed to be broad"),
    suppression.Suppression("s-005", "Beacon-like connections", {"host": "srv0*", "actor": "*"}, "by title", allow_critical=True),
]
_SUPPRESSED = "CASE WHEN lower(trim(rule_id)) = 'qx-0010' AND starts_with(lower(host), 'qdc-a1') AND level <> 'critical' THEN 's-001' WHEN contains(lower(actor), 'svc_mirror') AND level <> 'critical' THEN 's-002' WHEN lower(title) = 'beacon-like connections' AND starts_with(lower(host), 'srv0') AND actor IS NOT NULL THEN 's-005' END"


@query(f"SELECT det_id, coalesce({_SUPPRESSED}, '') AS suppressed_by FROM detections")
def suppress_split(spark: SparkSession, d: str) -> DataFrame:
    return suppression.apply(found(spark, d), SUPPRESSIONS).select("det_id", F.coalesce("suppressed_by", F.lit("")).alias("suppressed_by"))


_STORY = "(level IN ('medium', 'high', 'critical') AND kind <> 'sequence')"


def _phase_count(cond: str) -> str:
    mid, rest = (f"count(DISTINCT CASE WHEN {cond} AND {c} THEN coalesce(kill_chain, 'Unknown') END)" for c in (_STORY, "kind <> 'sequence'"))
    return f"(CASE WHEN {mid} > 0 THEN {mid} ELSE {rest} END)"


@query(COMP_SQL + f""", s AS (SELECT *, {_SUPPRESSED} IS NOT NULL AS hid, CASE WHEN host IS NULL THEN '' WHEN regexp_full_match(host, '[0-9.]*') THEN host ELSE split_part(host, '.', 1) END AS sh FROM mem),
g AS (SELECT incident_id, count(*) FILTER (WHERE hid) AS n_hidden, count(*) FILTER (WHERE NOT hid) AS n_left, floor(coalesce(sum(ls * kw), 0) + 5 * {_phase_count('true')}) AS s0, floor(coalesce(sum(ls * kw) FILTER (WHERE NOT hid), 0) + 5 * {_phase_count('NOT hid')}) AS s1,
coalesce(min_by(hid, (start_ts, det_id)) FILTER (WHERE {_STORY}), false) AS hides_first, count(DISTINCT CASE WHEN {_STORY} THEN coalesce(kill_chain, 'Unknown') END) - count(DISTINCT CASE WHEN {_STORY} AND NOT hid THEN coalesce(kill_chain, 'Unknown') END) AS phases_lost FROM s GROUP BY 1),
h AS (SELECT incident_id, count(*) FILTER (WHERE x) AS hosts_lost FROM (SELECT incident_id, sh, min_by(hid, (start_ts, det_id)) AS x FROM s WHERE {_STORY} GROUP BY 1, 2) GROUP BY 1)
SELECT g.incident_id, n_hidden, {SEV_SQL.format('s0')} AS severity_before, CASE WHEN n_left = 0 THEN '(incident disappears)' ELSE {SEV_SQL.format('s1')} END AS severity_after, hides_first, coalesce(hosts_lost, 0) AS hosts_lost, phases_lost
FROM g LEFT JOIN h ON g.incident_id = h.incident_id WHERE n_hidden > 0""")
def suppress_impact(spark: SparkSession, d: str) -> DataFrame:
    """What the suppressions would cost each incident."""
    rows = suppression.apply(members(spark, d), SUPPRESSIONS)
    return suppression.impact(rows).drop("risky")


_PROC = """p AS (SELECT lower(ProcessGuid) AS guid, max_by(lower(coalesce(ParentProcessGuid, '')), (_ingested, _rid)) AS parent, max_by(coalesce(Image, ''), (_ingested, _rid)) AS image FROM sec_events WHERE EventID = 1 AND ProcessGuid <> '' GROUP BY 1)"""


@query(f"WITH {_PROC} SELECT guid, parent, image FROM p")
def process_index(spark: SparkSession, d: str) -> DataFrame:
    return processes.process_index(events(spark, d)).select("guid", "parent", "image")


@query(f"""WITH RECURSIVE {_PROC}, s AS (SELECT DISTINCT lower(ProcessGuid) AS guid FROM sec_events WHERE EventID = 1 AND contains(lower(CommandLine), 'copy')),
w AS (SELECT s.guid, s.guid AS ancestor, p.parent, 1 AS depth FROM s JOIN p USING (guid) UNION ALL SELECT w.guid, p.guid, p.parent, depth + 1 FROM w JOIN p ON w.parent = p.guid WHERE depth < 15 AND p.guid <> w.guid)
SELECT guid, ancestor, depth FROM w""")
def process_tree(spark: SparkSession, d: str) -> DataFrame:
    """The ancestors of processes that copied something."""
    rows = events(spark, d)
    start = rows.where((F.col("EventID") == 1) & F.lower("CommandLine").contains("copy")).select(F.lower("ProcessGuid").alias("guid"))
    return processes.ancestors(processes.process_index(rows), start)
