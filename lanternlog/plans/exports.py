"""Queries of documents, transpiled rules, validation, streams and grounding."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from lanternlog.operators import incidents as I
from lanternlog.plans import documents, grounding, pipeline, reports, transpile, validation
from lanternlog.plans.incidents import RISK_SQL, SEV_SQL, SUM_SQL, members
from lanternlog.plans.rules import MULTI_SQL, pack, signatures, timed_events
from lanternlog.session import Tables
from lanternlog.sources import tables as tables_
from lanternlog.streaming.live import stream_alerts

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _iso(column: str) -> str:
    return f"regexp_replace(strftime(CAST({column} AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S.%f'), '\\.0{{6}}$', '')"


_SCORE = "CAST(floor(base + 5 * np) AS BIGINT)"
_KIND = "CASE kind WHEN 'actor' THEN 'Account' WHEN 'source' THEN 'Source' WHEN 'host' THEN 'Host' ELSE kind END"


@query(SUM_SQL + f""",
ee AS (SELECT DISTINCT mem.incident_id, ent.kind, ent.value, ent.norm, mem.det_id, mem.start_ts, {RISK_SQL} AS r, mem.techniques, coalesce(kill_chain, 'Unknown') AS ph FROM ent JOIN mem USING (det_id) WHERE ent.norm <> ''),
names AS (SELECT incident_id, list_sort(list_distinct(list(value) FILTER (WHERE kind = 'actor'))) AS a, list_sort(list_distinct(list(value) FILTER (WHERE kind = 'source'))) AS s, list_sort(list_distinct(list(value) FILTER (WHERE kind = 'host'))) AS h FROM ee GROUP BY 1),
er AS (SELECT incident_id, kind, norm, min_by(value, (start_ts, det_id, value)) AS value, CAST(sum(r) AS BIGINT) AS score, count(DISTINCT ph) AS nph, list_sort(list_distinct(flatten(list(coalesce(techniques, []))))) AS techniques FROM ee GROUP BY 1, 2, 3),
er2 AS (SELECT incident_id, list(struct_pack(type := {_KIND}, value := value, score := score, flagged := score >= 300 OR (len(techniques) >= 4 AND nph >= 3), techniques := techniques) ORDER BY -score, kind, norm) AS entity_risk FROM er GROUP BY 1),
tl AS (SELECT incident_id, list_sort(list_distinct(list(t))) AS techniques FROM (SELECT incident_id, unnest(techniques) AS t FROM mem) GROUP BY 1),
pl AS (SELECT incident_id, list(phase ORDER BY o) AS phases FROM ph2 GROUP BY 1),
hd AS (SELECT b.incident_id, {_iso('start_ts')} AS a, {_iso('end_ts')} AS z, {SEV_SQL.format(_SCORE)} AS severity, {_SCORE} AS score, CASE WHEN sq THEN 'High (confirmed multi-stage sequence)' WHEN np >= 3 THEN 'Medium (multiple correlated phases)' ELSE 'Low (single-stage signal)' END AS confidence, pl.phases,
  coalesce(tl.techniques, []) AS techniques, struct_pack(accounts := coalesce(names.a, []), sources := coalesce(names.s, []), hosts := coalesce(names.h, [])) AS entities, entity_risk, n_detections FROM b JOIN ph USING (incident_id) JOIN pl USING (incident_id) LEFT JOIN tl USING (incident_id) LEFT JOIN names USING (incident_id) LEFT JOIN er2 USING (incident_id))
SELECT incident_id, NULL AS det_id, CASE WHEN entity_risk IS NULL THEN CAST(to_json(struct_pack(incident := incident_id, "start" := a, "end" := z, severity := severity, score := score, confidence := confidence, phases := phases, techniques := techniques, entities := entities, n_detections := n_detections)) AS VARCHAR)
  ELSE CAST(to_json(struct_pack(incident := incident_id, "start" := a, "end" := z, severity := severity, score := score, confidence := confidence, phases := phases, techniques := techniques, entities := entities, entity_risk := entity_risk, n_detections := n_detections)) AS VARCHAR) END AS body FROM hd
UNION ALL SELECT incident_id, det_id, CAST(to_json(struct_pack(rule_id := lower(trim(rule_id)), title := title, kind := kind, level := level, "start" := {_iso('start_ts')}, "end" := {_iso('coalesce(end_ts, start_ts)')}, actor := actor, host := host, source := source, attack := techniques, kill_chain := kill_chain, event_count := coalesce(len(event_rids), 0), risk := {RISK_SQL})) AS VARCHAR) FROM mem""")
def incident_json(spark: SparkSession, d: str) -> DataFrame:
    """Every incident, a row with a null det_id, and each of its detections."""
    rows = members(spark, d)
    head = documents.incident_bodies(documents.heads(rows)).select("incident_id", F.lit(None).cast("long").alias("det_id"), "body")
    return head.unionAll(documents.detection_bodies(rows).select("incident_id", "det_id", "body"))


@query()
def thehive_alerts(spark: SparkSession, d: str) -> DataFrame:
    return documents.thehive_bodies(documents.heads(members(spark, d)))


@query()
def misp_events(spark: SparkSession, d: str) -> DataFrame:
    return documents.misp_bodies(documents.heads(members(spark, d)))


@query()
def stix_objects(spark: SparkSession, d: str) -> DataFrame:
    head = Tables(spark, "heads").put(documents.heads(members(spark, d)))
    return documents.stix_objects(head, dt.datetime(2026, 1, 1))


@query()
def incident_markdown(spark: SparkSession, d: str) -> DataFrame:
    """The report of the ten incidents of highest score."""
    return spark.createDataFrame([(reports.markdown(reports.shown(members(spark, d), 10)),)], "body string")


@query(SUM_SQL + """, k2 AS (SELECT DISTINCT ent.kind, ent.norm, mem.incident_id, mem.det_id FROM ent JOIN mem USING (det_id) WHERE ent.norm <> '')
SELECT kind, norm, count(DISTINCT det_id) AS n_detections FROM k2 GROUP BY 1, 2""")
def entity_pages(spark: SparkSession, d: str) -> DataFrame:
    """A page an entity; of each here its entity and the detections it tells of."""
    pages = documents.entity_pages(members(spark, d))
    return pages.select("kind", "norm", F.regexp_extract("body", r": (\d+) detections in", 1).cast("long").alias("n_detections"))


@query("SELECT t AS technique, count(*) AS n FROM (SELECT unnest(techniques) AS t FROM detections) GROUP BY 1")
def navigator_layer(spark: SparkSession, d: str) -> DataFrame:
    """The technique layer, read back."""
    layer = documents.navigator_layer(tables_.table(spark, d, "detections"))
    return layer.select(F.inline(F.from_json(F.get_json_object("body", "$.techniques"), "array<struct<techniqueID:string,score:bigint>>"))).select(F.col("techniqueID").alias("technique"), F.col("score").alias("n"))


@query()
def rule_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every rule in every language that can say it."""
    rules = pack()
    registry = {r.id: r for r in rules}
    rows = [(r.id, language, text) for r in rules for language, text in transpile.texts(r, registry).items()]
    return spark.createDataFrame(rows, "rule_id string, language string, body string")


def _case_rows() -> str:
    return ", ".join(f"('{r.id}', '{kind}', {place}, {kind == 'match'}, true)".replace("True", "true").replace("False", "false") for r in pack() for kind in ("match", "nomatch") for place in range(1, len(r.tests.get(kind) or []) + 1))


@query(f"SELECT * FROM (VALUES {_case_rows()}) c(rule_id, kind, place, fired, passed)")
def rule_cases(spark: SparkSession, d: str) -> DataFrame:
    """The embedded cases of all rules; their SQL says what each case expects."""
    return validation.run_cases(spark, pack())


_FIRST = "coalesce(CASE WHEN {0} NOT IN ('', '-') THEN {0} END, '')"


@query(f"""SELECT DISTINCT h.rule_id, e._ingested AS start_ts, {_FIRST.format('e.Computer')} AS host FROM ({MULTI_SQL}) h JOIN sec_events e USING (_rid) WHERE h.rule_id <> 'll-0007'""")
def stream_replay(spark: SparkSession, d: str) -> DataFrame:
    """The stateless alerts of a stream over all events; equal to the batch answer."""
    tables = Tables(spark, "stream")
    stream = tables_.stream(spark, d, "sec_events").withColumn("TimeCreated", F.col("_ingested"))
    alerts = stream_alerts(stream, signatures(), "3650 days").select("rule_id", "start_ts", "host")
    alerts.writeStream.format("parquet").option("path", f"{tables.root}/out").option("checkpointLocation", f"{tables.root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(alerts.schema).parquet(f"{tables.root}/out").distinct()


@query(SUM_SQL + f""",
top AS (SELECT b.incident_id FROM b JOIN ph USING (incident_id) ORDER BY {_SCORE} DESC, start_ts, b.incident_id LIMIT 1),
g AS (SELECT lower(trim(rule_id)) AS rule_id, lower(CASE WHEN host IS NULL THEN '' WHEN regexp_full_match(host, '[0-9.]*') THEN host ELSE split_part(host, '.', 1) END) AS host_key, min_by(title, (start_ts, det_id)) AS title, min_by(level, (start_ts, det_id)) AS level, min(start_ts) AS first_at
  FROM mem WHERE incident_id IN (SELECT incident_id FROM top) GROUP BY 1, 2),
e AS (SELECT *, list_position(['informational', 'low', 'medium', 'high', 'critical'], level) AS lr FROM g QUALIFY level IN ('medium', 'high', 'critical') OR NOT bool_or(level IN ('medium', 'high', 'critical')) OVER ()),
shown AS (SELECT * FROM e ORDER BY -lr, first_at, rule_id, host_key LIMIT 40)
SELECT 'attack_narrative' AS section, title || ' on ' || coalesce(nullif(host_key, ''), 'n/a') AS text, true AS grounded FROM shown UNION ALL SELECT 'containment', 'Isolate ZZ-UNKNOWN-9', false FROM top""")
def grounding_check(spark: SparkSession, d: str) -> DataFrame:
    """A draft that says of each alert of the gravest incident where it was, and one statement too many."""

    def draft(_: str, evidence: str) -> dict:
        rows = [line.split(" | ") for line in evidence.splitlines()]
        said = [{"text": f"{r[4]} on {r[2].removeprefix('host=')}", "evidence": [r[0]]} for r in rows]
        return {"attack_narrative": said, "containment": [{"text": "Isolate ZZ-UNKNOWN-9", "evidence": ["E1"]}] if rows else []}

    rows = members(spark, d)
    top = I.summarize(rows).orderBy(F.desc("score"), "start_ts", "incident_id").limit(1).select("incident_id")
    own = Tables(spark, "grounding").put(rows.join(top, "incident_id", "left_semi"))
    verified, _ = grounding.analyse(I.alert_groups(own), I.entities(own), draft)
    return verified.select("section", "text", "grounded")


@query()
def hunt_incidents(spark: SparkSession, d: str) -> DataFrame:
    """The whole hunt over the delivered events, by their own times."""
    found = pipeline.hunt(Tables(spark, "timed").put(timed_events(spark, d)), pack())
    return found.incidents.select("incident_id", "n_detections", F.array_join("phases", " > ").alias("phases"), "score", "severity", "confidence")
