"""Queries of telemetry coverage, health, layout and run history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lanternlog.operators import coverage, hits
from lanternlog.plans.rulebook import rule_of
from lanternlog.plans.rules import MULTI_SQL, events, pack, signatures
from lanternlog.session import Tables
from lanternlog.sources import events as sources
from lanternlog.sources.normalize import decode
from lanternlog.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_COUNTED = "NOT coalesce((EventID <= 29 OR EventID = 255) AND coalesce(Channel, '') <> '' AND NOT contains(lower(Channel), 'sysmon'), false)"
_HOST, _CHANNEL = "upper(split_part(coalesce(Computer, ''), '.', 1))", "lower(coalesce(Channel, ''))"


@query(f"SELECT coalesce(CAST(EventID AS VARCHAR), '') AS event_id, count(*) AS n_events FROM sec_events WHERE {_COUNTED} GROUP BY 1")
def event_histogram(spark: SparkSession, d: str) -> DataFrame:
    return coverage.event_histogram(events(spark, d)).select(F.coalesce(F.col("EventID").cast("string"), F.lit("")).alias("event_id"), "n_events")


@query(f"SELECT {_HOST} AS host, {_CHANNEL} AS channel, count(*) AS n_events FROM sec_events GROUP BY ALL")
def host_channel_matrix(spark: SparkSession, d: str) -> DataFrame:
    return coverage.host_channels(events(spark, d))


_FIELDS = ["SubjectUserName", "TargetUserName", "User", "IpAddress", "WorkstationName", "Image", "CommandLine", "GrantedAccess", "Properties", "Status"]


@query(
    "WITH r AS (SELECT coalesce(CAST(EventID AS VARCHAR), '') AS event_id, * FROM sec_events WHERE " + _COUNTED + ") SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT event_id, '{f}' AS field, count(CASE WHEN \"{f}\" NOT IN ('', '-') THEN 1 END) AS n_filled FROM r GROUP BY 1" for f in _FIELDS)
    + " UNION ALL SELECT event_id, e.key AS field, count(*) AS n_filled FROM (SELECT event_id, unnest(map_entries(fields)) AS e FROM r) WHERE e.value IS NOT NULL AND e.value NOT IN ('', '-') GROUP BY 1, 2) WHERE n_filled > 0"
)
def field_presence(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("_rid", "EventID", "Channel", *_FIELDS, "fields")
    return coverage.field_presence(rows).where(F.col("field") != "EventID").where(F.col("field") != "Channel").select(F.coalesce(F.col("EventID").cast("string"), F.lit("")).alias("event_id"), "field", "n_filled")


@query("SELECT min(_ingested) AS first_at, max(_ingested) AS last_at, count(*) AS n_events FROM sec_events")
def time_bounds(spark: SparkSession, d: str) -> DataFrame:
    return coverage.time_bounds(events(spark, d))


@query(f"""
WITH p AS (SELECT DISTINCT {_HOST} AS host, {_CHANNEL} AS channel FROM sec_events), h AS (SELECT DISTINCT host FROM p WHERE host <> ''),
t AS (SELECT {_CHANNEL} AS channel, count(*) AS total FROM sec_events GROUP BY 1),
c AS (SELECT t.channel, count(*) AS n_have, (SELECT count(*) FROM h) AS n_hosts FROM t JOIN p ON p.channel = t.channel AND p.host <> '' WHERE total >= 20 GROUP BY 1)
SELECT h.host, c.channel, n_have, n_hosts FROM h, c WHERE n_hosts >= 3 AND n_have >= greatest(2, n_hosts * 0.5) AND NOT EXISTS (SELECT 1 FROM p WHERE p.host = h.host AND p.channel = c.channel)""")
def missing_source(spark: SparkSession, d: str) -> DataFrame:
    return coverage.missing_sources(events(spark, d))


@query(f"""
WITH s AS (SELECT min(epoch_us(_ingested)) AS a, max(epoch_us(_ingested)) AS b FROM sec_events),
e AS (SELECT {_HOST} AS host, {_CHANNEL} AS channel, least((epoch_us(_ingested) - a) * 24 // (b - a), 23) AS bucket FROM sec_events, s),
g AS (SELECT host, channel, count(*) AS n_events, count(DISTINCT bucket) AS k, max(bucket) AS last_bucket FROM e GROUP BY 1, 2)
SELECT host, channel, n_events, CAST(last_bucket AS INT) AS last_bucket FROM g WHERE n_events >= 20 AND k >= 3 AND last_bucket < 20 AND (SELECT max(bucket) FROM e) >= 20""")
def went_silent(spark: SparkSession, d: str) -> DataFrame:
    return coverage.went_silent(events(spark, d))


def _viability(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d)
    return Tables(spark, "viability").put(coverage.viability(spark, pack(), coverage.profile(rows)))


def _live_sql() -> str:
    has = lambda ids: f"EXISTS (SELECT 1 FROM sec_events WHERE EventID IN ({ids}) AND {_COUNTED})"
    fields = lambda ids, *fs: " OR ".join("(" + " AND ".join(f"EXISTS (SELECT 1 FROM sec_events WHERE EventID = {i} AND {_COUNTED} AND \"{f}\" NOT IN ('', '-'))" for f in fs) + ")" for i in ids)
    seen = lambda ids, channel, need: f"CASE WHEN NOT {has(ids)} THEN CASE WHEN EXISTS (SELECT 1 FROM sec_events WHERE lower(Channel) IN {channel}) THEN 'UNOBSERVED' ELSE 'DEAD_EVENTS' END WHEN {need} THEN 'LIVE' ELSE 'DEAD_FIELDS' END"
    sec, sysmon = "('security')", "('microsoft-windows-sysmon/operational')"
    rows = [
        ("ll-0001", seen("4769", sec, fields([4769], "TicketEncryptionType"))), ("ll-0002", seen("4624", sec, fields([4624], "LogonType", "AuthenticationPackageName"))), ("ll-0003", seen("4662", sec, fields([4662], "Properties"))),
        ("ll-0004", seen("10", sysmon, fields([10], "TargetImage", "GrantedAccess"))), ("ll-0005", seen("4728, 4732, 4756", sec, "true")), ("ll-0006", seen("104, 1102", "('security', 'system')", "true")),
        ("ll-0007", seen("1, 4688", "('security', 'microsoft-windows-sysmon/operational')", fields([1, 4688], "CommandLine"))), ("ll-0008", seen("4625", sec, "true")), ("ll-s001", "'LIVE'"), ("ll-s002", "'LIVE'"),
        *((r, f"CASE WHEN EXISTS (SELECT 1 FROM sec_events WHERE lower(Channel) = '{c}') THEN 'UNOBSERVED' ELSE 'DEAD_EVENTS' END") for r, c in (("ll-c001", "auditlogs"), ("ll-c002", "officeactivity"), ("ll-c003", "none such"))),
    ]
    return " UNION ALL ".join(f"SELECT '{r}' AS rule_id, {s} AS status" for r, s in rows)


@query(_live_sql())
def rule_viability(spark: SparkSession, d: str) -> DataFrame:
    return _viability(spark, d).select("rule_id", "status")


def _rules_sql() -> str:
    """The rules' tactics and techniques, as values."""
    rows = ", ".join(f"('{r.id}', '{r.level}', '{r.meta.get('kill_chain', 'Unmapped')}', {r.techniques or 'CAST([] AS VARCHAR[])'})" for r in pack())
    return f"r AS (SELECT * FROM (VALUES {rows}) x(rule_id, level, tactic, techniques)), v AS ({_live_sql()}), t AS (SELECT r.rule_id, tactic, status, unnest(techniques) AS technique FROM r JOIN v USING (rule_id))"


@query(f"WITH {_rules_sql()} SELECT tactic, technique, CASE min(CASE status WHEN 'LIVE' THEN 0 WHEN 'UNOBSERVED' THEN 1 ELSE 2 END) WHEN 0 THEN 'live' WHEN 1 THEN 'unverified' ELSE 'blind' END AS kind FROM t GROUP BY 1, 2")
def coverage_sets(spark: SparkSession, d: str) -> DataFrame:
    """Tactic by tactic, techniques that live rules have, that only unverified ones have, and that none has."""
    return coverage.coverage_sets(_viability(spark, d))


#: Rules that the test events can't serve: a service that never arrives, an id that no channel brings, a field that no event fills.
_UNSERVED = [
    ("x-dns", ["attack.t1071"], {"EventID": 541}, "dns-server"), ("x-task", ["attack.t1053", "attack.t1078"], {"EventID": 7001, "TaskName": "x"}, ""), ("x-task2", ["attack.t1053"], {"EventID": [7001, 7002]}, ""),
    ("x-parent", ["attack.t1059"], {"EventID": 4688, "ParentProcessName": "x"}, ""), ("x-rare", ["attack.t1110"], {"EventID": 1108}, ""), ("x-live", ["attack.t1078"], {"EventID": 4624}, ""),
]


def _none(cond: str) -> str:
    return f"NOT EXISTS (SELECT 1 FROM sec_events WHERE {_COUNTED} AND {cond})"


_NO_DNS = _none("lower(Channel) = 'dns server'")
_TODO = f"""
WITH a AS (
  SELECT 'Collect the channel of service dns-server' AS action, 'x-dns' AS rule_id, ['T1071'] AS ts, false AS later WHERE {_NO_DNS}
  UNION ALL SELECT 'Collect EventID 7001', 'x-task', ['T1053', 'T1078'], false WHERE {_none('EventID = 7001')}
  UNION ALL SELECT 'Collect EventID ' || i, 'x-task2', ['T1053'], false FROM (VALUES (7001), (7002)) v(i) WHERE {_none('EventID IN (7001, 7002)')}
  UNION ALL SELECT 'Collect from Windows 10 / Server 2016 or later, or use Sysmon 1', 'x-parent', ['T1059'], false WHERE {_none("EventID = 4688 AND list_contains(map_keys(fields), 'ParentProcessName')")}
  UNION ALL SELECT 'Verify that security 1108 is audited', 'x-rare', ['T1110'], true WHERE {_none('EventID = 1108')}),
live AS (SELECT 'T1078' AS t WHERE EXISTS (SELECT 1 FROM sec_events WHERE EventID = 4624)),
n AS (SELECT later, action, list_sort(list_distinct(list(t))) AS ts FROM (SELECT later, action, unnest(ts) AS t FROM a) WHERE t NOT IN (SELECT t FROM live) GROUP BY 1, 2),
g AS (SELECT later, action, list_sort(list_distinct(list(rule_id))) AS rules FROM a GROUP BY 1, 2)
SELECT row_number() OVER (PARTITION BY later ORDER BY len(coalesce(ts, [])) DESC, len(rules) DESC, action) AS place, action, rules, coalesce(ts, []) AS techniques, later FROM g LEFT JOIN n USING (later, action)"""


@query(_TODO)
def recommendations(spark: SparkSession, d: str) -> DataFrame:
    """What to turn on for rules that the events can't serve, most gain first; then what to verify."""
    rules = [rule_of({"id": i, "tags": tags, "detection": {"s": s, "condition": "s"}, "logsource": {"service": service} if service else {}}) for i, tags, s, service in _UNSERVED]
    found = Tables(spark, "unserved").put(coverage.viability(spark, rules, coverage.profile(events(spark, d))))
    parts = [coverage.recommendations(found, later).withColumn("later", F.lit(later)) for later in (False, True)]
    return parts[0].unionAll(parts[1])


@query(f"WITH {_rules_sql()} SELECT technique, ['DEAD_FIELDS', 'DEAD_EVENTS', 'UNOBSERVED', 'LIVE'][max(list_position(['DEAD_FIELDS', 'DEAD_EVENTS', 'UNOBSERVED', 'LIVE'], status))] AS status FROM t GROUP BY 1")
def technique_status(spark: SparkSession, d: str) -> DataFrame:
    return coverage.technique_status(_viability(spark, d))


#: Hits on recordings, as a benchmark gives them.
_BENCH = [("ll-0005", 2), ("ll-0006", 1), ("ll-0007", 3)]
_HEALTH = f"""
WITH h AS ({MULTI_SQL}), n AS (SELECT count(*) AS n FROM sec_events), {_rules_sql()},
c AS (SELECT rule_id, count(*) AS alerts, count(DISTINCT CASE WHEN regexp_full_match(c, '[0-9.]*') THEN c ELSE split_part(c, '.', 1) END) AS hosts FROM (SELECT h.rule_id, CASE WHEN e.Computer IN ('', '-') OR e.Computer IS NULL THEN '' ELSE e.Computer END AS c FROM h JOIN sec_events e USING (_rid)) GROUP BY 1),
k AS (SELECT * FROM (VALUES {", ".join(map(str, _BENCH))}) b(rule_id, bench_hits)),
x AS (SELECT rule_id, level, status FROM r JOIN v USING (rule_id) WHERE rule_id IN ('ll-0002', 'll-0003', 'll-0004', 'll-0005', 'll-0006', 'll-0007') UNION ALL VALUES ('x-dns', 'medium', 'DEAD_EVENTS'))
SELECT x.rule_id, coalesce(alerts, 0) AS alerts, coalesce(hosts, 0) AS hosts, round(coalesce(alerts, 0) / n * 1e6, 3) AS per_million, coalesce(bench_hits, 0) AS bench_hits,
       CASE WHEN status LIKE 'DEAD%' THEN 'DEAD' WHEN coalesce(alerts, 0) / n * 1e6 >= 500 AND level IN ('medium', 'high', 'critical') THEN 'TUNE' WHEN bench_hits > 0 THEN 'TRUST' ELSE 'UNPROVEN' END AS verdict
FROM x CROSS JOIN n LEFT JOIN c ON x.rule_id = c.rule_id LEFT JOIN k ON x.rule_id = k.rule_id"""


@query(_HEALTH)
def rule_health(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of stateless rules and of one that can't fire, with hits on recordings."""
    rows, rules = events(spark, d), [r for r in signatures() if not r.threshold and not r.id.startswith("ll-c")]
    dns = rule_of({"id": "x-dns", "detection": {"s": {"EventID": 541}, "condition": "s"}, "logsource": {"service": "dns-server"}})
    seen = coverage.profile(rows)
    found = hits.detections(rows, rules)
    bench = spark.createDataFrame(_BENCH, "rule_id string, bench_hits long")
    out = coverage.rule_health(found, coverage.viability(spark, [*rules, dns], seen), seen.n_events, bench)
    return out.select("rule_id", "alerts", "hosts", F.round("per_million", 3).alias("per_million"), "bench_hits", "verdict")


_RUN = "SELECT DISTINCT recording AS sample, lower(trim(rule_id)) AS rule_id FROM detections WHERE det_id % 3 {} 0"


@query(f"""
WITH b AS ({_RUN.format('<>')}), n AS ({_RUN.format('=')})
SELECT 'regression' AS change, sample, rule_id FROM b WHERE sample IN (SELECT sample FROM n) AND (sample, rule_id) NOT IN (SELECT (sample, rule_id) FROM n)
UNION ALL SELECT 'new', sample, rule_id FROM n WHERE (sample, rule_id) NOT IN (SELECT (sample, rule_id) FROM b)""")
def run_diff(spark: SparkSession, d: str) -> DataFrame:
    """Two runs compared: every detection is in one of them."""
    rows = table(spark, d, "detections").select("det_id", F.col("recording").alias("sample"), F.lower(F.trim("rule_id")).alias("rule_id"))
    return coverage.run_diff(rows.where("det_id % 3 <> 0"), rows.where("det_id % 3 = 0"))


@query("SELECT 'sec' AS src, _rid AS id, EventID AS event_id, NULL AS operation FROM sec_events WHERE EventID IS NOT NULL UNION ALL SELECT 'cloud', record_id, 0, OperationName FROM cloud_records")
def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Parts with different columns as one table."""
    a = table(spark, d, "sec_events").where("EventID is not null").select(F.lit("sec").alias("src"), F.col("_rid").alias("id"), F.col("EventID").alias("event_id"))
    b = table(spark, d, "cloud_records").select(F.lit("cloud").alias("src"), F.col("record_id").alias("id"), F.lit(0).alias("event_id"), F.col("OperationName").alias("operation"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT EventID AS event_id, count(*) AS n, min(_rid) AS least FROM sec_events WHERE EventID IN (4624, 4769) GROUP BY 1")
def lake_layout(spark: SparkSession, d: str) -> DataFrame:
    """Written to the lake's layout, read back through its statistics."""
    root = Tables(spark, "lake").root
    sources.write_lake(events(spark, d), root)
    lake = sources.read_lake(spark, root)
    return sources.of_event_ids(lake, [4624, 4769], ["EventID"]).groupBy(F.col("EventID").alias("event_id")).agg(F.count(F.lit(1)).alias("n"), F.min("_rid").alias("least"))


@query("SELECT _rid, _ingested AS \"TimeCreated\", Computer FROM sec_events WHERE EventID = 1102 ORDER BY _ingested, _rid LIMIT 5")
def events_query(spark: SparkSession, d: str) -> DataFrame:
    """A projection by predicate in time order; the limit is the feature."""
    return sources.query(events(spark, d), F.col("EventID") == 1102, 5, ["computer"])


def _text(column: str) -> str:
    return f"nullif(regexp_replace({column}, '^\\s+|\\s+$', '', 'g'), '')"


_MISREAD = "'â€|Ã|Â'"
_PLAIN = "trim(regexp_replace(regexp_replace({0}, '[\\x{{2010}}-\\x{{2015}}\\x{{2212}}]', '-', 'g'), '\\s+', ' ', 'g'))"


@query(f"""
WITH c AS (SELECT record_id, CASE WHEN lower("Type") IN ('auditlogs', 'signinlogs', 'aadnoninteractiveusersigninlogs', 'aaduserriskevents', 'azureactivity', 'officeactivity', 'securityalert') THEN lower("Type") WHEN "Timestamp" IS NOT NULL AND ActionType IS NOT NULL THEN 'm365d' END AS t,
  {_text('DeviceName')} AS device, {_text('OfficeWorkload')} AS workload, lower({_text('ActionType')}) AS action, regexp_replace({_text('IPAddress')}, '^::ffff:', '', 'i') AS ip, coalesce({_text('ActivityDisplayName')}, {_text('OperationName')}, {_text('"Operation"')}) AS said,
  coalesce({_text('UserPrincipalName')}, {_text('UserId')}, {_text('AccountUpn')}, CASE WHEN json_valid(InitiatedBy) THEN {_text("json_extract_string(InitiatedBy, '$.user.userPrincipalName')")} END) AS who FROM cloud_records)
SELECT record_id, CASE WHEN t IS NOT NULL THEN 0 END AS event_id, CASE WHEN t = 'm365d' THEN 'm365d/' || coalesce(action, '') ELSE t END AS channel,
  CASE WHEN t = 'm365d' THEN coalesce(device, 'Microsoft 365 Defender') WHEN t IN ('auditlogs', 'signinlogs', 'aadnoninteractiveusersigninlogs') THEN 'Entra ID' WHEN t = 'aaduserriskevents' THEN 'Entra ID Protection' WHEN t = 'azureactivity' THEN 'Azure Resource Manager'
       WHEN t = 'securityalert' THEN 'Security alerts' WHEN t = 'officeactivity' THEN coalesce(workload, 'Microsoft 365') || ' Online' END AS computer,
  CASE WHEN t = 'm365d' THEN 'm365d' WHEN t IN ('officeactivity', 'securityalert') THEN 'm365' WHEN t IS NOT NULL THEN 'azure' END AS platform, CASE WHEN t IS NOT NULL AND NOT regexp_matches(who, {_MISREAD}) THEN who END AS who,
  CASE WHEN t IS NOT NULL AND length(ip) - length(replace(ip, ':', '')) = 1 THEN split_part(ip, ':', 1) ELSE ip END AS ip, CASE WHEN t IS NOT NULL AND NOT regexp_matches(said, {_MISREAD}) THEN {_PLAIN.format('said')} END AS message FROM c""")
def cloud_events(spark: SparkSession, d: str) -> DataFrame:
    """Cloud audit records in the event shape, those without a usable time too; texts with the marks of a wrong encoding, which SQL can't repair, as null."""
    rows = table(spark, d, "cloud_records").drop("collector", "_ingested")
    out = decode(rows.select("record_id", F.to_json(F.struct("*")).alias("value")), keep=("record_id",))
    said = F.when(F.col("_platform").isNotNull(), F.coalesce(F.col("fields")["properties.message"], F.lit(None)))
    raw = table(spark, d, "cloud_records").select(F.col("record_id").alias("_id"), *[F.coalesce(F.array_join(F.array(*names), " "), F.lit("")).rlike("â€|Ã|Â").alias(f"_bad{i}") for i, names in enumerate((["UserPrincipalName", "UserId", "AccountUpn", "InitiatedBy"], ["ActivityDisplayName", "OperationName", "Operation"]))])
    rows = out.join(raw, F.col("record_id") == F.col("_id"))
    clean = lambda flag, column: F.when(~F.col(flag), column)
    return rows.select("record_id", F.col("EventID").alias("event_id"), F.col("Channel").alias("channel"), F.col("Computer").alias("computer"), F.col("_platform").alias("platform"), clean("_bad0", F.when(F.col("_platform").isNotNull(), F.col("User"))).alias("who"), F.col("IpAddress").alias("ip"), clean("_bad1", said).alias("message"))


@query("SELECT raw_id, true AS is_object FROM raw_records WHERE json_valid(ltrim(payload, chr(65279))) AND json_type(ltrim(payload, chr(65279))) = 'OBJECT'")
def raw_events(spark: SparkSession, d: str) -> DataFrame:
    """Raw export lines in the event shape: of each that is a JSON object, that it is one."""
    rows = table(spark, d, "raw_records").select("raw_id", F.col("payload").alias("value"))
    return decode(rows, keep=("raw_id",)).where("problem is null or problem <> 'no JSON object'").select("raw_id", F.lit(True).alias("is_object"))


def _cloud(spark: SparkSession, d: str) -> DataFrame:
    """Cloud records as events, by their ids."""
    rows = table(spark, d, "cloud_records").drop("collector", "_ingested")
    out = decode(rows.select(F.col("record_id").alias("_rid"), F.to_json(F.struct("*")).alias("value")), keep=("_rid",))
    return out.where("problem is null or problem = 'no time'").drop("line", "problem")


_CLOUD = f"""c AS (SELECT record_id, CASE WHEN lower("Type") IN ('auditlogs', 'signinlogs', 'aadnoninteractiveusersigninlogs', 'aaduserriskevents', 'azureactivity', 'officeactivity', 'securityalert') THEN lower("Type") WHEN "Timestamp" IS NOT NULL AND ActionType IS NOT NULL THEN 'm365d' END AS t,
  lower(coalesce({_text('ActivityDisplayName')}, {_text('OperationName')}, {_text('"Operation"')})) AS said, lower({_text('"Operation"')}) AS op, lower({_text('ActionType')}) AS act, lower({_text('Result')}) AS res FROM cloud_records)"""


@query(f"""WITH {_CLOUD} SELECT 'll-c001' AS rule_id, record_id FROM c WHERE t = 'auditlogs' AND starts_with(said, 'update application') AND contains(said, 'secrets') AND res IS DISTINCT FROM 'failure'
UNION ALL SELECT 'll-c002', record_id FROM c WHERE t = 'officeactivity' AND (contains(op, 'sortrule') OR contains(op, 'inboxrule')) UNION ALL SELECT 'll-c003', record_id FROM c WHERE t IN ('officeactivity', 'securityalert', 'm365d') AND act IN ('ldapread', 'replica pull requested')""")
def cloud_rule_hits(spark: SparkSession, d: str) -> DataFrame:
    """The pack's cloud rules over all cloud records."""
    rules = [r for r in pack() if r.id.startswith("ll-c")]
    found = hits.rule_hits(_cloud(spark, d), rules)
    return found.join(hits.rule_table(spark, rules).select("rule_no", "rule_id"), "rule_no").select("rule_id", F.col("_rid").alias("record_id"))


@query(f"WITH {_CLOUD} SELECT record_id FROM c WHERE t IN ('officeactivity', 'securityalert', 'm365d') AND contains(act, 'mail') OR t = 'officeactivity' AND contains(op, 'mail')")
def logsource_m365(spark: SparkSession, d: str) -> DataFrame:
    """A rule of one cloud product, over all cloud records."""
    rule = rule_of({"id": "q", "detection": {"a": {"ActionType|contains": "mail"}, "b": {"Operation|contains": "mail"}, "condition": "a or b"}, "logsource": {"product": "m365"}})
    return hits.rule_hits(_cloud(spark, d), [rule]).select(F.col("_rid").alias("record_id"))
