"""Queries of rule matching: predicates, conditions, gates, normalisers, bursts, sequences, anomalies."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from lanternlog.functions import entities as E
from lanternlog.functions.match import compile_rule, fold_columns
from lanternlog.operators import anomalies, bursts, hits, sequences, timeline
from lanternlog.plans.rulebook import Rule, load_rules, rule_of
from lanternlog.sources.tables import table

PACK = Path(__file__).resolve().parents[2] / "rules"
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, d: str) -> DataFrame:
    """Delivered events by the time of their delivery, which is never missing or doubtful."""
    return table(spark, d, "sec_events").withColumn("TimeCreated", F.col("_ingested"))


def timed_events(spark: SparkSession, d: str) -> DataFrame:
    """Events by their own time, brought to one form from all its makes; those without a time that names an instant are left out."""
    rows = table(spark, d, "sec_events").drop("TimeCreated")
    sources = table(spark, d, "collectors").select(F.col("collector").alias("source"), "tz", "date_order")
    at = timeline.resolve(timeline.long_values(table(spark, d, "sec_events"), "sec_events", "_rid", ["TimeCreated"], "collector"), sources)
    return rows.join(at.select(F.col("row_id").alias("_rid"), F.timestamp_micros("utc_us").alias("TimeCreated")), "_rid")


def pack() -> list[Rule]:
    return load_rules(PACK)[0]


def signatures() -> list[Rule]:
    return [r for r in pack() if r.kind == "signature"]


def _matching(spark: SparkSession, d: str, detection: dict, logsource: dict | None = None) -> DataFrame:
    rule = rule_of({"id": "q", "detection": detection, "logsource": logsource or {}})
    rows, event = fold_columns(hits.narrowed(events(spark, d), [rule]), [rule])
    return rows.where(compile_rule(rule, event)).select("_rid")


def _predicate(name: str, detection: dict, sql_where: str, logsource: dict | None = None) -> None:
    """A query of the events that one small rule matches."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return _matching(spark, d, detection, logsource)

    run.__name__ = name
    query(f"SELECT _rid FROM sec_events WHERE {sql_where}")(run)


def _one(selection: object, condition: str = "s") -> dict:
    return {"s": selection, "condition": condition}


_KEYWORDS = ["*drop*", "tessel", "a1c0de00"]
_LIST = [f"WS-{n:04d}" for n in range(100, 180)]
_predicate("pred_equal", _one({"AuthenticationPackageName": "kerberos", "EventID": [4624, 4625]}), "lower(AuthenticationPackageName) = 'kerberos' AND EventID IN (4624, 4625)")
_predicate("pred_contains_all", _one({"CommandLine|contains|all": ["/C COPY", "\\drop\\"]}), "contains(lower(CommandLine), '/c copy') AND contains(lower(CommandLine), '\\drop\\')")
_predicate("pred_startswith", _one({"Image|startswith": "c:\\windows\\"}), "starts_with(lower(Image), 'c:\\windows\\')")
_predicate("pred_endswith", _one({"Image|endswith": ["\\SVCHOST.exe", "\\cmd.exe"]}), "lower(Image) LIKE '%\\svchost.exe' OR lower(Image) LIKE '%\\cmd.exe'")
_predicate("pred_contains_literal", _one({"CommandLine|contains": "_"}), "contains(CommandLine, '_')")
_predicate("pred_glob", _one({"Image": "*\\system32\\*host?.exe"}), "regexp_full_match(lower(Image), '.*\\\\system32\\\\.*host.\\.exe', 's')")
_predicate("pred_glob_class", _one({"Computer": "srv0[0-3]?.*"}), "regexp_full_match(lower(Computer), 'srv0[0-3].\\..*', 's')")
_predicate("pred_regex", _one({"CommandLine|re": "-[tT] [0-9]{3,4}$"}), "regexp_matches(CommandLine, '-[tT] [0-9]{3,4}$')")
_predicate("pred_windash", _one({"CommandLine|windash|contains": " -c "}), "contains(lower(CommandLine), ' -c ') OR contains(lower(CommandLine), ' /c ')")
_predicate("pred_null_dash", _one({"IpAddress": None, "EventID": 4624}), "(IpAddress IS NULL OR IpAddress IN ('', '-')) AND EventID = 4624")
_predicate("pred_ioc_list", _one({"WorkstationName": _LIST}), "lower(WorkstationName) IN (" + ", ".join(f"'{w.lower()}'" for w in _LIST) + ")")
_predicate("pred_ioc_contains", _one({"CommandLine|contains": [f"unit{n}" for n in range(10, 40)]}), " OR ".join(f"contains(lower(CommandLine), 'unit{n}')" for n in range(10, 40)))
_OCTETS = "regexp_full_match(ip, '(\\d{1,3}\\.){3}\\d{1,3}') AND TRY_CAST(split_part(ip, '.', 1) AS INT) * 16777216 + TRY_CAST(split_part(ip, '.', 2) AS INT) * 65536 + TRY_CAST(split_part(ip, '.', 3) AS INT) * 256 + TRY_CAST(split_part(ip, '.', 4) AS INT)"
_predicate("pred_cidr", _one({"IpAddress|cidr": ["10.0.32.0/20", "10.4.0.0/16"]}), f"_rid IN (SELECT _rid FROM (SELECT _rid, regexp_replace(IpAddress, '^::ffff:', '') AS ip FROM sec_events) WHERE {_OCTETS} BETWEEN 167780352 AND 167784447 OR {_OCTETS} BETWEEN 168034304 AND 168099839)")
_predicate("pred_list_of_maps", _one([{"EventID": 4624, "LogonType": "10"}, {"EventID": 4625, "Status|startswith": "0xc"}]), "(EventID = 4624 AND LogonType = '10') OR (EventID = 4625 AND starts_with(lower(Status), '0xc'))")
_predicate(
    "cond_quantifiers",
    {"sel_a": {"EventID": 4688}, "sel_b": {"CommandLine|contains": "copy"}, "filter_x": {"Computer|startswith": "srv"}, "filter_y": {"CommandLine|contains": "notes"}, "condition": "(all of sel_*) and not (1 of filter_* or not 1 of them)"},
    "EventID = 4688 AND contains(lower(CommandLine), 'copy') AND NOT coalesce(starts_with(lower(Computer), 'srv'), false) AND NOT contains(lower(CommandLine), 'notes')",
)
_predicate("cond_precedence", {"a": {"EventID": 4624}, "b": {"EventID": 4625}, "c": {"LogonType": "3"}, "condition": "a or b and not c"}, "EventID = 4624 OR (EventID = 4625 AND NOT coalesce(LogonType = '3', false))")
_predicate("cond_empty_quantifier", {"a": {"EventID": 1102}, "condition": "a and all of none_*"}, "EventID = 1102")
_predicate("logsource_gate", _one({"Computer|contains": "0"}), "EventID IN (1, 4688) AND contains(Computer, '0') AND NOT (EventID = 1 AND coalesce(Channel, '') <> '' AND NOT contains(lower(Channel), 'sysmon')) AND (_platform IS NULL OR _platform IN ('', 'windows'))", {"product": "windows", "category": "process_creation"})
_predicate("logsource_service", _one({"EventID": [4624, 1102, 104]}), "EventID IN (4624, 1102, 104) AND (Channel IS NULL OR lower(Channel) IN ('', 'security'))", {"service": "security"})
_predicate("logsource_cloud", _one({"EventID|contains": "4"}), "contains(CAST(EventID AS VARCHAR), '4') AND (_platform IS NULL OR _platform = 'azure')", {"product": "azure"})


@query("""
SELECT _rid FROM (SELECT _rid, lower(concat_ws(' ', CommandLine, Image, Properties, array_to_string(list_transform(list_sort(map_entries(fields)), lambda e: e.value), ' '))) AS b FROM sec_events)
WHERE contains(b, 'drop') OR contains(b, 'tessel') OR contains(b, 'a1c0de00')""")
def pred_keyword_blob(spark: SparkSession, d: str) -> DataFrame:
    """Keywords over the values of some columns and the map."""
    rule = rule_of({"id": "q", "detection": _one(_KEYWORDS)})
    rows, event = fold_columns(events(spark, d).select("_rid", "CommandLine", "Image", "Properties", "fields"), [rule])
    return rows.where(compile_rule(rule, event)).select("_rid")


_HITS = {
    "ll-0002": "EventID = 4624 AND starts_with(lower(LogonType), '3') AND lower(AuthenticationPackageName) = 'ntlm' AND WorkstationName IS NOT NULL AND WorkstationName NOT IN ('', '-') AND sec",
    "ll-0003": "EventID = 4662 AND (contains(lower(Properties), 'a1c0de00-0000-4000') OR contains(lower(Properties), '1131f6ad-9c07-11d1')) AND NOT coalesce(ends_with(SubjectUserName, '$'), false) AND sec",
    "ll-0004": "EventID = 10 AND ends_with(lower(TargetImage), '\\lsass.exe') AND lower(GrantedAccess) IN ('0x1410', '0x1438', '0x1fffff', '0x00001410') AND NOT coalesce(ends_with(lower(SourceImage), '\\svchost.exe') OR ends_with(lower(SourceImage), '\\services.exe'), false) AND NOT coalesce(contains(lower(SourceImage), '\\tessel agent\\') OR ends_with(lower(SourceImage), '\\flocke-client.exe'), false) AND sysmon",
    "ll-0005": "EventID IN (4728, 4732, 4756) AND sec",
    "ll-0006": "(EventID = 1102 OR (EventID = 104 AND lower(Channel) = 'system'))",
    "ll-0007": "EventID IN (1, 4688) AND contains(lower(CommandLine), '/c copy') AND contains(lower(CommandLine), '\\drop\\') AND sysmon",
}
_GATED = "SELECT *, (Channel IS NULL OR lower(Channel) IN ('', 'security')) AS sec, NOT (EventID <= 29 AND coalesce(Channel, '') <> '' AND NOT contains(lower(Channel), 'sysmon')) AS sysmon FROM sec_events"
MULTI_SQL = f"WITH g AS ({_GATED}) " + " UNION ALL ".join(f"SELECT '{r}' AS rule_id, _rid FROM g WHERE {w}" for r, w in _HITS.items())


@query(MULTI_SQL)
def multi_rule_hits(spark: SparkSession, d: str) -> DataFrame:
    """All stateless rules of the pack in one scan."""
    rules = [r for r in signatures() if not r.threshold]
    found = hits.rule_hits(events(spark, d), rules)
    return found.join(F.broadcast(hits.rule_table(spark, rules).select("rule_no", "rule_id")), "rule_no").select("rule_id", "_rid")


def _first(*names: str) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN {n} NOT IN ('', '-') THEN {n} END" for n in names) + ", '')"


@query(f"WITH g AS ({_GATED}) SELECT _rid, {_first('TargetUserName')} AS actor, {_first('Computer')} AS host, {_first('IpAddress', 'WorkstationName')} AS source FROM g WHERE {_HITS['ll-0002']}")
def sig_filter(spark: SparkSession, d: str) -> DataFrame:
    """One rule end to end: detections with their entities."""
    found = hits.detections(events(spark, d), [r for r in signatures() if r.id == "ll-0002"])
    return found.select(F.element_at("event_rids", 1).alias("_rid"), "actor", "host", "source")


# ---- normalisers ----

_TRIM = "regexp_replace({0}, '^[ \\t\\n\\x0b\\f\\r]+|[ \\t\\n\\x0b\\f\\r]+$', '', 'g')"


_HEX_FIELDS = " UNION ALL ".join(f"SELECT _rid, '{f}' AS field, {_TRIM.format(f)} AS s FROM sec_events" for f in ("GrantedAccess", "TicketEncryptionType", "Status"))


@query(f"SELECT _rid, field, CASE WHEN regexp_full_match(s, '0x[0-9a-f]+', 'i') THEN '0x' || CASE WHEN ltrim(lower(s[3:]), '0') = '' THEN '0' ELSE ltrim(lower(s[3:]), '0') END ELSE s END AS hex FROM ({_HEX_FIELDS}) WHERE s IS NOT NULL")
def norm_hex(spark: SparkSession, d: str) -> DataFrame:
    """A row a field: every value of the hex fields."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("GrantedAccess", "TicketEncryptionType", "Status")])
    return table(spark, d, "sec_events").select("_rid", F.inline(fields)).where("value is not null").select("_rid", "field", E.canon_hex(F.col("value")).alias("hex"))


@query("SELECT _rid, regexp_replace(IpAddress, '^::ffff:', '', 'i') AS ip FROM sec_events WHERE IpAddress IS NOT NULL")
def norm_ip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sec_events").where("IpAddress is not null").select("_rid", E.unmapped_ip(F.col("IpAddress")).alias("ip"))


_IP = "(regexp_full_match({0}, '((25[0-5]|2[0-4]\\d|1?\\d?\\d)\\.){{3}}(25[0-5]|2[0-4]\\d|1?\\d?\\d)') OR (contains({0}, ':') AND length({0}) - length(replace({0}, ':', '')) >= 2 AND regexp_full_match({0}, '[0-9A-Fa-f:]{{2,39}}')))"


def _norm(value: str, host: bool) -> str:
    low = f"lower({_TRIM.format(value)})"
    name = f"split_part(list_extract(string_split({low}, '\\'), -1), '@', 1)"
    short = f"CASE WHEN {_IP.format(name)} THEN {name} ELSE split_part({name}, '.', 1) END" if host else name
    return f"CASE WHEN starts_with({low}, 'cn=') THEN {low} ELSE {short} END"


@query(f"SELECT det_id, {_norm('actor', False)} AS actor, {_norm('host', True)} AS host, {_norm('source', False)} AS source FROM detections")
def norm_entity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "detections").select("det_id", E.entity(F.col("actor")).alias("actor"), E.entity(F.col("host"), True).alias("host"), E.entity(F.col("source")).alias("source"))


@query("SELECT record_id, trim(regexp_replace(regexp_replace(ActivityDisplayName, '[\\x{2010}-\\x{2015}\\x{2212}]', '-', 'g'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), ' ') AS name FROM cloud_records WHERE ActivityDisplayName IS NOT NULL")
def norm_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cloud_records").where("ActivityDisplayName is not null").select("record_id", E.plain_text(F.col("ActivityDisplayName")).alias("name"))


@query("SELECT record_id, CASE WHEN length(IPAddress) - length(replace(IPAddress, ':', '')) = 1 THEN split_part(IPAddress, ':', 1) ELSE IPAddress END AS ip FROM cloud_records WHERE IPAddress IS NOT NULL")
def port_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cloud_records").where("IPAddress is not null").select("record_id", E.without_port(F.col("IPAddress")).alias("ip"))


@query(f"SELECT _rid, {_first('SubjectUserName', 'TargetUserName', 'User')} AS actor, {_first('IpAddress', 'WorkstationName')} AS source FROM sec_events")
def pick_first(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda names: E.pick([F.col(n) for n in names])
    return table(spark, d, "sec_events").select("_rid", pick(["SubjectUserName", "TargetUserName", "User"]).alias("actor"), pick(["IpAddress", "WorkstationName"]).alias("source"))


@query("SELECT det_id, CASE WHEN regexp_full_match(host, '[0-9.]*') THEN host ELSE split_part(host, '.', 1) END AS host FROM detections WHERE host IS NOT NULL")
def short_host(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "detections").where("host is not null").select("det_id", E.short_host(F.col("host")).alias("host"))


@query(f"SELECT det_id, CASE WHEN {_IP.format('source')} THEN 'IP Address' WHEN contains(source, '\\') OR ends_with(lower(source), '.exe') THEN 'Process' WHEN starts_with(upper(source), 'CN=') THEN 'Directory Object' ELSE 'Workstation/Domain' END AS kind FROM detections WHERE source IS NOT NULL")
def ioc_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "detections").where("source is not null").select("det_id", E.indicator_kind(F.col("source")).alias("kind"))


@query(f"""
SELECT _rid, list_aggregate(list_sort(list_distinct(list_filter([a, b], lambda x: x IS NOT NULL))), 'string_agg', ',') AS domains FROM (
  SELECT _rid, CASE WHEN len(string_split(h, '.')) >= 3 AND NOT regexp_full_match(h, '[0-9.]+') THEN h[strpos(h, '.') + 1:] END AS a, nullif(regexp_extract(u, '@(.+)$', 1), '') AS b
  FROM (SELECT _rid, lower({_TRIM.format('Computer')}) AS h, lower({_TRIM.format('"User"')}) AS u FROM sec_events)) WHERE a IS NOT NULL OR b IS NOT NULL""")
def domain_values(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "sec_events").select("_rid", E.domains(F.col("Computer"), [F.col("User")]).alias("x"))
    return rows.where(F.size("x") > 0).select("_rid", F.array_join("x", ",").alias("domains"))


# ---- bursts ----


def _walk(hits_sql: str, window_us: int, enough: str) -> str:
    return f"""
WITH RECURSIVE h AS ({hits_sql}),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY us, _rid) AS i FROM h),
w AS (SELECT a.k, a.i, a.us, a._rid, count(*) AS c, {enough} AS ok FROM n a JOIN n b ON a.k = b.k AND b.i >= a.i AND b.us - a.us <= {window_us} GROUP BY a.k, a.i, a.us, a._rid),
s AS (SELECT k, i, CASE WHEN ok THEN i + c ELSE i + 1 END AS nxt, ok, c, us, _rid FROM w),
walk AS (SELECT * FROM s WHERE i = 1 UNION ALL SELECT s.* FROM walk JOIN s ON s.k = walk.k AND s.i = walk.nxt)
SELECT k AS burst_key, _rid AS first_rid, c AS n_events FROM walk WHERE ok"""


def _bursts(spark: SparkSession, d: str, detection: dict, threshold: dict) -> DataFrame:
    rules = [rule_of({"id": "q", "detection": detection, "settings": {"threshold": threshold}})]
    found = hits.rule_hits(events(spark, d), rules)
    out = bursts.bursts(found, [(0, threshold["count"], threshold["within_seconds"] * 1_000_000, bool(threshold.get("distinct")))], chunk=64)
    keys = found.select(F.col("_rid").alias("first_rid"), "burst_key")
    return out.select(F.element_at("event_rids", 1).alias("first_rid"), F.size("event_rids").cast("long").alias("n_events")).join(keys, "first_rid")


@query(_walk("SELECT coalesce(Computer, '') AS k, epoch_us(_ingested) AS us, _rid FROM sec_events WHERE EventID = 4769 AND lower(TicketEncryptionType) = '0x17'", 43_200_000_000, "count(*) >= 3"))
def threshold_burst(spark: SparkSession, d: str) -> DataFrame:
    return _bursts(spark, d, _one({"EventID": 4769, "TicketEncryptionType": "0x17"}), {"count": 3, "within_seconds": 43200, "group_by": ["Computer"]})


@query(_walk("SELECT coalesce(Computer, '') AS k, epoch_us(_ingested) AS us, _rid, lower(coalesce(TargetUserName, '')) AS v FROM sec_events WHERE EventID = 4624", 14_400_000_000, "count(DISTINCT b.v) >= 4"))
def threshold_distinct(spark: SparkSession, d: str) -> DataFrame:
    return _bursts(spark, d, _one({"EventID": 4624}), {"count": 4, "within_seconds": 14400, "group_by": ["Computer"], "distinct": "TargetUserName"})


@query(_walk("SELECT '' AS k, epoch_us(_ingested) AS us, _rid FROM sec_events WHERE EventID = 4688", 10_800_000_000, "count(*) >= 5"))
def threshold_one_group(spark: SparkSession, d: str) -> DataFrame:
    """All hits in one group: chunks of it are walked apart."""
    return _bursts(spark, d, _one({"EventID": 4688}), {"count": 5, "within_seconds": 10800})


# ---- sequences ----


def _steps(spark: SparkSession, d: str, join: list, ids: list, within: int) -> DataFrame:
    """A sequence of steps that are rules of the pack, or detections of their own."""
    steps = [{"id": f"s{i}", **({"rule": r} if isinstance(r, str) else {"detection": r})} for i, r in enumerate(ids)]
    rule = rule_of({"id": "q-seq", "title": "q", "level": "high", "sequence": {"within_seconds": within, "steps": steps, "join": join}})
    found = hits.detections(events(spark, d), [r for r in signatures() if not r.threshold])
    return sequences.sequence(rule, found, events(spark, d))


_S = f"WITH g AS ({_GATED}), one AS (SELECT _rid, epoch_us(_ingested) AS us, {_norm(_first('TargetUserName'), False)} AS a, {_norm(_first('Computer'), True)} AS h FROM g WHERE {_HITS['ll-0002']}), "
_TWO = _S + f"""two AS (SELECT _rid, epoch_us(_ingested) AS us, {_norm(_first('Computer'), True)} AS h FROM g WHERE {_HITS['ll-0007']}),
m AS (SELECT one._rid AS r1, two._rid AS r2, row_number() OVER (PARTITION BY one._rid ORDER BY two.us, two._rid) AS n FROM one JOIN two ON one.h = two.h AND one.h <> '' AND two.us BETWEEN one.us AND one.us + 172800000000)
SELECT r2 AS last_rid, count(*) AS n_starts, min(r1) AS least_start FROM m WHERE n = 1 GROUP BY r2"""


@query(_TWO)
def sequence_two_step(spark: SparkSession, d: str) -> DataFrame:
    """Starts that complete through the same later step are one sequence."""
    out = _steps(spark, d, [["s0.host", "s1.host"]], ["ll-0002", "ll-0007"], 172800)
    parts = out.select("det_id", "n_starts", F.explode("event_rids").alias("_rid"))
    logons = events(spark, d).where("EventID = 4624").select("_rid")
    tail = parts.join(logons, "_rid", "left_anti").select("det_id", F.col("_rid").alias("last_rid"))
    starts = parts.join(logons, "_rid", "left_semi").groupBy("det_id", "n_starts").agg(F.min("_rid").alias("least_start"))
    return starts.join(tail, "det_id").select("last_rid", "n_starts", "least_start")


_THREE = _S + f"""two AS (SELECT _rid, epoch_us(_ingested) AS us, {_norm(_first('Computer'), True)} AS h FROM g WHERE {_HITS['ll-0004']}),
three AS (SELECT _rid, epoch_us(_ingested) AS us, {_norm(_first('Computer'), True)} AS h FROM g WHERE contains(lower(CommandLine), '/c copy')),
m AS (SELECT one._rid AS r1, two._rid AS r2, three._rid AS r3, row_number() OVER (PARTITION BY one._rid ORDER BY two.us, two._rid, three.us, three._rid) AS n
      FROM one JOIN two ON one.h = two.h AND one.h <> '' AND two.us BETWEEN one.us AND one.us + 864000000000
      JOIN three ON three.h = two.h AND three.us >= two.us AND three.us <= one.us + 864000000000)
SELECT r1 AS first_rid, r2 AS second_rid, r3 AS third_rid FROM m WHERE n = 1 QUALIFY row_number() OVER (PARTITION BY r2, r3 ORDER BY r1) = 1"""


@query(_THREE)
def sequence_three_step(spark: SparkSession, d: str) -> DataFrame:
    """Three steps on one host, the last with its own detection; the least start of each sequence."""
    copy = {"copied": {"CommandLine|contains": "/c copy"}}
    out = _steps(spark, d, [["s0.host", "s1.host"], ["s1.host", "s2.Computer"]], ["ll-0002", "ll-0004", copy], 864000)
    parts = out.select("det_id", F.explode("event_rids").alias("_rid")).join(events(spark, d).select("_rid", "EventID"), "_rid")
    at = lambda cond: F.min(F.when(cond, F.col("_rid")))
    return parts.groupBy("det_id").agg(at(F.col("EventID") == 4624).alias("first_rid"), at(F.col("EventID") == 10).alias("second_rid"), at(~F.col("EventID").isin(4624, 10)).alias("third_rid")).drop("det_id")


# ---- anomalies ----

_BASE = """WITH s AS (SELECT min(epoch_us(_ingested)) AS a, max(epoch_us(_ingested)) AS b FROM sec_events),
auth AS (SELECT *, epoch_us(_ingested) AS us, coalesce(regexp_replace(IpAddress, '^::ffff:', '', 'i'), '') AS src, (SELECT a + CAST(trunc((b - a) * 0.25) AS BIGINT) FROM s) AS cut FROM sec_events WHERE EventID IN (4624, 4625, 4648, 4768, 4769, 4771, 4776))"""


@query(_BASE + """ SELECT src AS source, count(*) AS n_events, min(us) AS first_us, count(DISTINCT nullif(TargetUserName, '')) AS n_accounts, min_by(coalesce(TargetUserName, ''), (us, _rid)) AS actor FROM auth
WHERE us > cut AND src NOT IN ('', '-', '::1', '127.0.0.1', '0.0.0.0') AND src NOT IN (SELECT src FROM auth WHERE us <= cut) GROUP BY src""")
def first_seen_source(spark: SparkSession, d: str) -> DataFrame:
    auth, cutoff = anomalies.split_at(events(spark, d), 0.25)
    return anomalies.first_seen(auth, cutoff).select("source", "n_events", F.unix_micros("start_ts").alias("first_us"), "n_accounts", "actor")


@query(_BASE + """, f AS (SELECT lower(TargetUserName) AS account, us, _rid, coalesce(Computer, '') AS h FROM auth WHERE EventID = 4624 AND trim(LogonType) IN ('3', '10') AND TargetUserName <> ''),
c AS (SELECT x.account, x.us, x._rid, count(DISTINCT y.h) AS n FROM f x JOIN f y ON x.account = y.account AND y.us BETWEEN x.us AND x.us + 3600000000 GROUP BY ALL)
SELECT account, max(n) AS n_hosts, min_by(us, (-n, us, _rid)) AS at_us FROM c GROUP BY account""")
def host_fanout(spark: SparkSession, d: str) -> DataFrame:
    auth, _ = anomalies.split_at(events(spark, d), 0.25)
    return anomalies.fan_out(auth).select("account", "n_hosts", F.col("us").alias("at_us"))


@query(_BASE + """, new AS (SELECT src, count(*) AS n, min_by(_ingested, (us, _rid)) AS t, min_by(coalesce(TargetUserName, ''), (us, _rid)) AS actor, min_by(coalesce(Computer, ''), (us, _rid)) AS host FROM auth
  WHERE us > cut AND src NOT IN ('', '-', '::1', '127.0.0.1', '0.0.0.0') AND src NOT IN (SELECT src FROM auth WHERE us <= cut) GROUP BY src),
f AS (SELECT lower(TargetUserName) AS account, us, _rid, us <= cut AS base, coalesce(Computer, '') AS h, coalesce(IpAddress, '') AS ip, _ingested FROM auth WHERE EventID = 4624 AND trim(LogonType) IN ('3', '10') AND TargetUserName <> ''),
c AS (SELECT x.account, x.base, x.us, x._rid, x.h, x.ip, x._ingested, count(DISTINCT y.h) AS n FROM f x JOIN f y ON x.account = y.account AND x.base = y.base AND y.us BETWEEN x.us AND x.us + 3600000000 GROUP BY ALL),
top AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY account, base ORDER BY -n, us, _rid) = 1)
SELECT 'll-a001' AS rule_id, t AS start_ts, actor, host, src AS source, n AS n_events FROM new
UNION ALL SELECT 'll-a002', _ingested, account, h, ip, 1 FROM top WHERE NOT base AND n >= greatest(4, (SELECT coalesce(max(n), 0) FROM top WHERE base) + 2)""")
def anomaly_detections(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.anomalies(events(spark, d)).select("rule_id", "start_ts", "actor", "host", "source", F.size("event_rids").alias("n_events"))
