"""Queries of the general data problems, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lanternlog.operators import drift, keychunks, timeline
from lanternlog.sources.tables import table


def _times(spark: SparkSession, d: str, declared: bool = True) -> DataFrame:
    sources = table(spark, d, "collectors").select(F.col("collector").alias("source"), "tz", "date_order").where(F.lit(declared))
    events = timeline.long_values(table(spark, d, "sec_events"), "sec_events", "_rid", ["TimeCreated"], "collector")
    cloud = timeline.long_values(table(spark, d, "cloud_records"), "cloud_records", "record_id", ["TimeGenerated", "Timestamp", "CreationTime"], "collector")
    return timeline.resolve(events.unionByName(cloud), sources)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return timeline.found(_times(spark, d))


def p1_instants(spark: SparkSession, d: str) -> DataFrame:
    """Every value that names an instant, in one form."""
    return _times(spark, d).select("src", "row_id", "field", F.timestamp_micros("utc_us").alias("utc"))


def p1_undeclared(spark: SparkSession, d: str) -> DataFrame:
    """The same values if no collector declared anything: the order of the records alone decides, and local times read as UTC."""
    return _times(spark, d, False).select("src", "row_id", "field", F.timestamp_micros("utc_us").alias("utc"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    heavy = keychunks.heavy_keys(table(spark, d, "sec_events"), "_chunk", ["EventID", "Computer"], "_rid", 20)
    return heavy.where("_chunk is not null").select(F.col("_chunk").alias("chunk_no"), "field", "key_value")


def p2_event_id_profile(spark: SparkSession, d: str) -> DataFrame:
    return keychunks.key_profile(table(spark, d, "sec_events").withColumn("EventID", F.col("EventID").cast("string")), ["EventID"], "_rid", "_ingested")


def p2_computer_profile(spark: SparkSession, d: str) -> DataFrame:
    return keychunks.key_profile(table(spark, d, "sec_events"), ["Computer"], "_rid", "_ingested")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = drift.changes(drift.schemas(table(spark, d, "raw_records"), table(spark, d, "field_aliases")))
    return found.where("named").select("feed", "file_no", "change_kind", "field")


def p7_changes(spark: SparkSession, d: str) -> DataFrame:
    """Every change of every path, those of no known field under their own names, with what was and what is."""
    return drift.changes(drift.schemas(table(spark, d, "raw_records"), table(spark, d, "field_aliases")))


def p7_table(spark: SparkSession, d: str) -> DataFrame:
    """All lines under the fields' own names, with typed branches."""
    names = drift.alias_names(table(spark, d, "field_aliases"))
    return drift.conform(table(spark, d, "raw_records"), names, ["raw_id", "feed", "file_no", "line_no"])


QUERIES = {f.__name__: f for f in (p1_found, p1_instants, p1_undeclared, p2_found, p2_event_id_profile, p2_computer_profile, p7_found, p7_changes, p7_table)}

_PROFILE = """
SELECT {key}, count(*) AS n_rows, min_by(ts, rid) AS first_at, max_by(ts, rid) AS last_at,
       coalesce(max(epoch_us(ts) - epoch_us(before)), 0) AS max_step_us, CAST(count(*) FILTER (WHERE ts < before) AS BIGINT) AS n_back
FROM (SELECT CAST({key} AS VARCHAR) AS {key}, _rid AS rid, _ingested AS ts, lag(_ingested) OVER (PARTITION BY {key} ORDER BY _rid) AS before FROM sec_events)
GROUP BY {key}"""

_CHANGES = """
WITH l AS (SELECT DISTINCT feed, file_no, ltrim(payload, chr(65279)) AS p FROM raw_records),
files AS (SELECT feed, file_no, lag(file_no) OVER (PARTITION BY feed ORDER BY file_no) AS before FROM (SELECT DISTINCT feed, file_no FROM l)),
t AS (SELECT DISTINCT feed, file_no, replace(substr(j.fullkey, 3), '"', '') AS path,
        CASE j.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END AS json_type
      FROM (SELECT * FROM l WHERE json_valid(p) AND json_type(p) = 'OBJECT') o, json_tree(o.p) j WHERE j.type <> 'NULL' AND j.fullkey <> '$' AND NOT contains(j.fullkey, '[')),
f AS (SELECT feed, file_no, coalesce(a.field, path) AS field, a.field IS NOT NULL AS named, list_sort(list_distinct(list(path))) AS sp, list_sort(list_distinct(list(json_type))) AS ty FROM t LEFT JOIN field_aliases a ON a.spelling = t.path GROUP BY ALL),
own AS (SELECT f.*, before FROM f JOIN files USING (feed, file_no) WHERE before IS NOT NULL),
old AS (SELECT f.feed, x.file_no, f.field, f.named, f.sp, f.ty FROM f JOIN files x ON x.feed = f.feed AND x.before = f.file_no),
both_ AS (SELECT coalesce(n.feed, o.feed) AS feed, coalesce(n.file_no, o.file_no) AS file_no, coalesce(n.field, o.field) AS field, coalesce(n.named, o.named) AS named, o.sp AS osp, n.sp AS nsp, o.ty AS oty, n.ty AS nty
          FROM own n FULL OUTER JOIN old o ON n.feed = o.feed AND n.file_no = o.file_no AND n.field = o.field AND n.named = o.named),
ch AS (SELECT *, unnest(CASE WHEN osp IS NULL THEN ['added'] WHEN nsp IS NULL THEN ['removed'] ELSE list_filter([CASE WHEN osp <> nsp THEN 'renamed' END, CASE WHEN oty <> nty THEN 'retyped' END], lambda k: k IS NOT NULL) END) AS change_kind FROM both_)
"""
_SIDE = "nullif(concat_ws(' as ', array_to_string({0}sp, ', '), array_to_string({0}ty, ', ')), '')"

SQL = {
    "p7_found": _CHANGES + "SELECT feed, file_no, change_kind, field FROM ch WHERE named",
    "p7_changes": _CHANGES + f"SELECT feed, file_no, change_kind, field, named, coalesce({_SIDE.format('o')}, '') AS was, coalesce({_SIDE.format('n')}, '') AS now FROM ch",
    "p2_found": """
WITH long AS (
  SELECT _chunk, 'EventID' AS field, CAST(EventID AS VARCHAR) AS key_value FROM sec_events
  UNION ALL SELECT _chunk, 'Computer', Computer FROM sec_events),
total AS (SELECT _chunk, count(*) AS n FROM sec_events GROUP BY _chunk)
SELECT l._chunk AS chunk_no, l.field, l.key_value FROM long l JOIN total t ON l._chunk = t._chunk
WHERE l.key_value IS NOT NULL GROUP BY l._chunk, l.field, l.key_value, t.n HAVING count(*) * 20 >= t.n""",
    "p2_event_id_profile": _PROFILE.format(key="EventID"),
    "p2_computer_profile": _PROFILE.format(key="Computer"),
}
