"""Queries of the text and pair problems, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lanternlog.llm import groups, languages, lookalikes, mixing, mojibake, runs, tokens
from lanternlog.sources.tables import table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("CommandLine", "Image")])
    return table(spark, d, "sec_events").select(F.col("_rid").alias("row_id"), F.col("collector").alias("source"), F.inline(fields)).where("text is not null")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    values = _texts(spark, d)
    return mojibake.found(values, mojibake.fit(values))


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    values = _texts(spark, d)
    return mojibake.repair(values, mojibake.fit(values)).withColumnRenamed("row_id", "rid")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    edges = groups.edges_of(table(spark, d, "det_matches"), "det_a", "det_b", table(spark, d, "detections"), "det_id")
    return groups.components(edges).select("group_id", F.col("id").alias("det_id"))


def _names(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "sec_events").select(F.lit("sec_events").alias("src"), F.col("_rid").alias("row_id"), F.lit("Image").alias("field"), F.col("Image").alias("text"))
    cloud = table(spark, d, "cloud_records").select(F.lit("cloud_records").alias("src"), F.col("record_id").alias("row_id"), F.lit("ActivityDisplayName").alias("field"), F.col("ActivityDisplayName").alias("text"))
    return lookalikes.match_names(events.unionByName(cloud), table(spark, d, "name_catalog"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).select("src", "row_id", "name_id")


def p5_names(spark: SparkSession, d: str) -> DataFrame:
    """The same values with their text and the name they look like."""
    return _names(spark, d)


def _runs(spark: SparkSession, d: str) -> DataFrame:
    detections = table(spark, d, "detections")
    return runs.collapse(detections, [F.col("recording"), runs.host_key(F.col("host"))], runs.same_text(F.col("rule_id")), "start_ts", "end_ts", "det_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).where("n >= 2").select(F.col("first_id").alias("first_det_id"), F.col("n").alias("n_dets"))


def p6_runs(spark: SparkSession, d: str) -> DataFrame:
    """Every run, single detections included, with its span in microseconds."""
    return _runs(spark, d).select(F.col("first_id").alias("first_det_id"), F.col("n").alias("n_dets"), (F.unix_micros("end_ts") - F.unix_micros("start_ts")).alias("span_us"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_documents(table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_documents(table(spark, d, "documents"), table(spark, d, "source_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_documents(table(spark, d, "documents"), table(spark, d, "source_targets"))[1]


def _languages(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return languages.assign(documents, languages.train(documents))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.found(_languages(spark, d))


def p10_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every document and paragraph with its language and confidence."""
    return _languages(spark, d).select("doc_id", "cell_no", "para_no", "lang", "confidence")


QUERIES = {f.__name__: f for f in (p3_found, p3_repaired, p4_found, p5_found, p5_names, p6_found, p6_runs, p8_ids, p9_mix, p9_shares, p10_found, p10_languages)}

_HOST = "CASE WHEN regexp_full_match(h, '\\d{1,3}(\\.\\d{1,3}){3}') OR contains(h, ':') THEN regexp_replace(h, '^::ffff:([0-9.]+)$', '\\1') ELSE split_part(h, '.', 1) END"
_RUNS = f"""
WITH cleaned AS (
  SELECT det_id, recording, start_ts, coalesce(end_ts, start_ts) AS end_ts, lower(regexp_replace(host, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')) AS h,
         lower(regexp_replace(rule_id, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')) AS rule FROM detections),
keyed AS (SELECT *, {_HOST} AS host FROM cleaned WHERE h IS NOT NULL AND h NOT IN ('', '-') AND recording IS NOT NULL),
flagged AS (SELECT *, CASE WHEN rule IS NOT DISTINCT FROM lag(rule) OVER w AND lag(det_id) OVER w IS NOT NULL THEN 0 ELSE 1 END AS flag
            FROM keyed WINDOW w AS (PARTITION BY recording, host ORDER BY start_ts, det_id)),
numbered AS (SELECT *, sum(flag) OVER (PARTITION BY recording, host ORDER BY start_ts, det_id) AS run FROM flagged)
SELECT min_by(det_id, (start_ts, det_id)) AS first_det_id, count(*) AS n_dets, max(epoch_us(end_ts)) - min(epoch_us(start_ts)) AS span_us
FROM numbered GROUP BY recording, host, run"""

SQL = {
    "p4_found": """
WITH RECURSIVE edges AS (
  SELECT m.det_a AS a, m.det_b AS b FROM det_matches m
  WHERE m.det_a <> m.det_b AND m.det_a IN (SELECT det_id FROM detections) AND m.det_b IN (SELECT det_id FROM detections)),
links AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a AS det_id, a AS seen FROM links UNION SELECT r.det_id, l.b FROM reach r JOIN links l ON r.seen = l.a)
SELECT min(seen) AS group_id, det_id FROM reach GROUP BY det_id""",
    "p6_found": f"SELECT first_det_id, n_dets FROM ({_RUNS}) WHERE n_dets >= 2",
    "p6_runs": _RUNS,
}
