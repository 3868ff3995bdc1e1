"""Queries do the whole job: nothing of their tables is left out."""

import json

from pyspark.sql import functions as F

from lanternlog.functions import entities
from lanternlog.operators import coverage
from lanternlog.plans import exports, incidents, rules
from lanternlog.sources.tables import table
from tests.conftest import DATA
from tests.test_incidents import det, frame


def stored(rows, tmp_path):
    """A data folder with these detections."""
    rows.drop("targets").write.parquet(f"{tmp_path}/detections.parquet")
    return str(tmp_path)


def test_detections_within_six_hours_are_one_incident(spark, tmp_path):
    hours = {1: 0, 2: 5, 3: 12}
    d = stored(frame(spark, [det(i, 60 * h, host=None) for i, h in hours.items()]), tmp_path)
    assert {r.det_id: r.incident_id for r in incidents.incident_components(spark, d).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.incident_id: r.n_detections for r in incidents.incident_summary(spark, d).collect()} == {1: 2, 3: 1}


def test_entities_of_a_detection_with_a_null(spark, tmp_path):
    d = stored(frame(spark, [det(1, actor="D\\A", host=None, source=None), det(2, actor=None, host="H.x", source="S")]), tmp_path)
    assert {tuple(r) for r in rules.norm_entity(spark, d).collect()} == {(1, "a", None, None), (2, None, "h", "s")}


def test_every_hex_field_of_an_event(spark, tmp_path):
    rows = [(1, "0x0010", "0x00012", "0x0"), (2, None, " 0X00AB ", "0x0C000006A"), (3, None, None, "ok"), (4, None, None, None)]
    spark.createDataFrame(rows, "_rid long, GrantedAccess string, TicketEncryptionType string, Status string").write.parquet(f"{tmp_path}/sec_events.parquet")
    access, ticket, status = "GrantedAccess", "TicketEncryptionType", "Status"
    assert {tuple(r) for r in rules.norm_hex(spark, str(tmp_path)).collect()} == {(1, access, "0x10"), (1, ticket, "0x12"), (1, status, "0x0"), (2, ticket, "0xab"), (2, status, "0xc000006a"), (3, status, "ok")}


def test_edges_of_ten_entities_a_kind(spark, tmp_path):
    d = stored(frame(spark, [det(i, actor=f"a{i}", host="h") for i in range(10, 22)]), tmp_path)
    assert {r.from_key for r in incidents.graph_edges_topk(spark, d).collect()} == {f"actor:a{i}" for i in range(10, 20)}


def test_all_detections_of_a_large_incident(spark, tmp_path):
    rows = [det(i, i / 60, host=None, techniques=["T9"] if i > 2400 else ["T1"]) for i in range(1, 2501)]
    d = stored(frame(spark, rows), tmp_path)
    lines = exports.incident_json(spark, d).orderBy(F.col("det_id").asc_nulls_first()).collect()
    head = json.loads(lines[0].body)
    assert [r.det_id for r in lines] == [None, *range(1, 2501)] and {r.incident_id for r in lines} == {1} and head["n_detections"] == 2500
    last = json.loads(lines[-1].body)
    assert last["start"] == "2025-01-01T00:41:40" and last["attack"] == ["T9"] and last["host"] is None and last["event_count"] == 1 and last["risk"] == 40
    hive = json.loads(exports.thehive_alerts(spark, d).first().body)
    assert {p["patternId"]: p["occurDate"] for p in hive["procedures"]} == {"T1": 1735689601000, "T9": 1735689600000 + 2401 * 1000}
    assert "2500 detections" in [json.loads(r.body).get("description") for r in exports.stix_objects(spark, d).collect()]


def test_a_long_hex_number(spark):
    long = "0X00" + "A1" * 3000
    got = [r[0] for r in spark.createDataFrame([(long,), ("0x000",), (" 0x0a ",)], "v string").select(entities.canon_hex(F.col("v"))).collect()]
    assert got == ["0x" + "a1" * 3000, "0x0", "0xa"]


def test_every_incident_is_exported(spark, tmp_path):
    d = stored(frame(spark, [det(i, 10_000 * i, actor=f"a{i}", host=f"h{i}") for i in range(1, 71)]), tmp_path)
    assert exports.thehive_alerts(spark, d).count() == exports.misp_events(spark, d).count() == 70 and exports.incident_json(spark, d).where("det_id is null").count() == 70
    assert "Detected" not in exports.incident_markdown(spark, d).first().body


def test_a_profile_has_no_bound(spark):
    events = table(spark, DATA, "sec_events")
    few = events.where("EventID is not null").limit(1).withColumn("_i", F.explode(F.array(*map(F.lit, range(1000, 1200)))))
    seen = coverage.profile(few.withColumn("EventID", F.col("_i")).withColumn("Channel", F.concat(F.lit("c"), "_i")).drop("_i"))
    assert seen.histogram.count() == 200 and seen.channels.count() == 200 and seen.n_events == 200
