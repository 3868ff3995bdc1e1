"""Sources, the whole hunt, streams, documents and the benchmark."""

import datetime as dt
import hashlib
import http.server
import json
import random
import re
import threading

import pytest
from pyspark.sql import functions as F

from lanternlog.operators import hits, processes
from lanternlog.operators import incidents as I
from lanternlog.plans import benchmark, documents, grounding, pipeline, push, reports
from lanternlog.plans.rulebook import rule_of
from lanternlog.plans.rules import pack
from lanternlog.session import Tables
from lanternlog.sources import events as sources
from lanternlog.sources import normalize
from lanternlog.streaming import channels, live

T0 = dt.datetime(2025, 6, 1, tzinfo=dt.timezone.utc)


def decoded(spark, *records):
    lines = spark.createDataFrame([(i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(records)], "i int, value string")
    return {r.i: r for r in normalize.decode(lines, keep=("i",)).collect()}


def test_normalize_shapes(spark):
    got = decoded(
        spark, {"EventID": "4688", "TimeCreated": "2025-01-01T00:00:00.1234567Z", "NewProcessName": " C:\\x.exe ", "GrantedAccess": "0x00001010", "IpAddress": "::ffff:1.2.3.4", "Provider": "p", "A": "-"},
        {"@timestamp": "2025-01-01T00:00:00Z", "event": {"code": 10}, "winlog": {"channel": "c", "event_data": {"X": 1}}, "host": {"name": "h"}}, {"EventID": 1}, {"EventID": "x", "TimeCreated": "2025-01-01"},
        {"TimeCreated": "2025-01-01", "User": "RenÃ©", "Empty": ""}, {"TimeCreated": "31.12.2024 10:00:00", "User": "Ñandú", "List": [1, {"a": None}]}, "bad", "[1]", "", None, "{}", '\ufeff{"TimeCreated": "2025-01-01", "a": {"b": {"c": true}}}')
    flat, ecs = got[0], got[1]
    assert flat.Image == "C:\\x.exe" and flat.GrantedAccess == "0x1010" and flat.IpAddress == "1.2.3.4" and flat.Provider_Name == "p" and flat.TimeCreated.microsecond == 123456
    assert (ecs.EventID, ecs.Channel, ecs.fields["x"], ecs.Computer) == (10, "c", "1", "h")
    assert [got[i].problem for i in (2, 3, 6, 7, 10)] == ["no time", "event id is no number", "no JSON object", "no JSON object", "no time"] and 8 not in got and 9 not in got
    assert got[4].User == "René" and "empty" not in got[4].fields and got[5].User == "Ñandú" and got[5].TimeCreated.year == 2024 and json.loads(got[5].fields["list"]) == [1, {"a": None}]
    assert got[11].fields == {"a.b.c": "true"} and got[11].problem is None
    assert normalize.quarantine(spark.createDataFrame([("bad",), ("{}",)], "value string")).count() == 2


def test_normalize_cloud(spark):
    audit = {"Type": "AuditLogs", "TimeGenerated": "2025-01-01T00:00:00Z", "OperationName": "Update application – secrets  ", "InitiatedBy": '{"user": {"userPrincipalName": "u@x"}}', "IPAddress": "1.2.3.4:55", "TargetResources": '[{"type": "App", "modified": [{"key": "k", "value": "v"}]}]', "Result": "success"}
    hunting = {"Timestamp": "2025-01-01T00:00:00Z", "ActionType": "LdapSearch", "AccountUpn": "a@b", "AdditionalFields_string": '{"DistinguishedName": "CN=x"}'}
    long = {"Type": "officeactivity", "CreationTime": "2025-01-01", "Parameters": json.dumps({"p": "x" * 9000})}
    got = decoded(spark, audit, hunting, long)
    event = got[0]
    assert event._platform == "azure" and event.Computer == "Entra ID" and event.User == "u@x" and event.IpAddress == "1.2.3.4" and event.EventID == 0
    assert event.fields["properties.message"] == "Update application - secrets" and event.fields["targetresources.type"] == "App" and event.fields["targetresources.0.modified.k"] == "v"
    assert got[1].Channel == "m365d/ldapsearch" and got[1].fields["additionalfields_string.distinguishedname"] == "CN=x"
    assert got[2].Computer == "Microsoft 365 Online" and len(got[2].fields["parameters.p"]) == 9000


def test_one_name_in_any_case(spark):
    """Two spellings, in one partition or in two, are one field to a rule."""
    lines = spark.createDataFrame([('{"TimeCreated": "2025-01-01", "SourceIp": "1.1.1.1"}',), ('{"TimeCreated": "2025-01-01", "sourceip": "1.1.1.1"}',)], "value string")
    rule = rule_of({"id": "q", "detection": {"s": {"SourceIP": "1.1.1.1"}, "condition": "s"}})
    for parts in (1, 2):
        events = normalize.events_of_json(lines.repartition(parts)).withColumn("_rid", F.monotonically_increasing_id())
        assert hits.rule_hits(events, [rule]).count() == 2 and {k for r in events.collect() for k in r.fields} == {"sourceip"}
    mixed = spark.sql("select * from values (1L, map('Opcode', 'a', 'opcode', 'b')), (2L, map('OPCODE', 'a')), (3L, null) t(_rid, fields)").withColumns({"EventID": F.lit(1), "TimeCreated": F.current_timestamp()})
    assert {r._rid for r in hits.rule_hits(mixed, [rule_of({"id": "q", "detection": {"s": {"opCode": "a"}, "condition": "s"}})]).collect()} == {1, 2}


XML = '<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Provider Name="P"/><EventID>1</EventID><TimeCreated SystemTime="2025-01-01T00:00:00.1Z"/><EventRecordID>77</EventRecordID><Channel>C</Channel><Computer>h</Computer></System><EventData><Data Name="Image">x</Data><Data>one</Data><Data>two</Data></EventData></Event>'


def test_xml():
    raw = normalize.xml_record(XML)
    assert raw["Image"] == "x" and raw["Data1"] == "one" and raw["Data"] == "one two" and raw["EventRecordID"] == "77" and raw["Provider"] == "P"
    assert normalize.xml_record("<broken") is None and normalize.xml_record(" " * 5000 + "<!DOCTYPE a><Event/>") is None
    user = normalize.xml_record('<Event><System><EventID>5</EventID></System><UserData><X><EventID>9</EventID><Why>w</Why></X></UserData></Event>')
    assert user == {"EventID": "5", "Why": "w"}


def test_xml_documents(spark):
    two = spark.createDataFrame([("a", f"<Events>{XML}{XML}</Events>"), ("b", "\ufeff" + XML), ("c", "<!DOCTYPE a>" + XML), ("d", ""), ("e", None)], "file string, value string")
    got = normalize.json_of_xml(two, ("file",)).collect()
    assert sorted(r.file for r in got) == ["a", "a", "b"] and normalize.events_of_xml(two).where("EventID = 1 and Image = 'x'").count() == 3


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text("﻿" + json.dumps([{"EventID": 1, "TimeCreated": "2025-01-01T00:00:00Z", "image": "x"}, {"EventID": 2}]), encoding="utf-8")
    (tmp_path / "b.ndjson").write_text('{"EventID": 3, "TimeCreated": "2025-01-02", "L": [1, true], "Img": 1}\n\n', encoding="utf-8")
    (tmp_path / "c.xml").write_text(XML)
    got = {r.EventID: r for r in sources.load(spark, [str(tmp_path)]).collect()}
    assert len(got) == 2 and got[3].fields == {"l": "[1,true]", "img": "1"}
    rids = [r._rid for r in sources.load(spark, [str(tmp_path)]).collect()]
    assert len(set(rids)) == len(rids) == 3
    for bad in (["/none"], [str(tmp_path / "empty")]):
        (tmp_path / "empty").mkdir(exist_ok=True)
        with pytest.raises(sources.NoEventsError):
            sources.load(spark, bad)
    lake = str(tmp_path / "lake")
    sources.write_lake(sources.load(spark, [str(tmp_path / "b.ndjson")]), lake)
    assert sources.of_event_ids(sources.read_lake(spark, lake), [3]).count() == 1 and sources.of_event_ids(sources.read_lake(spark, lake), []).count() == 0
    (tmp_path / "broken.json").write_text('{"EventID": 1, "TimeCreated": "2025-01-01"}\n{"EventID"')
    with pytest.raises(sources.NoEventsError, match="no JSON object"):
        sources.load(spark, [str(tmp_path / "broken.json")])
    pins = {str(tmp_path / "c.xml"): hashlib.sha256(XML.encode()).hexdigest(), str(tmp_path / "b.ndjson"): "0"}
    assert {r.ok for r in sources.verify_sha256(spark, pins).collect()} == {True, False}


def recording():
    """A quiet office with one intruder: invented anew."""
    rng = random.Random(9)
    rows = []

    def add(minutes, event_id, **values):
        rows.append({"EventID": event_id, "TimeCreated": (T0 + dt.timedelta(minutes=minutes)).isoformat(), "Channel": "Security" if event_id > 255 else "Microsoft-Windows-Sysmon/Operational", "Computer": "dc1.corp.local", **values})

    for i in range(150):
        who, ip = f"user{rng.randint(1, 9)}", f"10.0.0.{rng.randint(1, 9)}"
        add(i * 1.5, 4769, TicketEncryptionType="0x12", ServiceName="svc", TargetUserName=who, IpAddress=ip)
        add(i * 1.5 + 0.2, 4624, LogonType="3", AuthenticationPackageName="Kerberos", TargetUserName=who, IpAddress=ip, WorkstationName="ws")
    for i in range(3):
        add(190 + i, 4624, LogonType="3", AuthenticationPackageName="NTLM", TargetUserName="mal", IpAddress="10.66.6.6", WorkstationName="kali")
    for i in range(3):
        add(200 + i * 0.2, 4769, TicketEncryptionType="0x17", ServiceName=f"svc{i}", TargetUserName="mal", IpAddress="10.66.6.6")
    add(205, 10, SourceImage="C:\\t\\d.exe", TargetImage="C:\\Windows\\System32\\lsass.exe", GrantedAccess="0x00001410", User="CORP\\mal")
    for i in range(4):
        add(215 + i * 0.1, 4662, Properties="1131f6ad-9c07-11d1", SubjectUserName="mal")
    return rows


@pytest.fixture(scope="module")
def office(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("office") / "day.ndjson"
    path.write_text("\n".join(map(json.dumps, recording())))
    return Tables(spark, "office").put(sources.load(spark, [str(path)]))


@pytest.fixture(scope="module")
def result(office):
    return pipeline.hunt(office, pack())


def test_hunt(result):
    kinds = {(r.kind, r.rule_id) for r in result.detections.select("kind", "rule_id").distinct().collect()}
    assert ("sequence", "ll-s001") in kinds and ("signature", "ll-0001") in kinds and ("anomaly", "ll-a001") in kinds
    assert [r.source for r in result.detections.where("rule_id = 'll-a001'").collect()] == ["10.66.6.6"]
    top = result.incidents.collect()
    assert len(top) == 1 and top[0].severity == "Critical" and top[0].confidence.startswith("High") and top[0].phases[0] == "Initial Access" and top[0].phases[-1] == "Impact"
    assert pipeline.campaign_summary(result, 317)["sequences"] == ["ll-s001"]


def test_stream_engine_says_what_the_hunt_finds(spark, office, result):
    engine = live.Engine(spark, pack())
    lines = [line for batch in live.replay_steps(office, dt.timedelta(minutes=210)) for line in engine.ingest(batch)]
    assert engine.counters["events"] == office.count() and engine.counters["incidents"] == 1
    assert sum("Service tickets with weak" in line for line in lines) == 1
    assert any("escalated from" in line for line in lines) or any("Critical opened" in line for line in lines)
    alerts = {(r.rule_id, r.start_ts) for r in result.detections.where("kind <> 'anomaly' and level in ('medium', 'high', 'critical')").collect()}
    assert engine.counters["alerts"] == len(alerts)
    assert engine.ingest(office.limit(0)) == []


def test_watch_over_a_file_stream(spark, office, tmp_path):
    office.coalesce(1).write.parquet(str(tmp_path / "in"))
    engine, said = live.Engine(spark, [r for r in pack() if r.kind == "signature" and not r.threshold]), []
    stream = spark.readStream.schema(office.schema).parquet(str(tmp_path / "in"))
    live.watch(stream, engine, str(tmp_path / "checkpoint"), str(tmp_path / "alerts.jsonl"), echo=said.append).awaitTermination()
    assert said and len((tmp_path / "alerts.jsonl").read_text().splitlines()) == len(said)


def test_a_stream_forgets_behind_its_watermark(spark, tmp_path):
    """An alert said once within the watermark; what comes later than it isn't said; state behind it goes."""
    folder, out = tmp_path / "in", tmp_path / "out"
    rule = rule_of({"id": "q", "title": "q", "level": "high", "detection": {"s": {"EventID": 1}, "condition": "s"}})
    schema = "_rid long, TimeCreated timestamp, EventID int, Computer string"
    rows = [[(1, 0), (2, 0)], [(3, 0), (4, 300)], [(5, 300), (6, 0)], [(7, 900)], [(8, 901)]]  # (id, minutes): repeated, repeated and later, too late, much later
    said = []
    for batch in rows:
        spark.createDataFrame([(i, T0 + dt.timedelta(minutes=m), 1, "h") for i, m in batch], schema).coalesce(1).write.mode("append").parquet(str(folder))
        alerts = live.stream_alerts(spark.readStream.schema(schema).parquet(str(folder)), [rule], "1 hour")
        query = alerts.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        said.append(spark.read.schema(alerts.schema).parquet(str(out)).count())
        held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert said == [1, 2, 2, 3, 4] and held[-1] == 2


def test_tumbling_counts(spark, office, tmp_path):
    office.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(office.schema).parquet(str(tmp_path / "in"))
    counts = live.tumbling_counts(stream, "1 hour", "1 hour")
    counts.writeStream.format("memory").queryName("bins").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("bins").agg(F.sum("n")).first()[0] == office.count()


def test_a_new_driver_goes_on_from_the_last_batch(spark, office, tmp_path):
    """The same batches, the engine made anew before each, and each batch delivered twice."""
    whole = live.Engine(spark, pack())
    batches = list(live.replay_steps(office, dt.timedelta(minutes=110)))
    want = [whole.ingest(b) for b in batches]
    folder = f"file://{tmp_path}/engine"
    for number, (batch, lines) in enumerate(zip(batches, want)):
        engine = live.Engine(spark, pack(), folder=folder)
        assert sorted(engine.ingest(batch, number)) == sorted(lines)
        again = live.Engine(spark, pack(), folder=folder)
        assert sorted(again.ingest(batch, number)) == sorted(lines) and again.counters == engine.counters
        assert again.ingest(batch, number - 1) == []
    assert again.counters == whole.counters


def test_channel_reader():
    logs = {"Security": [XML.replace(">77<", f">{i}<") for i in range(70, 80)], "System": [XML.replace(">77<", f">{i}<") for i in range(1, 4)], "Empty": []}

    def fake(channel, where, most, newest_first=False):
        if channel == "Broken":
            raise OSError("no access")
        ids = [int(x) for x in re.findall(r"EventRecordID [<>]=? (-?\d+)", where)]
        found = logs[channel][-3:] if "timediff" in where else [x for x in logs[channel] if channels.record_id(x) > ids[0] and (len(ids) < 2 or channels.record_id(x) <= ids[1])] if "> " in where else logs[channel]
        return (found[::-1] if newest_first else found)[:most]

    def reader(**options):
        out = channels.ChannelReader({"channels": "Security, System, Broken, Empty", **options})
        out.ask = fake
        return out

    live_ = reader()
    start = live_.initialOffset()
    assert start == {"Security": 79, "System": 3, "Broken": -1, "Empty": -1} and set(live_.broken) == {"Broken"}
    assert list(live_.read(start)[0]) == []
    logs["Security"].append(XML.replace(">77<", ">80<"))
    rows, end = live_.read(start)
    assert [channels.record_id(r[0]) for r in rows] == [80] and end["Security"] == 80
    assert reader(backfill_minutes="5").initialOffset()["Security"] == 77
    between = list(reader().readBetweenOffsets({"Security": 75, "System": 1}, {"Security": 77, "System": 2}))
    assert sorted(channels.record_id(r[0]) for r in between) == [2, 76, 77]  # each channel to its own end


@pytest.fixture(scope="module")
def head(spark, result):
    return Tables(spark, "heads").put(documents.heads(result.members))


def test_documents(spark, result, head):
    row = head.first()
    assert {"kind": "ip", "value": "10.66.6.6", "tag": "source"} in [o.asDict() for o in row.observables] and row.reference == documents.heads(result.members).first().reference
    hive, misp = (json.loads(f(head).first().body) for f in (documents.thehive_bodies, documents.misp_bodies))
    assert hive["severity"] == 4 and hive["procedures"] and hive["date"] == int(row.start_ts.replace(tzinfo=dt.timezone.utc).timestamp() * 1000) and misp["Event"]["threat_level_id"] == "1" and len(misp["Event"]["uuid"]) == 36
    assert {"dataType": "other", "data": "mal", "tags": ["account", "type:account"]} in hive["observables"]
    objects = {r.id: json.loads(r.body) for r in documents.stix_objects(head, T0).collect()}
    assert {o["type"] for o in objects.values()} >= {"identity", "attack-pattern", "ipv4-addr", "user-account", "note", "report"} and all(i == o["id"] for i, o in objects.items())
    report = next(o for o in objects.values() if o["type"] == "report")
    assert set(report["object_refs"]) <= set(objects)
    assert set(json.loads(documents.incident_bodies(head).first().body)) >= {"incident", "severity", "phases", "entities"}
    layer = json.loads(documents.navigator_layer(result.detections).first().body)
    assert layer["gradient"]["maxValue"] == max(t["score"] for t in layer["techniques"]) and json.loads(documents.coverage_layer(spark, pack()).first().body)["techniques"]
    assert json.loads(documents.navigator_layer(result.detections.limit(0)).first().body)["techniques"] == []
    assert documents.heads(result.members.limit(0)).count() == 0


def test_reports(spark, office, result, head, tmp_path):
    shown = reports.shown(result.members, 5)
    index = processes.process_index(office)
    tree = processes.process_tree(index, processes.flagged_processes(result.detections, office, index)).collect()
    edges = {shown[0].incident_id: I.graph_edges(result.members).collect()}
    page = reports.html_page(shown, {"ll-0002": {"kql": "a < b"}}, edges, tree)
    assert "<svg" in page and "10.66.6.6" in page and "a &lt; b" in page and "<line" in page and "| First seen |" in reports.markdown(shown)
    assert reports.write_incidents(tmp_path / "i.json", head, result.members) == 1
    whole = json.loads((tmp_path / "i.json").read_text())
    assert len(whole[0]["detections"]) == whole[0]["n_detections"] == result.members.count()
    assert reports.write_incidents(tmp_path / "none.json", head.limit(0), result.members.limit(0)) == 0 and json.loads((tmp_path / "none.json").read_text()) == []
    reports.write_bundle(tmp_path / "b.json", documents.stix_objects(head, T0), "x")
    assert json.loads((tmp_path / "b.json").read_text())["type"] == "bundle"
    count = reports.write_pages(tmp_path / "pages", documents.entity_pages(result.members))
    links = {part.split("'")[0] for file in (tmp_path / "pages").iterdir() for part in file.read_text().split("href='")[1:]}
    assert count > 3 and links <= {f.name for f in (tmp_path / "pages").iterdir()}


def test_pushes_to_a_stub(head, monkeypatch):
    seen = []

    class Stub(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, self.headers["Authorization"], json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            code, body = (400, b'{"message": "alert exists"}') if len(seen) == 2 else (500, b"no") if len(seen) == 4 else (201, b'{"_id": "1", "Event": {"id": "9"}}')
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base, alert = f"http://127.0.0.1:{server.server_port}/", documents.thehive_bodies(head).first().body
    assert [x.split()[0] for x in push.thehive(base, [alert, alert], "k")] == ["created", "exists"] and seen[0][:2] == ("/api/v1/alert", "Bearer k")
    event = documents.misp_bodies(head).first().body
    assert list(push.misp(base, [event], "k")) == ["created 9"]
    with pytest.raises(push.PushError, match="HTTP 500"):
        list(push.misp(base, [event], "k"))
    server.shutdown()
    server.server_close()
    with pytest.raises(push.PushError):
        list(push.misp(base, [event], "k"))
    monkeypatch.delenv("MISP_API_KEY", raising=False)
    with pytest.raises(push.PushError, match="MISP_API_KEY"):
        list(push.misp(base, []))


def test_grounding(spark, result):
    groups, entities = I.alert_groups(result.members), I.entities(result.members)
    found = {r.id: r for r in grounding.evidence(groups).collect()}
    title, host = found["E1"].line.split(" | ")[4], found["E1"].line.split(" | ")[2].removeprefix("host=")
    other = next(r for r in found.values() if "10.66.6.6" not in r.words)
    good = {"text": f"{title} on {host}", "evidence": ["E1"]}
    bad = [{"text": "No proof", "evidence": []}, {"text": "x", "evidence": ["E99"]}, {"text": "Isolate FS-UNKNOWN-9 and 9.9.9.9, T9999", "evidence": ["E1"]}, {"text": " ", "evidence": []}, {"text": "dc1.corp.local was asked from 10.66.6.6.", "evidence": [other.id]}]
    verified, gaps = grounding.analyse(groups, entities, lambda *_: {"executive_summary": [good], "containment": bad, "gaps": "none"})
    rows = verified.orderBy("no").collect()
    assert grounding.score(verified).first() == (1, 5) and len(rows[3].problems) == 3 and rows[4].problems == ["address 10.66.6.6 isn't in the cited evidence"]
    assert gaps == "none" and "unverified" in grounding.markdown(rows, gaps) and "cites nothing" in grounding.html_section(rows)
    names = spark.createDataFrame([("ann lee", "account"), ("srv1", "host")], "name string, what string")
    claims = grounding.claims_of(spark, {"containment": [{"text": "Ann Lee used srv1.corp.local, not srv10", "evidence": ["E1"]}]})
    assert grounding.verify(claims, spark.createDataFrame([("E1", "nothing")], "id string, words string"), names).first().problems == ["account ann lee isn't in the cited evidence", "host srv1 isn't in the cited evidence"]


def test_benchmark(spark, tmp_path):
    folder = tmp_path / "cache" / "own"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text("\n".join(map(json.dumps, recording())))
    (folder / "b.json").write_text(json.dumps({"EventID": 4624, "TimeCreated": "2025-01-01"}))
    (folder / "c.json").write_text("broken")
    (folder / "zip_a.json").write_text("\n".join(map(json.dumps, recording())))
    entries = [{"source": "own", "path": "x/a.json", "expect": ["ll-0003", "ll-9999"]}, {"source": "own", "path": "b.json", "benign": True}, {"source": "own", "path": "c.json"}, {"source": "own", "path": "none.json"}, {"source": "own", "path": "zip.zip", "benign": True}, {"source": "own", "path": "a.json", "campaign": "day"}]
    manifest = tmp_path / "manifest.yml"
    manifest.write_text(json.dumps({"samples": entries}))
    judged, fired = benchmark.run(spark, pack(), manifest)
    judged = Tables(spark, "judged").put(judged)
    rows = judged.orderBy("place").collect()
    assert [r.status for r in rows] == ["MISS", "clean", "ERROR", "ERROR", "FALSE POSITIVE"] and rows[0].missed == ["ll-9999"] and rows[0].fired == rows[4].fired and rows[0].events == len(recording())
    assert "ll-s001" in rows[0].fired and {r.rule_id: r.bench_hits for r in benchmark.evidence(fired).collect()}["ll-0003"] == 2
    assert benchmark.summary(judged).asDict() == {"attack_samples": 1, "attack_samples_detected": 1, "labelled_expectations": 2, "labelled_hits": 1, "benign_samples": 2, "benign_with_fp": 1, "errors": 2}
    assert "lacks ll-9999" in benchmark.console(judged) and "| a.json |" in benchmark.markdown(judged)
    campaigns = benchmark.campaigns(spark, pack(), manifest)
    assert campaigns["day"]["sequences"] == ["ll-s001"]
    benchmark.save(judged, tmp_path / "h", "v/1", 10, {}, campaigns, now=T0)
    benchmark.save(judged.withColumn("alerting", F.when(F.col("place") == 0, F.array(F.lit("new"))).otherwise(F.col("alerting"))), tmp_path / "h", "v2", 10, {}, now=T0 + dt.timedelta(days=1))
    runs = benchmark.history(spark, tmp_path / "h")
    dates = [r.generated for r in runs.collect()]
    changed = {tuple(r) for r in benchmark.compare(runs, *dates).collect()}
    assert ("regression", "a.json", "ll-0003") in changed and ("new", "a.json", "new") in changed and "new: a.json new" in benchmark.trend_page(runs)
    assert benchmark.rules_version(tmp_path) == "unknown"


def test_sql_functions(spark):
    from lanternlog.functions.entities import register

    register(spark)
    row = spark.sql("select ll_fix_mojibake('RenÃ©') a, ll_norm_entity('CORP\\\\\\\\Ann@x', false) b, ll_norm_entity('H1.corp.local', true) c, ll_norm_entity('10.0.0.1', true) d, ll_canon_hex(' 0x000A ') e, length(ll_uuid5('x')) f").first()
    assert tuple(row) == ("René", "ann", "h1", "10.0.0.1", "0xa", 36)
