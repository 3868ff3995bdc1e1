import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lanternlog.operators import components, coverage, processes, suppression
from lanternlog.operators import incidents as I
from lanternlog.plans.rulebook import rule_of

T0 = dt.datetime(2025, 1, 1)
SCHEMA = "det_id long, rule_id string, title string, kind string, level string, kill_chain string, techniques array<string>, start_ts timestamp, end_ts timestamp, actor string, host string, source string, event_rids array<long>, extra_entities array<struct<kind:string,value:string>>, targets array<string>, risk int"


def det(i, minutes=0, rule="r", level="medium", kind="signature", phase="Execution", techniques=("T1",), last=0, actor="a", host="h", source="", extra=(), targets=(), risk=None):
    start = T0 + dt.timedelta(minutes=minutes)
    return (i, rule, rule.upper(), kind, level, phase, list(techniques), start, start + dt.timedelta(minutes=last), actor, host, source, [i], list(extra), list(targets), risk)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def groups(pairs, ids):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("window, seed", [(30, 1), (120, 2), (360, 3)])
def test_incidents_equal_all_pairs(spark, window, seed):
    rng = random.Random(seed)
    rows = [det(i * 11 - 40, rng.randint(0, 2000), last=rng.choice([0, 5, 400]), actor=rng.choice(["a", "D\\A", "b", "-", ""]), host=rng.choice(["h1", "H1.x", "h2", None]), source=rng.choice(["10.0.0.1", None])) for i in range(60)]
    got = {r.det_id: r.incident_id for r in I.correlate(frame(spark, rows), window * 60_000_000).collect()}
    keys = lambda r: {("a", r[9].lower().split("\\")[-1])} * (r[9] not in ("", "-")) if False else {k for k in (("a", r[9].lower().split("\\")[-1]) if r[9] not in ("", "-") else None, ("h", r[10].lower().split(".")[0]) if r[10] else None, ("s", r[11]) if r[11] else None) if k}
    pairs = [(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and keys(a) & keys(b) and a[7] <= b[7] and (b[7] - a[8]) <= dt.timedelta(minutes=window)]
    assert got == groups(pairs, [r[0] for r in rows])


def test_components_of_a_long_chain_and_large_ids(spark):
    ids = [(-1) ** i * (i * 2**55 + i) for i in range(100)]
    edges = spark.createDataFrame(list(zip(ids, ids[1:])) + [(7, 8), (8, 7), (9, 9)], "u long, v long")
    got = {r.id: r.component for r in components.components(edges).collect()}
    assert {got[i] for i in ids} == {min(ids)} and got[8] == 7 and got[9] == 9
    assert {r.id: r.component for r in components.components(edges, components.ONE_TASK).collect()} == got
    assert components.components(edges.limit(0)).count() == 0


def test_summary_and_risk(spark):
    rows = [
        det(1, 5, "ra", "informational", phase="Impact", techniques=[]), det(2, 10, "rb", "medium", phase="Discovery", techniques=["T2"], targets=["t1"]), det(3, 10, "rc", "high", phase="Initial Access", techniques=["T1", "T2"], actor="X\\a"),
        det(4, 12, "rs", "critical", "sequence", phase="Impact", techniques=["T9"], extra=[("actor", "other")]), det(5, 13, "rn", "medium", "anomaly", phase="Lateral Movement", techniques=["T3"], source="10.0.0.1"),
    ]
    members = frame(spark, rows).withColumn("incident_id", F.lit(1).cast("long"))
    row = I.summarize(members).first()
    assert row.phases == ["Initial Access", "Discovery", "Lateral Movement", "Impact"]
    assert row.score == int(1 + 4 + 7 + 15 + 2 + 5 * 4) and row.severity == "Critical" and row.confidence.startswith("High")
    assert row.techniques == ["T1", "T2", "T3", "T9"] and row.targeted == ["t1"] and row.accounts == ["X\\a", "a", "other"]
    risk = {(r.kind, r.norm): r for r in I.entity_risk(members).collect()}
    assert risk["actor", "a"].score == 10 + 40 + 70 + 150 + 20 and risk["actor", "a"].flagged
    assert risk["source", "10.0.0.1"].score == 20 and not risk["source", "10.0.0.1"].flagged
    assert I.summarize(members.limit(0)).count() == 0
    only_low = frame(spark, [det(1, 0, level="low", phase="Execution"), det(2, 1, level="informational", phase="Impact")]).withColumn("incident_id", F.lit(1))
    assert I.summarize(only_low).first().phases == ["Execution", "Impact"]


def test_groups_and_co_occurrence(spark):
    rows = [det(1, 0, host="h.x", actor="a"), det(2, 9, host="H", actor="b", last=3), det(3, 1, rule="q", host=None), det(4, 2, actor="D\\b", host="h", extra=[("actor", "b")])]
    members = frame(spark, rows).withColumn("incident_id", F.lit(1))
    got = {(r.rule_id, r.host_key): (r.n, r.actors) for r in I.alert_groups(members).collect()}
    assert got == {("r", "h"): (3, ["D\\b", "a", "b"]), ("q", ""): (1, ["a"])}
    pairs = {(r.norm_a, r.norm_b): r.n for r in I.co_occurrence(frame(spark, rows)).collect()}
    assert pairs["b", "h"] == 2 and pairs["h", "a"] == 1  # one count a detection, whatever the spellings


def test_suppression(spark, tmp_path):
    path = tmp_path / "s.yml"
    suppression.add(path, "r", {"host": "H*"}, "known", "30d")
    suppression.add(path, "*", {}, "all")
    suppression.add(path, "R", {"Image": "*\\ok.exe"}, "by title", allow_critical=True)
    sups = suppression.load(path)
    assert [s.id for s in sups] == ["s-001", "s-002", "s-003"] and sups[1].problems and sups[0].active()
    (tmp_path / "own.yml").write_text("# kept\nsuppressions:\n  - {id: s-007, rule: r, reason: x}\n")
    suppression.add(tmp_path / "own.yml", "q", {}, "y")
    assert [s.id for s in suppression.load(tmp_path / "own.yml")] == ["s-007", "s-008"] and (tmp_path / "own.yml").read_text().startswith("# kept")
    (tmp_path / "odd.yml").write_text("suppressions: []\nother: [1]\n")
    with pytest.raises(ValueError):
        suppression.add(tmp_path / "odd.yml", "q", {}, "y")
    events = spark.createDataFrame([(1, "c:\\ok.exe"), (2, "C:\\OK.exe"), (3, "c:\\ok.exe"), (4, None)], "_rid long, Image string")
    rows = [det(1, host="h1"), det(2, host="x"), (*det(3, host="x", level="critical"),), det(4, host="x"), det(5, host="h1", level="critical"), det(6, host=None)]
    got = {r.det_id: r.suppressed_by for r in suppression.apply(frame(spark, rows), sups, events).collect()}
    assert got == {1: "s-001", 2: "s-003", 3: "s-003", 4: None, 5: None, 6: None}
    states = {r.id: (r.state, r.n_hidden) for r in suppression.report(sups, suppression.apply(frame(spark, rows), sups)).collect()}
    assert states == {"s-001": ("active", 1), "s-002": ("ignored", 0), "s-003": ("stale", 0)}
    expired = [suppression.Suppression("e", "r", {}, "x", expires="2020-01-01")]
    assert suppression.apply(frame(spark, rows), expired).where("suppressed_by is not null").count() == 0


def test_impact(spark):
    rows = [det(1, 0, "a", host="h1", phase="Initial Access"), det(2, 1, "b", host="h2", phase="Execution"), det(3, 2, "b", host="h2", phase="Execution")]
    base = frame(spark, rows).withColumn("incident_id", F.lit(1))
    hide = lambda *ids: suppression.impact(base.withColumn("suppressed_by", F.when(F.col("det_id").isin(*ids), "s")))
    one = hide(1).first()
    assert one.hides_first and one.hosts_lost == 1 and one.phases_lost == 1 and suppression.verdict(hide(1)) == "RISKY"
    assert suppression.verdict(hide(3)) in ("SAFE", "RISKY") and hide(3).first().hosts_lost == 0
    assert hide(1, 2, 3).first().severity_after == "(incident disappears)"
    assert suppression.verdict(hide(-1)) == "NO EFFECT"


def test_lineage_ends_in_cycles_and_at_depth(spark):
    chain = [(i, dt.datetime(2025, 1, 1), 1, f"P{i}", f"p{i - 1}") for i in range(1, 40)] + [(90, dt.datetime(2025, 1, 1), 1, "c1", "c2"), (91, dt.datetime(2025, 1, 1), 1, "c2", "c1"), (92, dt.datetime(2025, 1, 1), 1, None, "x")]
    events = spark.createDataFrame(chain, "_rid long, TimeCreated timestamp, EventID int, ProcessGuid string, ParentProcessGuid string").withColumns({c: F.lit(None).cast("string") for c in ("Image", "CommandLine", "User", "Computer")})
    index = processes.process_index(events)
    got = processes.ancestors(index, spark.createDataFrame([("p39",), ("c1",), ("none",)], "guid string")).collect()
    assert len([r for r in got if r.guid == "p39"]) == 15 and {r.ancestor for r in got if r.guid == "c1"} == {"c1", "c2"}
    marks = spark.createDataFrame([("p20", "low one", "medium"), ("p22", "bad", "critical"), ("p9", "x", "high"), ("gone", "y", "high")], "guid string, title string, level string")
    tree = processes.process_tree(index, marks, 18).collect()
    guids = [r.guid for r in tree]
    assert len(guids) == 18 and guids[-1] not in ("p22", "p20") and {"p22", "p21"} <= set(guids) and next(r for r in tree if r.guid == "p22").alerts == ["bad"]
    assert all(r.parent in guids[:i] or r.parent not in {x.guid for x in tree} for i, r in enumerate(tree)) and processes.process_tree(index, marks, None).count() > 18
    flagged = processes.flagged_processes(frame(spark, [det(1, rule="x"), det(2, rule="x", level="high"), det(3, level="low")]).withColumn("event_rids", F.array(F.lit(5).cast("long"))), events, index).collect()
    assert [(r.guid, r.level) for r in flagged] == [("p5", "high")] or {r.title for r in flagged} == {"X"}


def viability(spark, doc, channels=(), events=(), fields=()):
    channels = spark.createDataFrame([(c, 5) for c in channels], "channel string, n_events long")
    events = spark.createDataFrame([(e, 5) for e in events], "EventID int, n_events long")
    seen = coverage.Profile(events, channels, spark.createDataFrame([(e, f, 1) for e, f in fields], "EventID int, field string, n_filled long"), 5)
    return coverage.viability(spark, [rule_of({"id": "x", "tags": ["attack.t1001"], **doc})], seen)


def test_coverage(spark):
    doc = {"detection": {"s": {"EventID": 4688, "CommandLine": "a"}, "condition": "s"}, "logsource": {"service": "security"}}
    status = lambda *a, **k: viability(spark, *a, **k).first().status
    assert status(doc, ["system"]) == "DEAD_EVENTS" and status(doc, ["security"]) == "UNOBSERVED"
    dead = viability(spark, doc, ["security"], [4688], [(4688, "Image")])
    row = dead.first()
    assert row.status == "DEAD_FIELDS" and [tuple(m) for m in row.missing_fields] == [(4688, ["CommandLine"])] and "CommandLine" in row.reason
    assert coverage.recommendations(dead).first().action == coverage.FIELD_FIXES[4688, "CommandLine"]
    assert status(doc, ["security"], [4688], [(4688, "commandline")]) == "LIVE"
    assert coverage.coverage_sets(dead).collect() == [("Unmapped", "T1001", "blind")]
    loose = {"detection": {"s": {"CommandLine": "a"}, "condition": "s"}}
    assert status(loose, ["security"], [1], [(1, "Image")]) == "DEAD_FIELDS" and status(loose, ["security"], [1], [(9, "CommandLine")]) == "LIVE"
    two = {"detection": {"s": {"EventID": [1, 4688], "CommandLine": "a"}, "condition": "s"}}
    assert status(two, ["security"], [1, 4688], [(1, "CommandLine")]) == "LIVE" and status(two, ["security"], [4688], [(1, "CommandLine")]) == "DEAD_FIELDS"
    odd = {"detection": {"s": {"EventID": 1}, "condition": "s"}, "logsource": {"service": "my-own"}}
    assert status(odd, ["My Own/Channel"], [1]) == "LIVE" and status(odd, ["other"], [1]) == "DEAD_EVENTS" and status(odd, [], [1]) == "LIVE"
    assert [tuple(r) for r in coverage.recommendations(viability(spark, odd, ["other"])).collect()] == [(1, "Collect the channel of service my-own", ["x"], ["T1001"])]
    assert [(r.tactic, r.techniques) for r in coverage.rule_coverage(spark, [rule_of({"id": "x", "tags": ["attack.t1001", "attack.initial_access"], **odd}), rule_of({"id": "y", "tags": ["attack.t1002"], **odd})]).orderBy("tactic").collect()] == [("Initial Access", ["T1001"]), ("Unmapped", ["T1002"])]


def test_log_health(spark):
    rows = [(h, c, T0 + dt.timedelta(hours=i)) for h in "abc" for c in ("Security", "System") for i in range(40) if not (h == "c" and c == "System") and not (h == "b" and c == "Security" and i > 20)]
    events = spark.createDataFrame(rows, "Computer string, Channel string, TimeCreated timestamp")
    assert [(r.host, r.channel, r.n_have) for r in coverage.missing_sources(events).collect()] == [("C", "system", 2)]
    assert [(r.host, r.channel, r.n_events) for r in coverage.went_silent(events).collect()] == [("B", "security", 21)]
    assert coverage.went_silent(events.limit(0)).count() == 0 and coverage.missing_sources(events.limit(0)).count() == 0


def test_rule_health(spark):
    found = frame(spark, [det(i, rule="loud", host=f"h{i}.x") for i in range(5)])
    live = spark.createDataFrame([("loud", "medium", "LIVE", ""), ("dead", "high", "DEAD_FIELDS", "why"), ("quiet", "low", "LIVE", ""), ("proven", "low", "LIVE", "")], "rule_id string, level string, status string, reason string")
    bench = spark.createDataFrame([("proven", 2)], "rule_id string, bench_hits long")
    got = {r.rule_id: r.verdict for r in coverage.rule_health(found, live, 100, bench).collect()}
    assert got == {"loud": "TUNE", "dead": "DEAD", "quiet": "UNPROVEN", "proven": "TRUST"}
    whys = {r.rule_id: (r.tested, r.why) for r in coverage.rule_health(found, live, 100).collect()}
    assert whys["dead"] == (False, "why") and whys["proven"] == (False, "no recordings were run")
