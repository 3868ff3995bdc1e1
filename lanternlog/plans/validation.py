"""Lint of rules, and their embedded cases run as one table."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from lanternlog.operators.hits import detections
from lanternlog.operators.sequences import sequence
from lanternlog.plans.rulebook import LEVELS, Join, Not, Of, Ref, Rule, RuleError
from lanternlog.plans.transpile import LANGUAGES, Unsupported, transpile
from lanternlog.session import Tables

START = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
#: So far apart that no window of a rule spans two cases.
APART = dt.timedelta(days=366)


@dataclass
class Result:
    rule: Rule
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    passed: int = 0
    failed: int = 0


def names_used(tree: object) -> set[str]:
    if isinstance(tree, Ref):
        return {tree.name}
    if isinstance(tree, Not):
        return names_used(tree.part)
    return set().union(*map(names_used, tree.parts)) if isinstance(tree, Join) else set()


def empty_quantifiers(tree: object, names: list[str]) -> bool:
    import fnmatch

    if isinstance(tree, Of):
        return not any(fnmatch.fnmatchcase(n, tree.pattern) for n in names)
    return any(empty_quantifiers(p, names) for p in (tree.parts if isinstance(tree, Join) else [tree.part] if isinstance(tree, Not) else []))


def lint(rule: Rule, registry: dict[str, Rule]) -> Result:
    out = Result(rule)
    for bad, text in ((rule.level not in LEVELS, f"level {rule.level!r} isn't one"), (not rule.techniques, "no technique tag")):
        if bad:
            out.errors.append(text)
    for bad, text in ((not rule.description, "no description"), ("kill_chain" not in rule.meta, "no kill chain phase"), (not rule.tests.get("match"), "no case that must match"), (not rule.tests.get("nomatch"), "no case that must not match")):
        if bad:
            out.warnings.append(text)
    if rule.kind == "sequence":
        steps = rule.meta["sequence"]["steps"]
        for step in steps:
            ids = step.get("rule", [])
            out.errors += [f"step {step['id']!r} names no known rule: {i}" for i in (ids if isinstance(ids, list) else [ids]) if i not in registry]
        known = {s["id"] for s in steps}
        out.errors += [f"join side {side!r} names no step" for pair in rule.meta["sequence"].get("join", []) for side in pair if side.split(".", 1)[0] not in known]
        return out
    try:
        tree = rule.condition
        if missing := names_used(tree) - set(rule.selections):
            out.errors.append(f"undefined selections: {', '.join(sorted(missing))}")
        if empty_quantifiers(tree, list(rule.selections)):
            out.errors.append("a quantifier over no selection")
    except RuleError as e:
        out.errors.append(str(e))
        return out
    for language in LANGUAGES:
        try:
            transpile(rule, language)
        except (Unsupported, RuleError) as e:
            out.warnings.append(f"no {language.upper()} text: {e}")
    return out


def case_events(rules: list[Rule]) -> tuple[list[tuple], list[tuple[int, str, str, int]]]:
    """(event rows: rid, case, time, event id, values as JSON; cases: number, rule id, kind, place)."""
    rows, cases = [], []
    for rule in rules:
        for kind in ("match", "nomatch"):
            for place, case in enumerate(rule.tests.get(kind) or [], 1):
                number = len(cases)
                cases.append((number, rule.id, kind, place))
                for i, given in enumerate(case if isinstance(case, list) else [case]):
                    event = {"Computer": "testhost", **given}
                    at = START + APART * (number % 4000) + dt.timedelta(seconds=event.pop("_offset", i))
                    values = {k: str(v) for k, v in event.items() if v is not None and k not in ("EventID", "TimeCreated")}
                    rows.append((len(rows), number, at, int(event["EventID"]) if "EventID" in event else None, json.dumps(values)))
    return rows, cases


def run_cases(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """rule_id, kind, place, fired, passed of every embedded case. Cases are years apart, so all run as one table."""
    rows, cases = case_events(rules)
    raw = spark.createDataFrame(rows, "_rid long, case_no int, TimeCreated timestamp, EventID int, v string")
    values = F.from_json("v", "map<string,string>")
    events = raw.select("_rid", "case_no", "TimeCreated", "EventID", *[values[c].alias(c) for c in ("Channel", "Computer", "_platform")], values.alias("fields"))
    tables = Tables(spark, "cases")
    events = tables.put(events)
    signatures = [r for r in rules if r.kind == "signature"]
    found = tables.put(detections(events.drop("case_no"), signatures))
    fired = found.select("rule_id", F.explode("event_rids").alias("_rid"))
    for rule in rules:
        if rule.kind == "sequence":
            fired = fired.unionByName(sequence(rule, found, events.drop("case_no")).select("rule_id", F.explode("event_rids").alias("_rid")))
    by_case = fired.join(events.select("_rid", "case_no"), "_rid").select("rule_id", "case_no").distinct().withColumn("fired", F.lit(True))
    table = spark.createDataFrame(cases, "case_no int, rule_id string, kind string, place int")
    out = table.join(by_case, ["rule_id", "case_no"], "left").withColumn("fired", F.coalesce("fired", F.lit(False)))
    return out.select("rule_id", "kind", "place", "fired", (F.col("fired") == (F.col("kind") == "match")).alias("passed"))


def validate(spark: SparkSession, rules: list[Rule]) -> list[Result]:
    registry = {r.id: r for r in rules}
    results = {r.id: lint(r, registry) for r in rules}
    for row in run_cases(spark, rules).collect():
        out = results[row.rule_id]
        if row.passed:
            out.passed += 1
        else:
            out.failed += 1
            out.errors.append(f"{row.kind}[{row.place}] {'fired' if row.fired else 'did not fire'}")
    return list(results.values())
