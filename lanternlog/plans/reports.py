"""Markdown and HTML that people read: of the incidents a report shows, of coverage, of rule health.

All take rows that a report's own limits bound: the shown incidents with their
first alert groups, the entities of highest risk, a tree within its budget.
"""

from __future__ import annotations

import html
from collections.abc import Iterable, Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, Row, functions as F

from lanternlog.operators import incidents as I
from lanternlog.plans import documents

STYLE = "body{font:15px system-ui;margin:2rem}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.3rem .6rem}.Critical{color:#a00}.High{color:#c50}rect{fill:#b4232a}line{stroke:#888}"
SCRIPT = "for(const box of document.querySelectorAll('input.filter'))box.oninput=()=>{for(const r of box.nextElementSibling.rows)if(r.rowIndex)r.hidden=!r.textContent.toLowerCase().includes(box.value.toLowerCase())}"


def shown(members: DataFrame, most: int) -> list[Row]:
    """The heads of the `most` incidents of highest score, a report's limit; only theirs are made."""
    score = I.summarize(members).orderBy(F.desc("score"), "start_ts", "incident_id").limit(most).select("incident_id")
    some = members.join(score, "incident_id", "left_semi")
    return documents.heads(some).orderBy(F.desc("score"), "start_ts", "incident_id").collect()


def markdown(rows: Sequence[Row], heading: str = "Incidents") -> str:
    parts = [f"# {heading}\n"]
    for place, row in enumerate(rows, 1):
        parts.append(f"## {place}. {row.severity}: {' -> '.join(row.phases)}\n\n{row.description}\n\n| Entity | Kind | Risk | Techniques |\n|---|---|---|---|")
        parts.extend(f"| {e.value} | {e.type} | {e.score} | {', '.join(e.techniques)} |" for e in (row.entity_risk or [])[: documents.ENTITIES])
        parts.append("")
    return "\n".join(parts)


def cell(value: object) -> str:
    return html.escape(str(value).replace("‮", "[U+202E]"))


def table(head: Iterable[str], rows: Iterable[Iterable[object]], filtered: bool = False) -> str:
    line = lambda tag, values: "<tr>" + "".join(f"<{tag}>{v if isinstance(v, Markup) else cell(v)}</{tag}>" for v in values) + "</tr>"
    return ("<input class=filter placeholder=Filter>" if filtered else "") + "<table>" + line("th", head) + "".join(line("td", r) for r in rows) + "</table>"


class Markup(str):
    """Text that is HTML already."""


def swimlane(groups: Sequence[Row], width: int = 1200) -> str:
    """Alert groups over time, a lane a host in order of its first alert, a bar from a group's first to its last alert."""
    if not groups:
        return ""
    lanes = {host: i for i, host in enumerate(dict.fromkeys(g.host_key or "unknown" for g in groups))}
    start, end = min(g.first_at for g in groups), max(g.last_at for g in groups)
    scale = (width - 160) / max((end - start).total_seconds(), 1.0)
    x = lambda at: 130 + (at - start).total_seconds() * scale
    bars = (f"<rect x='{x(g.first_at):.0f}' y='{25 + 40 * lanes[g.host_key or 'unknown']}' width='{max(6, x(g.last_at) - x(g.first_at)):.0f}' height='10'><title>{cell(f'{g.first_at:%H:%M:%S} {g.title} x{g.n}')}</title></rect>" for g in groups)
    names = (f"<text x='5' y='{34 + 40 * i}'>{cell(host)}</text>" for host, i in lanes.items())
    return f"<svg width='{width}' height='{40 * len(lanes) + 40}' role='img'>{''.join(names)}{''.join(bars)}</svg>"


def graph(edges: Sequence[Row], width: int = 900) -> str:
    """Sources, accounts and hosts in three columns, joined by their edges."""
    columns: dict[str, list[str]] = {"source": [], "actor": [], "host": []}
    for e in edges:
        for key in (e.from_key, e.to_key):
            own = columns[key.split(":", 1)[0]]
            if key not in own:
                own.append(key)
    at = {key: (20 + i * width // 3, 30 + 28 * j) for i, own in enumerate(columns.values()) for j, key in enumerate(own)}
    lines = "".join(f"<line x1='{at[e.from_key][0] + 150}' y1='{at[e.from_key][1] - 4}' x2='{at[e.to_key][0] - 6}' y2='{at[e.to_key][1] - 4}' stroke-width='{min(6, e.n_techniques)}'/>" for e in edges)
    names = "".join(f"<text x='{x}' y='{y}'>{cell(key.split(':', 1)[1][:24])}</text>" for key, (x, y) in at.items())
    return f"<svg width='{width}' height='{60 + 28 * max(map(len, columns.values()))}' role='img'>{lines}{names}</svg>" if edges else ""


def tree(rows: Sequence[Row]) -> str:
    """Processes nested under their parents; alerting ones with their alerts."""
    known, below = {r.guid for r in rows}, {}
    for r in rows:
        below.setdefault(r.parent if r.parent in known and r.parent != r.guid else None, []).append(r)

    def items(parent: str | None, seen: frozenset) -> str:
        own = [r for r in below.get(parent, []) if r.guid not in seen]
        return "<ul>" + "".join(f"<li>{cell(r.image)} {cell(r.command)}{' <b>' + cell('; '.join(r.alerts)) + '</b>' if r.alerts else ''}{items(r.guid, seen | {r.guid})}</li>" for r in own) + "</ul>" if own else ""

    return items(None, frozenset())


def html_page(rows: Sequence[Row], queries: Mapping[str, Mapping[str, str]] | None = None, edges: Mapping[int, Sequence[Row]] | None = None, processes: Sequence[Row] = (), heading: str = "Incidents") -> str:
    """queries: rule id to its texts by language; edges: incident to its graph; processes: rows of a process tree."""
    queries, edges, body = queries or {}, edges or {}, []
    for row in rows:
        groups = row.groups or []
        told = lambda g: Markup("".join(f"<details><summary>{cell(k)}</summary><pre>{cell(v)}</pre></details>" for k, v in queries.get(g.rule_id, {}).items()))
        alerts = table(["First", "Last", "Severity", "Alert", "Host", "Count", "Queries"], ([f"{g.first_at:%Y-%m-%d %H:%M:%S}", f"{g.last_at:%Y-%m-%d %H:%M:%S}", g.level, g.title, g.host_key, g.n, told(g)] for g in groups), True)
        more = f"<p>{row.n_groups - len(groups)} more alert groups</p>" if row.n_groups and row.n_groups > len(groups) else ""
        risks = table(["Entity", "Kind", "Risk"], ([e.value, e.type, e.score] for e in (row.entity_risk or [])[: documents.ENTITIES]))
        body.append(f"<h2 class='{row.severity}'>{cell(row.title)}</h2>{swimlane(groups)}{alerts}{more}{risks}{graph(edges.get(row.incident_id, []))}")
    if processes:
        body.append("<h2>Processes</h2>" + tree(processes))
    return f"<!doctype html><meta charset=utf-8><title>{cell(heading)}</title><style>{STYLE}</style><h1>{cell(heading)}</h1>{''.join(body)}<script>{SCRIPT}</script>"


# ---- coverage and health ----


def coverage_markdown(viability: DataFrame, fixes: DataFrame, verify: DataFrame, sets: DataFrame, top: int = 20) -> str:
    """Statuses, techniques by tactic, the first actions that revive rules and the first things to verify."""
    status = {r.status: r.n for r in viability.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    lines = ["# Telemetry coverage", "", *(f"- {s}: {status.get(s, 0)}" for s in ("LIVE", "UNOBSERVED", "DEAD_EVENTS", "DEAD_FIELDS")), "", "| Tactic | Live | Unverified | Blind |", "|---|---|---|---|"]
    per = sets.groupBy("tactic").pivot("kind", ["live", "unverified", "blind"]).agg(F.count(F.lit(1))).na.fill(0).orderBy("tactic")
    lines += [f"| {r.tactic} | {r.live} | {r.unverified} | {r.blind} |" for r in per.collect()]
    for actions in (fixes, verify):
        lines += ["", "| Action | Rules | New techniques |", "|---|---|---|"]
        lines += [f"| {r.action} | {len(r.rules)} | {', '.join(r.techniques)} |" for r in actions.orderBy("place").limit(top).collect()]
    return "\n".join(lines) + "\n"


def coverage_page(sets: DataFrame, text: str) -> str:
    """A grid of techniques by tactic, coloured by what is known of them, before the text."""
    colours = {"live": "#cfe8cf", "unverified": "#fdf3c0", "blind": "#f6caca"}
    columns: dict[str, list[Row]] = {}
    for r in sets.orderBy("tactic", "technique").collect():  # a row a tactic and technique
        columns.setdefault(r.tactic, []).append(r)
    cells = "".join(f"<td valign=top><b>{cell(t)}</b>" + "".join(f"<div style='background:{colours[r.kind]}'>{cell(r.technique)}</div>" for r in own) + "</td>" for t, own in columns.items())
    return f"<!doctype html><meta charset=utf-8><title>Coverage</title><style>{STYLE}</style><table><tr>{cells}</tr></table><pre>{cell(text)}</pre>"


def health_markdown(rows: Sequence[Row], events: int) -> str:
    place = {v: i for i, v in enumerate(["TUNE", "DEAD", "UNPROVEN", "TRUST"])}
    told = sorted((r for r in rows if r.alerts or r.verdict != "UNPROVEN"), key=lambda r: (place[r.verdict], -r.alerts, r.rule_id))
    body = (f"| {r.verdict} | {r.rule_id} | {r.alerts} | {r.per_million:.1f} | {r.hosts} | {r.why} |" for r in told)
    return "\n".join(["# Rule health", "", f"{len(rows)} rules on {events} events.", "", "| Verdict | Rule | Alerts | Per million | Hosts | Why |", "|---|---|---|---|---|---|", *body, ""])


# ---- files ----


def write(path: Path, text: str) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def write_array(path: Path, bodies: Iterable[str]) -> int:
    """JSON texts as one array, streamed."""
    path.parent.mkdir(parents=True, exist_ok=True)
    count = 0
    with path.open("w", encoding="utf-8") as file:
        file.write("[")
        for body in bodies:
            file.write((",\n" if count else "\n") + body)
            count += 1
        file.write("\n]\n")
    return count


def write_incidents(path: Path, head: DataFrame, members: DataFrame) -> int:
    """Every incident with its detections inside; partitions come to the driver one by one."""
    parts = documents.incident_bodies(head).select("incident_id", F.lit(0).alias("kind"), F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("long").alias("det_id"), "body")
    dets = documents.detection_bodies(members).select("incident_id", F.lit(1).alias("kind"), F.col("start_ts").alias("at"), "det_id", "body")
    count = 0
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", encoding="utf-8") as file:
        file.write("[")
        for r in parts.unionAll(dets).orderBy("incident_id", "kind", "at", "det_id").toLocalIterator():
            if r.kind == 0:
                file.write(("\n]}," if count else "") + "\n" + r.body[:-1] + ', "detections": [')
                count, inside = count + 1, False
            else:
                file.write((",\n" if inside else "\n") + r.body)
                inside = True
        file.write(("\n]}" if count else "") + "\n]\n")
    return count


def write_bundle(path: Path, objects: DataFrame, bundle_id: str) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", encoding="utf-8") as file:
        file.write(f'{{"type": "bundle", "id": "bundle--{bundle_id}", "objects": [')
        for i, r in enumerate(objects.orderBy("id").toLocalIterator()):
            file.write((",\n" if i else "\n") + r.body)
        file.write("\n]}\n")


def write_pages(folder: Path, pages: DataFrame) -> int:
    """A file an entity, and an index by risk."""
    folder.mkdir(parents=True, exist_ok=True)
    count = 0
    with (folder / "index.html").open("w", encoding="utf-8") as index:
        index.write(f"<!doctype html><meta charset=utf-8><title>Entities</title><style>{STYLE}</style><h1>Entities</h1><ul>")
        for r in pages.orderBy(F.desc("risk"), "kind", "norm").toLocalIterator():
            (folder / r.file).write_text(r.body, encoding="utf-8")
            index.write(f"<li><a href='{r.file}'>{cell(r.norm)}</a>: {r.risk}</li>")
            count += 1
        index.write("</ul>")
    return count
