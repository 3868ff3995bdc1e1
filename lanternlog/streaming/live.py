"""Streams: stateless alerts as a plan, and the stateful engine over micro-batches.

The plan alone serves what one event decides. Bursts, sequences and incidents
need the window behind them: the engine keeps that window, the alerts already
given and the incidents' severities as tables in the shared folder, replaced
once a batch. Given a folder of its own, a new driver goes on from the last
batch, and a batch that is delivered again counts once.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from lanternlog.operators import incidents as I
from lanternlog.operators.hits import DETECTION, detections
from lanternlog.operators.sequences import sequences
from lanternlog.plans.rulebook import ALERT_LEVELS, Rule, with_level
from lanternlog.session import Tables, read_text, write_text

DEDUPE = ["rule_id", "start_ts", "host", "actor"]
SEVERITIES = ["Low", "Medium", "High", "Critical"]


def stream_alerts(stream: DataFrame, rules: list[Rule], late: str = "6 hours", least: str = "medium") -> DataFrame:
    """Alerts of stateless rules over a stream of events, each (rule, time, host, actor) once within the watermark."""
    plain = with_level([r for r in rules if r.kind == "signature" and not r.threshold], least)
    return detections(stream, plain).withWatermark("start_ts", late).dropDuplicatesWithinWatermark(DEDUPE)


def tumbling_counts(stream: DataFrame, width: str = "1 hour", late: str = "6 hours") -> DataFrame:
    """Events a channel and time bin."""
    return stream.withWatermark("TimeCreated", late).groupBy(F.window("TimeCreated", width).alias("w"), "Channel").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start_ts"), "Channel", "n")


@dataclass
class Engine:
    """Micro-batches to announcements; the horizon never goes back, and what is behind it is forgotten.

    folder: where the state is kept, so that a new driver goes on where the
    last one ended; without one it is kept while this driver lives. The state
    is a few tables and one small file that names them, replaced as a whole
    once a batch.
    """

    spark: SparkSession
    rules: list[Rule]
    window: dt.timedelta = dt.timedelta(hours=6)
    least: str = "medium"
    folder: str | None = None
    counters: dict[str, int] = field(default_factory=lambda: {"events": 0, "alerts": 0, "incidents": 0})

    STATE = ("events", "stateless", "given", "severity")

    def __post_init__(self) -> None:
        self.tables = Tables(self.spark, "engine", self.folder)
        self.events: DataFrame | None = None
        self.stateless: DataFrame | None = None
        self.given: DataFrame | None = None
        self.severity: DataFrame | None = None
        self.horizon: dt.datetime | None = None
        self.batch, self.said, self.old = -1, [], []
        if self.folder and (text := read_text(self.spark, f"{self.folder}/state.json")):
            kept = json.loads(text)
            for name, path in kept["tables"].items():
                df = self.spark.read.parquet(path)
                df._lanternlog_path = path
                setattr(self, name, df)
            self.horizon, self.batch, self.said, self.counters = dt.datetime.fromisoformat(kept["horizon"]), kept["batch"], kept["said"], kept["counters"]

    def _swap(self, name: str, df: DataFrame) -> DataFrame:
        """Tables that are replaced go once the file no longer names them."""
        old, new = getattr(self, name), self.tables.put(df)
        setattr(self, name, new)
        self.old.append(old)
        return new

    def _settle(self, batch_id: int | None, said: list[str]) -> None:
        self.batch, self.said = self.batch if batch_id is None else batch_id, said
        if self.folder:
            tables = {n: getattr(self, n)._lanternlog_path for n in self.STATE if getattr(self, n) is not None}
            write_text(self.spark, f"{self.folder}/state.json", json.dumps({"batch": self.batch, "said": said, "horizon": self.horizon.isoformat(), "counters": self.counters, "tables": tables}))
        for old in self.old:
            self.tables.drop(old)
        self.old = []

    def ingest(self, batch: DataFrame, batch_id: int | None = None) -> list[str]:
        """Process one batch of events (with _rid); returns what there is to say, in time order.

        A batch that comes again, as after a lost driver, changes nothing: of
        the last one what was said is said again, of earlier ones nothing.
        """
        if batch_id is not None and batch_id <= self.batch:
            return self.said if batch_id == self.batch else []
        batch, top = self.tables.put_seen(batch, t=F.max("TimeCreated"), n=F.count(F.lit(1)))
        if not top["n"]:
            self.tables.drop(batch)
            return []
        self.counters["events"] += top["n"]
        behind = top["t"] - self.window
        self.horizon = behind if self.horizon is None else max(self.horizon, behind)
        live = F.col("TimeCreated") >= F.lit(self.horizon)
        window = self._swap("events", (batch if self.events is None else self.events.unionByName(batch)).where(live))
        plain = [r for r in self.rules if r.kind == "signature" and not r.threshold]
        fresh = detections(batch, plain)
        held = self._swap("stateless", fresh if self.stateless is None else self.stateless.where(F.col("end_ts") >= F.lit(self.horizon)).unionByName(fresh))
        self.tables.drop(batch)
        bursts = [r for r in self.rules if r.kind == "signature" and r.threshold]
        found = held if not bursts else held.unionByName(detections(window, bursts))
        sequenced = sequences(self.rules, found, window)
        every = self.tables.put((found if sequenced is None else found.unionByName(sequenced)).select(*DETECTION))
        new = every if self.given is None else every.join(self.given, DEDUPE, "left_anti")
        new = self.tables.put(new.dropDuplicates(DEDUPE))
        levels = [r.level for r in with_level(self.rules, self.least)]
        host, actor = (F.coalesce(F.nullif(c, F.lit("")), F.lit("-")) for c in ("host", "actor"))
        line = F.format_string("ALERT %s %s %s host=%s actor=%s", F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss"), "level", "title", host, actor)
        out = [r.line for r in new.where(F.col("level").isin(levels)).orderBy("start_ts", "det_id").select(line.alias("line")).toLocalIterator()]
        self.counters["alerts"] += len(out)
        keep = new.select(*DEDUPE) if self.given is None else self.given.where(F.col("start_ts") >= F.lit(self.horizon - self.window)).unionByName(new.select(*DEDUPE))
        self._swap("given", keep)
        out += self._incidents(every)
        self.tables.drop(new)
        self.tables.drop(every)
        self._settle(batch_id, out)
        return out

    def _incidents(self, every: DataFrame) -> list[str]:
        """Incidents that opened or rose; an incident is known by its first alert."""
        members = self.tables.put(every.join(I.correlate(every, int(self.window.total_seconds() * 1e6)), "det_id"))
        alerting = members.where(F.col("level").isin(ALERT_LEVELS)).select("incident_id").distinct()
        first = members.groupBy("incident_id").agg(F.min_by(F.struct(*DEDUPE), F.struct("start_ts", "det_id")).alias("key"))
        now = I.summarize(members).join(alerting, "incident_id", "left_semi").join(first, "incident_id")
        rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
        now = self.tables.put(now.select("key", "severity", rank.alias("rank"), "n_detections", "phases", "start_ts"))
        was = self.severity if self.severity is not None else now.select("key", "severity", "rank").limit(0)
        old = was.select(F.col("key").alias("_key"), F.col("severity").alias("before"), F.col("rank").alias("_rank"))
        rose = now.join(old, now["key"].eqNullSafe(old["_key"]), "left").where(F.col("_rank").isNull() | (F.col("rank") > F.col("_rank")))
        how = F.when(F.col("before").isNull(), "opened").otherwise(F.concat(F.lit("escalated from "), "before"))
        line = F.format_string("INCIDENT %s %s: %d detections, %s", "severity", how, "n_detections", F.array_join("phases", " -> "))
        rows = rose.orderBy("start_ts").select(line.alias("line"), F.col("before").isNull().alias("fresh")).collect()
        keep = now.select("key", "severity", "rank").unionByName(was).where(F.col("key.start_ts") >= F.lit(self.horizon - self.window)).groupBy("key").agg(F.max_by("severity", "rank").alias("severity"), F.max("rank").alias("rank"))
        self._swap("severity", keep)
        self.tables.drop(now)
        self.tables.drop(members)
        self.counters["incidents"] += sum(r.fresh for r in rows)
        return [r.line for r in rows]


def replay_steps(events: DataFrame, step: dt.timedelta) -> list[DataFrame]:
    """A recording as batches, one a step of its clock; empty steps are left out. Only the steps' numbers come to the driver."""
    start = events.agg(F.min("TimeCreated")).first()[0]
    if start is None:
        return []
    width = int(step.total_seconds() * 1e6)
    number = F.floor((F.unix_micros("TimeCreated") - F.unix_micros(F.lit(start))) / width)
    laid = events.withColumn("_step", number)
    steps = sorted(r[0] for r in laid.select("_step").distinct().collect())
    return [laid.where(F.col("_step") == n).drop("_step") for n in steps]


def announce(lines: list[str], path: str | Path | None, echo: Callable[[str], object] = print) -> None:
    for line in lines:
        echo(line)
    if path and lines:
        with open(path, "a", encoding="utf-8") as file:
            file.writelines(json.dumps({"time": dt.datetime.now(dt.timezone.utc).isoformat(), "message": line}) + "\n" for line in lines)


def watch(stream: DataFrame, engine: Engine, checkpoint: str, alerts_file: str | None = None, every: str | None = None, echo: Callable[[str], object] = print, shape: Callable[[DataFrame], DataFrame] = lambda batch: batch):
    """Run the engine over a stream; without `every` over what is there now. shape makes events of a batch. Returns the query."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: announce(engine.ingest(shape(batch), number), alerts_file, echo))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
