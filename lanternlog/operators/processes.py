"""Process lineage: an index of processes, and the ancestors of those that raised alerts."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, functions as F

from lanternlog.functions.entities import level_rank
from lanternlog.plans.rulebook import ALERT_LEVELS
from lanternlog.session import Tables

DEPTH, BUDGET = 15, 260
GUID_FIELDS = ["ProcessGuid", "SourceProcessGuid", "SourceProcessGUID"]


def process_index(events: DataFrame) -> DataFrame:
    """guid, parent, image, command, user, host, started: the last creation event of each process."""
    rows = events.where((F.col("EventID") == 1) & (F.col("ProcessGuid") != ""))
    at = F.struct("TimeCreated", "_rid")
    pick = lambda c, n: F.max_by(F.coalesce(c, F.lit("")), at).alias(n)
    return rows.groupBy(F.lower("ProcessGuid").alias("guid")).agg(F.max_by(F.lower(F.coalesce("ParentProcessGuid", F.lit(""))), at).alias("parent"), pick("Image", "image"), pick("CommandLine", "command"), pick("User", "user"), pick("Computer", "host"), F.max_by("TimeCreated", at).alias("started"))


def flagged_processes(found: DataFrame, events: DataFrame, index: DataFrame) -> DataFrame:
    """guid, title, level: the alerts of each process, medium and higher; a detection's event counts by the first of its GUID fields that is a known process."""
    rows = found.where(F.col("level").isin(ALERT_LEVELS)).select("det_id", "title", "level", F.explode("event_rids").alias("_rid"))
    named = [f for f in GUID_FIELDS if f in events.columns]
    guids = F.array_compact(F.array(*[F.struct(F.lit(i).alias("place"), F.lower(f).alias("guid")) for i, f in enumerate(named)]))
    asked = rows.join(events.select("_rid", guids.alias("g")), "_rid").select("det_id", "_rid", "title", "level", F.inline("g")).where("guid <> ''")
    met = asked.join(index.select("guid"), "guid", "left_semi").groupBy("det_id", "_rid", "title", "level").agg(F.min_by("guid", "place").alias("guid"))
    return met.groupBy("guid", "title").agg(F.max_by("level", level_rank(F.col("level"))).alias("level"))


def ancestors(index: DataFrame, start: DataFrame, depth: int = DEPTH) -> DataFrame:
    """guid, ancestor, depth: each start and its known ancestors, at most `depth` processes in a line. A line ends where it comes round.

    start: guid. One join a generation, on the frontier alone; each is written,
    so a lost executor costs one generation.
    """
    tables = Tables(index.sparkSession, "lineage")
    parents = tables.put(index.select(F.col("guid").alias("ancestor"), "parent"))
    line = tables.put(start.select("guid").distinct().join(parents, F.col("guid") == F.col("ancestor")).select("guid", "ancestor", "parent", F.lit(1).alias("depth"), F.array("ancestor").alias("seen")))
    parts = [line]
    for _ in range(depth - 1):
        up = parents.select(F.col("ancestor").alias("_a"), F.col("parent").alias("_p"))
        line = tables.put(line.join(up, F.col("parent") == F.col("_a")).where(~F.array_contains("seen", F.col("_a"))).select("guid", F.col("_a").alias("ancestor"), F.col("_p").alias("parent"), (F.col("depth") + 1).alias("depth"), F.array_append("seen", F.col("_a")).alias("seen")))
        if line.isEmpty():
            break
        parts.append(line)
    return functools.reduce(DataFrame.unionByName, parts).select("guid", "ancestor", "depth")


def process_tree(index: DataFrame, flagged: DataFrame, budget: int = BUDGET, depth: int = DEPTH) -> DataFrame:
    """guid, parent, image, command, user, host, started, level, alerts: the alerting processes and their ancestors, the gravest first, at most `budget` nodes.

    flagged: guid, title, level. A node ranks by the gravest process below it
    and goes behind its ancestors, so no shown node lacks a shown parent. The
    budget is what a person can read; without it (None) the tree is whole.
    """
    alerts = flagged.groupBy("guid").agg(F.max_by("level", level_rank(F.col("level"))).alias("level"), F.sort_array(F.collect_set("title")).alias("alerts"))
    lines = ancestors(index, alerts, depth).join(alerts.select("guid", level_rank(F.col("level")).alias("rank")), "guid")
    place = F.min(F.struct((-F.col("rank")).alias("grave"), F.col("guid").alias("line"), (-F.col("depth")).alias("near")))
    nodes = lines.groupBy("ancestor").agg(place.alias("place"))
    if budget is not None:
        nodes = nodes.orderBy("place").limit(budget)
    out = nodes.select(F.col("ancestor").alias("guid"), "place").join(index, "guid").join(alerts, "guid", "left")
    return out.orderBy("place").select("guid", "parent", "image", "command", "user", "host", "started", "level", F.coalesce("alerts", F.array().cast("array<string>")).alias("alerts"))
