"""Threshold bursts: greedy, non-overlapping, without holding a group in one task.

From an event, the burst is all events of the group within the window after
it; if it is large enough it is emitted and the walk goes on behind it, else
with the next event. The walk is sequential, but from any position it is a
function: position -> where the walk leaves a chunk. So

1. hits are written once and cut into ranges of equally many by time; an
   event's number in its group is the group's events in the ranges before, by
   prefix sums, and its rank inside its own;
2. what lies in an event's window is the number of the last event up to its
   end, found in the same ranges by the same sums; distinct values are counted
   in buckets as wide as the window, each seeing its successor's events too;
3. chunks of a group of equal size compute their exit for every entry, by
   doubling of jumps, stored as few intervals, as walks soon fall together;
4. a group's chunks are chained over these intervals alone;
5. each chunk walks once more from its true entry and emits its bursts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lanternlog.operators.batches import by_groups, codes
from lanternlog.operators.ranges import bounds, numbered
from lanternlog.session import Tables

CHUNK, WIDTH = 1 << 15, 1 << 16
_EXITS = "rule_no int, burst_key string, chunk long, lo long, hi long, exit long"
_STARTS = "rule_no int, burst_key string, n long, size long"


def _steps(table: pa.Table, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(steps, where each leads, the last position of the group if it leads out of it): of positions in a table of whole groups."""
    size, enough = (table[c].to_numpy(zero_copy_only=False) for c in ("size", "enough"))
    step = np.where(enough.astype(bool), size, 1)
    at = np.arange(len(step))
    end = np.searchsorted(group, group, "right")
    return step, np.where(at + step < end, at + step, at), end


def leaves(to: np.ndarray) -> np.ndarray:
    """The position at which the walk from each position ends, one that leads to itself."""
    while not np.array_equal(after := to[to], to):
        to = after
    return to


def visited(to: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The positions that the walks from some positions stop at, in order, by jumps of 1, 2, 4, ... steps."""
    levels = [to]
    while not np.array_equal(after := levels[-1][levels[-1]], levels[-1]):
        levels.append(after)
    at = np.unique(entries)
    for level in reversed(levels):
        at = np.unique(np.concatenate([at, level[at]]))
    return at


def distinct_in_windows(value: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The number of distinct values in [i, end_i) for every i.

    A value counts where it comes first in its window, that is where it came
    last before i. Of the places before end_i such are those whose value came
    last before i, less the i places before the window; they are counted over
    sorted blocks of 1, 2, 4, ... places.
    """
    size = len(value)
    order = np.lexsort((np.arange(size), value))
    before = np.full(size, -1)
    same = value[order[1:]] == value[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    index, found, far = np.arange(size), np.zeros(size, np.int64), size + 2
    for level in range(int(size).bit_length()):
        width = 1 << level
        padded = np.concatenate([before, np.full(-size % width, size)]).reshape(-1, width)
        laid = (np.sort(padded, 1) + 1 + np.arange(len(padded))[:, None] * far).ravel()
        use = (end >> level) & 1 == 1
        block = (end[use] >> (level + 1)) * 2
        found[use] += np.searchsorted(laid, index[use] + 1 + block * far) - block * width
    return found - index


def _exits(table: pa.Table, group: np.ndarray) -> pa.Table:
    """For every entry into a chunk, where the walk leaves it: intervals of entries with one exit."""
    n = table["n"].to_numpy()
    step, to, _ = _steps(table, group)
    last = leaves(to)
    out = n[last] + step[last]
    new = np.ones(len(n), bool)
    new[1:] = (out[1:] != out[:-1]) | (group[1:] != group[:-1])
    first = np.flatnonzero(new)
    hi = n[np.concatenate([first[1:], [len(n)]]) - 1]
    kept = table.select(["rule_no", "burst_key", "chunk"]).take(pa.array(first))
    return pa.Table.from_arrays([*kept.columns, pa.array(n[first]), pa.array(hi), pa.array(out[first])], ["rule_no", "burst_key", "chunk", "lo", "hi", "exit"])


def _key(table: pa.Table, rows: int) -> list[pa.Array]:
    return [pa.array([table["rule_no"][0].as_py()] * rows, pa.int32()), pa.array([table["burst_key"][0].as_py()] * rows, pa.string())]


def _chain(table: pa.Table) -> pa.Table:
    """The true entry into each chunk of a group."""
    rows = sorted(zip(*(table[c].to_pylist() for c in ("chunk", "lo", "hi", "exit"))))
    at, entries = 0, []
    for chunk, lo, hi, leave in rows:
        if lo <= at <= hi:
            entries.append((chunk, at))
            at = leave
    return pa.Table.from_arrays([*_key(table, len(entries)), pa.array([e[0] for e in entries], pa.int64()), pa.array([e[1] for e in entries], pa.int64())], ["rule_no", "burst_key", "chunk", "entry"])


def _walk(table: pa.Table, group: np.ndarray) -> pa.Table:
    _, to, _ = _steps(table, group)
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    entries = start + table["entry"].to_numpy()[start] - table["n"].to_numpy()[start]
    # an entry behind the end of its chunk is none
    entries = entries[(entries < len(to)) & (group[np.minimum(entries, len(to) - 1)] == group[start])]
    at = visited(to, entries)
    at = at[table["enough"].to_numpy(zero_copy_only=False).astype(bool)[at]]
    return table.select(["rule_no", "burst_key", "n", "size"]).take(pa.array(at))


def ends_of_windows(us: np.ndarray, window: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The position behind the last row of each one's window, inside its group; rows are sorted by group and time."""
    low, widest = us.min(initial=0), int(window.max(initial=0))
    span = int(us.max(initial=0) - low) + widest + 2
    if span * (int(group.max(initial=0)) + 1) < 2**62:
        place = group * span + (us - low)
        return np.searchsorted(place, place + window, "right")
    return np.concatenate([a + np.searchsorted(us[a:z], us[a:z] + window[a:z], "right") for a, z in zip(*(lambda s: (s, [*s[1:], len(us)]))(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))))])


def _distinct(table: pa.Table, group: np.ndarray) -> pa.Table:
    """Whether enough distinct values lie in each own event's window, over a bucket and its successor."""
    us, own, window, least = (table[c].to_numpy(zero_copy_only=False) for c in ("us", "own", "_window", "_least"))
    value = codes(table["burst_value"])
    many = distinct_in_windows(group * (value.max(initial=0) + 1) + value, ends_of_windows(us, window, group)) >= least
    mine = pa.array(own.astype(bool))
    return table.select(["rule_no", "burst_key", "n"]).append_column("many", pa.array(many)).filter(mine)


def bursts(hits: DataFrame, specs: list[tuple[int, int, int, bool]], chunk: int = CHUNK, width: int = WIDTH) -> DataFrame:
    """rule_no, start_ts, end_ts, actor, host, source, event_rids, targets of each burst.

    hits: as of rule_hits, ordered in a group by (TimeCreated, _rid). specs:
    rule_no, least count, window in microseconds (inclusive), whether distinct
    burst_values are counted. A missing group field is the group "". Events of
    equal time ahead in the order are not in a later event's window.
    """
    spark = hits.sparkSession
    plan = F.broadcast(spark.createDataFrame(specs, "rule_no int, _least int, _window long, _distinct boolean"))  # a row a rule
    keys = ["rule_no", "burst_key"]
    rows, seen = Tables(spark, "bursts").put_seen(hits.where("TimeCreated is not null").join(plan, "rule_no").withColumn("us", F.unix_micros("TimeCreated")), n=F.count(F.lit(1)))
    cuts = bounds(rows.select("us"), "us", width, rows=seen["n"])
    rows = numbered(rows, "us", cuts)
    # number in the group
    per = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(*keys).orderBy("_part")
    before = per.withColumn("_before", F.coalesce(F.sum("_n").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("us", "_rid")))
    rows = ranked.join(before, [*keys, "_part"]).withColumn("n", F.col("_before") + F.col("_rank") - 1)
    # the last event in each one's window: ends of windows laid among the events
    marks = rows.select(*keys, "us", F.lit(1).alias("_event"), F.lit(None).cast("long").alias("n")).unionAll(rows.select(*keys, (F.col("us") + F.col("_window")).alias("us"), F.lit(0).alias("_event"), "n"))
    marks = numbered(marks, "us", cuts)
    inside = Window.partitionBy(*keys, "_part").orderBy("us", F.desc("_event")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = marks.groupBy(*keys, "_part").agg(F.sum("_event").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    laid = marks.withColumn("_up_to", F.sum("_event").over(inside)).where("_event = 0").join(counted, [*keys, "_part"])
    sized = laid.select(*keys, "n", (F.col("_before") + F.col("_up_to") - F.col("n")).alias("size")).join(plan, "rule_no")
    sized = sized.select(*keys, "n", "size", "_distinct", (F.col("size") >= F.col("_least")).alias("enough"))
    if any(s[3] for s in specs):
        bucket = F.floor(F.col("us") / (F.col("_window") + 1))
        both = F.explode(F.array(F.struct(bucket.alias("b"), F.lit(True).alias("own")), F.struct((bucket - 1).alias("b"), F.lit(False).alias("own")))).alias("_at")
        wide = rows.where("_distinct").select(*keys, "us", "n", "burst_value", "_window", "_least", both).select("*", "_at.b", "_at.own").drop("_at")
        kinds = by_groups(wide, [*keys, "b"], ["n"], _distinct, "rule_no int, burst_key string, n long, many boolean")
        sized = sized.join(kinds, [*keys, "n"], "left").withColumn("enough", F.when(F.col("_distinct"), F.col("many")).otherwise(F.col("enough")))
    sized = sized.select(*keys, "n", "size", "enough", F.floor(F.col("n") / chunk).alias("chunk"))
    exits = by_groups(sized, [*keys, "chunk"], ["n"], _exits, _EXITS)
    entries = exits.groupBy(*keys).applyInArrow(_chain, "rule_no int, burst_key string, chunk long, entry long")
    starts = by_groups(sized.join(entries, [*keys, "chunk"]), [*keys, "chunk"], ["n"], _walk, _STARTS)
    members = starts.select(*keys, F.col("n").alias("start"), F.explode(F.sequence(F.col("n"), F.col("n") + F.col("size") - 1)).alias("n"))
    place = F.struct("n")
    return rows.join(members, [*keys, "n"]).groupBy(*keys, "start").agg(
        F.min("TimeCreated").alias("start_ts"), F.max("TimeCreated").alias("end_ts"), *[F.min_by(c, place).alias(c) for c in ("actor", "host", "source")],
        F.transform(F.array_sort(F.collect_list(F.struct("n", "_rid"))), lambda x: x["_rid"]).alias("event_rids"), F.sort_array(F.collect_set("target")).alias("targets"))
