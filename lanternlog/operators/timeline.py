"""Mixed time texts to instants: all readings of each value, chosen by Viterbi over each source's record order.

Every value gets the arrays of its valid readings: form, instant and cost. A
reading that contradicts what the source declares (its zone, its order of day
and month, the earlier instant of a repeated wall-clock time) costs AGAINST;
a source that declares nothing leaves its readings alike. Along the records of
a source a switch of form costs SWITCH and a step back in time BACK.

The record order of a source is cut into blocks of equally many records. Each
block gives the cheapest cost from every reading of its first record to every
reading of its last (a min-plus matrix); a source's matrices, a row a block,
are chained, which fixes the readings at the blocks' ends; then each block is
solved between its ends. That is exact whatever the texts are, and no task
holds a source. AGAINST is more than any two transitions cost, so where a
source declares its reading that is what the path takes; where it declares
nothing, the transitions decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lanternlog.functions.timetext import CANONICAL, readings as text_readings
from lanternlog.operators.ranges import bounds, numbered
from lanternlog.session import Tables

SWITCH, BACK, BLOCK = 3, 5, 1 << 16
UNKNOWN = 1 << 40


READINGS = "cand_us array<bigint>, cand_form array<int>, cand_cost array<int>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, *values = text_readings(batch["text"], batch["_tz"], batch["_date_order"])
        at = pa.array(offsets, pa.int32())
        lists = [pa.ListArray.from_arrays(at, pa.array(v, t)) for v, t in zip(values, (pa.int64(), pa.int32(), pa.int32()))]
        own = [batch[c] for c in ("src", "row_id", "field", "source", "text")]
        yield pa.RecordBatch.from_arrays([*own, *lists], ["src", "row_id", "field", "source", "text", "cand_us", "cand_form", "cand_cost"])


def readings(long: DataFrame, sources: DataFrame) -> DataFrame:
    """long (src, row_id, field, source, text) with cand_us, cand_form, cand_cost.

    sources: source, tz, date_order; a source listed twice counts once. A text
    that names no instant (null, empty, words, impossible dates) has empty
    arrays. Unknown zones and a missing source declare nothing; local times
    then read as UTC. Extra columns are dropped.
    """
    declared = sources.groupBy(F.col("source").alias("_source")).agg(F.min_by("tz", F.struct("tz", "date_order")).alias("_tz"), F.min_by("date_order", F.struct("tz", "date_order")).alias("_date_order"))
    rows = long.join(declared, F.col("source") == F.col("_source"), "left")
    rows = rows.select("src", F.col("row_id").cast("long").alias("row_id"), "field", "source", "text", "_tz", "_date_order")
    return rows.mapInArrow(_read, f"src string, row_id long, field string, source string, text string, {READINGS}")


def viterbi(us: np.ndarray, form: np.ndarray, cost: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The chosen reading of each record of one ordered chunk.

    Matrices of records x readings, padded; count: readings of each record,
    1 or more. Stretches between records with one reading are decoupled, so
    step t is made for the t-th record of all stretches at once.
    """
    n, k = us.shape
    pick = np.zeros(n, np.int64)
    if n == 0 or k == 1:
        return pick
    padded = np.arange(k)[None, :] >= count[:, None]
    total = np.where(padded, UNKNOWN, cost).astype(np.int64)
    back = np.zeros((n, k), np.int8)
    single = count == 1
    index = np.arange(n)
    place = index - np.maximum.accumulate(np.where(single, index, -1))  # 0 at an anchor
    order = np.argsort(place, kind="stable")
    starts = np.searchsorted(place[order], np.arange(1, place.max() + 2))

    def step(now: np.ndarray) -> None:
        now = now[now > 0]
        if not len(now):
            return
        was = now - 1
        move = total[was][:, :, None] + SWITCH * (form[was][:, :, None] != form[now][:, None, :]) + BACK * (us[was][:, :, None] > us[now][:, None, :])
        back[now] = move.argmin(1)
        total[now] = np.minimum(total[now] + move.min(1), UNKNOWN)

    for t in range(len(starts) - 1):
        step(order[starts[t] : starts[t + 1]])
    ends = np.flatnonzero(single)
    # the step into an anchor decides the stretch before it; it costs the anchor's own path nothing
    into = ends[ends > 0]
    if len(into):
        was = into - 1
        move = total[was][:, :, None] + SWITCH * (form[was][:, :, None] != form[into][:, None, :]) + BACK * (us[was][:, :, None] > us[into][:, None, :])
        back[into] = move.argmin(1)
    # back from the last record of each stretch
    last = np.zeros(n, bool)
    last[n - 1] = True
    last[into - 1] = True
    follow = np.flatnonzero(last & ~single)
    pick[n - 1] = total[n - 1].argmin()
    pick[into - 1] = back[into, 0]
    pick[single] = 0
    while len(follow):
        before = follow - 1
        keep = before >= 0
        follow, before = follow[keep], before[keep]
        pick[before] = np.where(single[before], 0, back[follow, pick[follow]])
        follow = before[~single[before]]
    return pick


def _matrices(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(the records of a block in order, instants, forms, costs, readings of each)."""
    table = table.take(pa.array(np.argsort(table["row_id"].to_numpy(), kind="stable")))
    lists = table["cand_us"].combine_chunks()
    starts = lists.offsets.to_numpy()
    count = np.diff(starts)
    k = int(count.max(initial=1))
    at = np.minimum(starts[:-1, None] + np.arange(k)[None, :], max(starts[-1] - 1, 0))
    us, form, cost = (table[name].combine_chunks().values.to_numpy(zero_copy_only=False)[at].astype(np.int64) for name in ("cand_us", "cand_form", "cand_cost"))
    return table, us, form, cost, count


def _move(us: np.ndarray, form: np.ndarray, a: int, b: int) -> np.ndarray:
    """Costs of the transitions between the readings of two records."""
    return SWITCH * (form[a][:, None] != form[b][None, :]) + BACK * (us[a][:, None] > us[b][None, :])


def ends(us: np.ndarray, form: np.ndarray, cost: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The cheapest cost from each reading of the first record to each of the last, up to one constant.

    Between two records with one reading all paths cost the same, so only the
    stretches before the first and behind the last of them are walked.
    """
    n, k = us.shape
    cost = np.where(np.arange(k)[None, :] >= count[:, None], UNKNOWN, cost)

    def walk(a: int, b: int) -> np.ndarray:
        total = np.full((k, k), UNKNOWN)
        np.fill_diagonal(total, cost[a])
        for i in range(a + 1, b + 1):
            total = np.minimum((total[:, :, None] + _move(us, form, i - 1, i)[None]).min(1) + cost[i][None, :], UNKNOWN)
        return total

    single = np.flatnonzero(count == 1)
    if not len(single):
        return walk(0, n - 1)
    head, tail = walk(0, single[0])[:, :1], walk(single[-1], n - 1)[:1]
    return np.minimum(head + tail, UNKNOWN)


_KEYS = ["src", "field", "source"]
_STATE = "src string, field string, source string, _block long, first_us array<bigint>, first_form array<bigint>, last_us array<bigint>, last_form array<bigint>, move array<bigint>"
_PICKS = "src string, field string, source string, _block long, first_pick int, last_pick int"


def _states(table: pa.Table) -> pa.Table:
    table, us, form, cost, count = _matrices(table)
    values = [[x.tolist()] for x in (us[0], form[0], us[-1], form[-1], ends(us, form, cost, count).ravel())]
    keys = [table[c].slice(0, 1) for c in (*_KEYS, "_block")]
    return pa.Table.from_arrays([*keys, *(pa.array(v, pa.list_(pa.int64())) for v in values)], [*_KEYS, "_block", "first_us", "first_form", "last_us", "last_form", "move"])


def _chain(table: pa.Table) -> pa.Table:
    """The readings at the ends of each block of a source on its cheapest path; a row a block."""
    table = table.sort_by("_block")
    rows = table.select(["first_us", "first_form", "last_us", "last_form", "move"]).to_pylist()
    best, trace = None, []
    for i, row in enumerate(rows):
        us, form = np.array(row["first_us"]), np.array(row["first_form"])
        move = np.array(row["move"]).reshape(len(us), -1)
        if best is None:
            enter, came = np.zeros(len(us), np.int64), np.full(len(us), -1)
        else:
            last_us, last_form = np.array(rows[i - 1]["last_us"]), np.array(rows[i - 1]["last_form"])
            cross = best[:, None] + SWITCH * (last_form[:, None] != form[None, :]) + BACK * (last_us[:, None] > us[None, :])
            enter, came = cross.min(0), cross.argmin(0)
        total = np.minimum(enter[:, None] + move, UNKNOWN)
        trace.append((total.argmin(0), came))
        best = total.min(0)
        best = best - best.min()
    at, picks = int(best.argmin()), []
    for first, came in reversed(trace):
        picks.append((int(first[at]), at))
        at = int(came[first[at]])
    picks.reverse()
    out = table.select([*_KEYS, "_block"])
    return out.append_column("first_pick", pa.array([p[0] for p in picks], pa.int32())).append_column("last_pick", pa.array([p[1] for p in picks], pa.int32()))


def _solve(records: pa.Table, picks: pa.Table) -> pa.Table:
    """The cheapest path of one block between the readings chosen for its ends."""
    table, us, form, cost, count = _matrices(records)
    for row, name in ((0, "first_pick"), (-1, "last_pick")):
        chosen = picks[name][0].as_py()
        cost[row, np.arange(cost.shape[1]) != chosen] = UNKNOWN
    pick = viterbi(us, form, cost, count)
    return table.append_column("utc_us", pa.array(us[np.arange(len(us)), pick])).select(["src", "row_id", "field", "text", "utc_us"])


def resolve(long: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """src, row_id, field, text, utc_us of every value that names an instant.

    long: src, row_id (unique integer in src, the record order, dense or
    sparse), field, source, text. Equal times, repeated rows and late rows are
    ordinary records. Values that name no instant are left out. The readings
    are written once to the shared folder.
    """
    cuts = bounds(long.select("row_id"), "row_id", block)
    rows = numbered(readings(long, sources).where(F.size("cand_us") > 0), "row_id", cuts, "_block")
    rows = Tables(long.sparkSession, "times").put(rows)
    keys = [*_KEYS, "_block"]
    states = rows.select("src", "field", "source", "_block", "row_id", "cand_us", "cand_form", "cand_cost").groupBy(*keys).applyInArrow(_states, _STATE)
    picks = states.groupBy(*_KEYS).applyInArrow(_chain, _PICKS)
    schema = "src string, row_id long, field string, text string, utc_us long"
    return rows.groupBy(*keys).cogroup(picks.groupBy(*keys)).applyInArrow(_solve, schema)


def long_values(df: DataFrame, src: str, row_id: str, fields: list[str], source: str) -> DataFrame:
    """One row a non-null time value."""
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    return df.select(F.lit(src).alias("src"), F.col(row_id).cast("long").alias("row_id"), F.col(source).alias("source"), F.inline(entries)).where(F.col("text").isNotNull())


def found(resolved: DataFrame) -> DataFrame:
    """Of resolved values, those not written in the canonical form."""
    return resolved.where(~F.col("text").rlike(CANONICAL)).select("src", "row_id", "field", "utc_us")
