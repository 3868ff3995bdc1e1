import datetime as dt
import itertools
import zoneinfo

import numpy as np
import pyarrow as pa
import pytest

from lanternlog.functions import timetext
from lanternlog.operators import timeline


def first(text, tz=None, order=None):
    offsets, us, _, cost = timetext.readings(pa.array([text]), pa.array([tz], pa.string()), pa.array([order], pa.string()))
    return int(us[0]) if offsets[1] and cost[0] < timetext.AGAINST else None


def at(*args, micro=0):
    return int(dt.datetime(*args, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000 + micro


@pytest.mark.parametrize(
    "text, tz, order, want",
    [
        ("2025-01-31T08:00:00.000000Z", "Europe/Berlin", "dmy", at(2025, 1, 31, 8)),
        ("2025-01-31T08:00:00.1234567Z", None, None, at(2025, 1, 31, 8, micro=123456)),
        ("2025-01-31 08:00:00", "Europe/Berlin", "dmy", at(2025, 1, 31, 7)),
        ("2025-01-31 08:00:00", None, None, at(2025, 1, 31, 8)),
        ("  2025-01-31T08:00:00+0545 ", None, None, at(2025, 1, 31, 2, 15)),
        ("2025-10-15 02:43:50 UTC-05:00", "Asia/Tokyo", None, at(2025, 10, 15, 7, 43, 50)),
        ("03/04/2025 05:06:07", "UTC", "dmy", at(2025, 4, 3, 5, 6, 7)),
        ("03/04/2025 05:06:07", "UTC", "mdy", at(2025, 3, 4, 5, 6, 7)),
        ("2025/03/04 05:06:07", "UTC", "dmy", at(2025, 3, 4, 5, 6, 7)),
        ("3/4/2025 12:06:07 AM", "UTC", "mdy", at(2025, 3, 4, 0, 6, 7)),
        ("3/4/2025 12:06:07 PM", "UTC", "mdy", at(2025, 3, 4, 12, 6, 7)),
        ("15.10.2025 02:01:02,010", "UTC", "mdy", at(2025, 10, 15, 2, 1, 2, micro=10_000)),
        ("15 Oct 2025 06:22:54 CEST", "Europe/Berlin", None, at(2025, 10, 15, 4, 22, 54)),
        ("15 Oct 2025 06:22:54 IST", "Asia/Kolkata", None, at(2025, 10, 15, 0, 52, 54)),
        ("15 Oct 2025 06:22:54 CST", "America/Chicago", None, at(2025, 10, 15, 12, 22, 54)),
        ("Wed, 15 Oct 2025 03:57:48 +0100", None, None, at(2025, 10, 15, 2, 57, 48)),
        ("Sat Nov  1 05:13:30 2025 GMT", "Asia/Tokyo", None, at(2025, 11, 1, 5, 13, 30)),
        ("2025-10-15T10:00:15[Europe/London]", "Asia/Tokyo", None, at(2025, 10, 15, 9, 0, 15)),
        ("20251015T033039Z", None, None, at(2025, 10, 15, 3, 30, 39)),
        ("1760490685", None, None, 1760490685_000_000),
        ("1760511257867", None, None, 1760511257867_000),
        ("134049677731389464", None, None, 134049677731389464 // 10 - 11644473600000000),
        ("/Date(1760508954906)/", None, None, 1760508954906_000),
        # a repeated wall-clock time is the earlier instant, unless the text tells
        ("2025-10-26 02:30:00", "Europe/Berlin", None, at(2025, 10, 26, 0, 30)),
        ("26 Oct 2025 02:30:00 CET", "Europe/Berlin", None, at(2025, 10, 26, 1, 30)),
        # inside a gap the offset before it
        ("2025-03-30 02:30:00", "Europe/Berlin", None, at(2025, 3, 30, 1, 30)),
        ("2024-02-29 00:00:00", "UTC", None, at(2024, 2, 29)),
        *((bad, "UTC", "dmy", None) for bad in (None, "", "  ", "-", "null", "N/A", "pending", "0000-00-00 00:00:00", "2025-13-41T25:61:00Z", "31/02/2025 10:00:00", "2025-02-29 00:00:00", "2025-01-01 24:00:00", "2025-01-01T00:00:60Z", "13/13/2025 1:00:00", "15 Oct 2025 06:22:54 XYZ", "2025-01-01T00:00:00[Mars/Base]", "x" * 100_000)),
    ],
)
def test_readings(text, tz, order, want):
    assert first(text, tz, order) == want


def test_local_times_of_every_zone_against_zoneinfo():
    """Brute force: hourly wall-clock times over two changes in each zone."""
    for tz in ("Europe/Berlin", "America/New_York", "Australia/Sydney", "Australia/Lord_Howe", "America/Sao_Paulo", "Asia/Kathmandu", "Europe/London"):
        zone = zoneinfo.ZoneInfo(tz)
        walls = [dt.datetime(2025, m, 1) + dt.timedelta(minutes=30 * i) for m in (3, 4, 10, 11) for i in range(48 * 30)]
        offsets, us, _, _ = timetext.readings(pa.array([f"{w:%Y-%m-%d %H:%M:%S}" for w in walls]), pa.array([tz] * len(walls)), pa.array([None] * len(walls), pa.string()))
        got = us[offsets[:-1]]
        early = [int(w.replace(tzinfo=zone, fold=0).timestamp() * 1e6) for w in walls]
        assert got.tolist() == early


def brute(us, form, cost, count):
    best = None
    for path in itertools.product(*(range(c) for c in count)):
        total = sum(cost[i][p] for i, p in enumerate(path))
        for i in range(1, len(path)):
            a, b = path[i - 1], path[i]
            total += timeline.SWITCH * (form[i - 1][a] != form[i][b]) + timeline.BACK * (us[i - 1][a] > us[i][b])
        best = total if best is None else min(best, total)
    return best


def test_viterbi_finds_the_cheapest_path():
    rng = np.random.default_rng(3)
    for _ in range(150):
        n, k = int(rng.integers(1, 8)), 3
        count = rng.integers(1, k + 1, n)
        us, form, cost = rng.integers(0, 6, (n, k)), rng.integers(0, 3, (n, k)), rng.integers(0, 8, (n, k))
        pick = timeline.viterbi(us, form, cost, count)
        assert (pick < count).all()
        got = sum(cost[i][p] for i, p in enumerate(pick)) + sum(timeline.SWITCH * int(form[i - 1][pick[i - 1]] != form[i][pick[i]]) + timeline.BACK * int(us[i - 1][pick[i - 1]] > us[i][pick[i]]) for i in range(1, n))
        assert got == brute(us, form, cost, count)


def test_resolve_uses_the_order_where_a_source_declares_nothing(spark):
    rows = [("s", i, "t", None, text) for i, text in enumerate(["2025-03-04T00:00:00Z", "05/03/2025 00:00:00", "06/03/2025 00:00:00", "2025-03-07T00:00:00Z"])]
    long = spark.createDataFrame(rows, "src string, row_id long, field string, source string, text string")
    sources = spark.createDataFrame([("c", "UTC", "dmy"), ("c", "UTC", "dmy")], "source string, tz string, date_order string")
    got = {r.row_id: r.utc_us for r in timeline.resolve(long, sources).collect()}
    assert got[1] == at(2025, 3, 5) and got[2] == at(2025, 3, 6)


def test_blocks_change_nothing(spark):
    """Chunks cut at anchors give what one chunk gives."""
    texts = ["2025-03-04T00:00:00Z", "05/03/2025 00:00:00", "2025-03-05 10:00:00", "07/03/2025 00:00:00", "junk", None]
    rows = [("s", i, "t", None if i % 3 else "c", texts[i % 6]) for i in range(60)]
    long = spark.createDataFrame(rows, "src string, row_id long, field string, source string, text string")
    sources = spark.createDataFrame([("c", "America/New_York", "mdy")], "source string, tz string, date_order string")
    whole, cut = (sorted(map(tuple, timeline.resolve(long, sources, b).collect())) for b in (1 << 16, 4))
    assert whole == cut and len({r[1] for r in whole}) == len(whole) == 40


def test_empty_and_extra_columns(spark):
    long = spark.createDataFrame([], "src string, row_id long, field string, source string, text string, tz string")
    sources = spark.createDataFrame([], "source string, tz string, date_order string, extra int")
    assert timeline.resolve(long, sources).count() == 0


def test_transitions_decide_where_nothing_is_declared(spark):
    """Planted: a source that never declares its order of day and month, in texts that all have two readings, over many blocks."""
    days = [dt.datetime(2025, 3, 1) + dt.timedelta(days=i, hours=i) for i in range(12)] + [dt.datetime(2025, 4, 1) + dt.timedelta(days=i) for i in range(12)]
    for order in ("%d/%m/%Y", "%m/%d/%Y"):
        rows = [("s", i * 1_000_003, "t", "x", at_.strftime(f"{order} %H:%M:%S")) for i, at_ in enumerate(days)]
        long = spark.createDataFrame(rows, "src string, row_id long, field string, source string, text string")
        none = spark.createDataFrame([], "source string, tz string, date_order string")
        for block in (1 << 16, 5, 1):
            got = {r.row_id: r.utc_us for r in timeline.resolve(long, none, block).collect()}
            assert [got[i * 1_000_003] for i in range(len(days))] == [int(d.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6) for d in days], (order, block)


def test_chained_blocks_cost_what_the_cheapest_path_costs():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n, k = int(rng.integers(1, 8)), 3
        count = rng.integers(1, k + 1, n)
        us, form, cost = rng.integers(0, 6, (n, k)), rng.integers(0, 3, (n, k)), rng.integers(0, 8, (n, k))
        lists = lambda m: [m[i, : count[i]].tolist() for i in range(n)]
        table = pa.table({"src": ["s"] * n, "field": ["f"] * n, "source": [None] * n, "text": ["t"] * n, "row_id": list(range(n)), "_block": [i // 2 for i in range(n)], "cand_us": lists(us), "cand_form": lists(form), "cand_cost": lists(cost)})
        blocks = [table.slice(i, 2) for i in range(0, n, 2)]
        picks = timeline._chain(pa.concat_tables([timeline._states(pa.Table.from_batches(b.combine_chunks().to_batches())) for b in blocks]))
        solved = pa.concat_tables([timeline._solve(b.combine_chunks(), picks.slice(i, 1)) for i, b in enumerate(blocks)])["utc_us"].to_pylist()
        paths = [[p for p in range(count[i]) if us[i, p] == solved[i]] for i in range(n)]
        costs = [sum(cost[i][p] for i, p in enumerate(path)) + sum(timeline.SWITCH * int(form[i - 1][path[i - 1]] != form[i][path[i]]) + timeline.BACK * int(us[i - 1][path[i - 1]] > us[i][path[i]]) for i in range(1, n)) for path in itertools.product(*paths)]
        assert min(costs) == brute(us, form, cost, count)


def test_null_and_repeated_rows(spark):
    rows = [("s", None, "t", None, "2025-01-01 00:00:00"), ("s", 1, "t", None, "2025-01-01 00:00:00"), ("s", 1, "t", None, "2025-01-01 00:00:00"), (None, 2, None, "x", "05/03/2025 00:00:00"), ("s", 3, "t", "", ""), ("s", 4, "t", None, None)]
    long = spark.createDataFrame(rows, "src string, row_id long, field string, source string, text string")
    none = spark.createDataFrame([("x", None, None), (None, "UTC", "dmy")], "source string, tz string, date_order string")
    for block in (1, 1 << 16):
        got = sorted(((r.row_id or 0), r.utc_us) for r in timeline.resolve(long, none, block).collect())
        assert [g[0] for g in got] == [0, 1, 1, 2]
