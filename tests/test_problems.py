import collections
import json
import random

import pytest
from pyspark.sql import functions as F

from lanternlog.operators import drift, keychunks, ranges


def test_numbers_are_exact_in_skewed_keys(spark):
    rng = random.Random(1)
    rows = [(i * 7 - 300, rng.choice(["hot"] * 8 + ["a", "b", None])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k string")
    got = collections.defaultdict(list)
    for r in keychunks.number_rows(df, ["k"], "id", width=64, size=10).collect():
        got[r.k].append((r.id, r._number, r._chunk_of_key))
    for k, found in got.items():
        ids = sorted(i for i, x in rows if x == k)
        assert sorted(found) == [(i, n, n // 10) for n, i in enumerate(ids)]


def test_heavy_keys(spark):
    rows = [(1, i, 5 if i < 60 else i, "h" if i % 2 else None, "x") for i in range(100)] + [(None, 500, 1, "z", "x"), (2, 501, None, "", "x")]
    df = spark.createDataFrame(rows, "c long, id long, a int, b string, field string")
    got = {tuple(r) for r in keychunks.heavy_keys(df, "c", ["a", "b"], "id", 20, 16).collect()}
    assert got == {(1, "a", "5", 60), (1, "b", "h", 50), (None, "a", "1", 1), (None, "b", "z", 1), (2, "b", "", 1)}


def test_profile_of_no_rows_and_null_times(spark):
    df = spark.createDataFrame([], "id long, k string, t timestamp")
    assert keychunks.key_profile(df, ["k"], "id", "t").count() == 0
    df = spark.sql("select 1L id, 'k' k, cast(null as timestamp) t union all select 2L, 'k', timestamp'2025-01-01'")
    row = keychunks.key_profile(df, ["k"], "id", "t").collect()
    assert [(r.n_rows, r.max_step_us, r.n_back) for r in row] == [(2, 0, 0)]


NAMES = {"Channel": "Channel", "winlog.channel": "Channel", "channel": "Channel", "EventID": "EventID", "a.b": "Deep"}


def changes(spark, lines, named=True):
    raw = spark.createDataFrame([("f", f, p) for f, p in lines], "feed string, file_no int, payload string")
    return {(r.file_no, r.change_kind, r.field) for r in drift.changes(drift.schemas(raw, spark.createDataFrame(list(NAMES.items()), "spelling string, field string"))).collect() if r.named == named}


def test_drift(spark):
    lines = [
        (1, '{"Channel": "s", "EventID": 1}'), (1, "#end"), (1, ""), (1, None), (1, "[1]"), (1, '{"broken'),
        (2, '﻿{"winlog": {"channel": "s"}, "EventID": "1"}'), (3, '{"winlog.channel": "s", "EventID": null}'),
        (4, '{"channel": {"id": 1}, "a": {"b": true}}'), (5, '{"channel": {"id": 1}, "a.b": 1.5, "EventID": NaN}'), (5, '{"channel": {"id": 1}, "a.b": 1.5}'), (5, '{"channel": {"id": 1}, "a.b": 1.5}'),
    ]
    want = {(2, "renamed", "Channel"), (2, "retyped", "EventID"), (3, "removed", "EventID"), (4, "renamed", "Channel"), (4, "retyped", "Channel"), (4, "added", "Deep"), (5, "retyped", "Deep")}
    assert changes(spark, lines) == want


def test_a_file_without_a_good_line_is_a_file(spark):
    assert changes(spark, [(1, '{"EventID": 1}'), (2, "x"), (3, '{"EventID": 1}')]) == {(2, "removed", "EventID"), (3, "added", "EventID")}
    assert changes(spark, []) == set()


def test_conform_keeps_all(spark):
    raw = spark.createDataFrame([(1, '{"winlog": {"channel": {"id": 7}}, "other": [1], "EventID": 12}', "x"), (2, "broken", "y"), (3, "", None)], "raw_id long, payload string, extra string")
    rows = {r.raw_id: r for r in drift.conform(raw, NAMES, ["raw_id", "extra"]).collect()}
    assert len(rows) == 3 and not rows[2].is_object and rows[1].EventID == "12" and rows[1].EventID__number == 12.0
    assert json.loads(rows[1].Channel) == {"id": 7} and rows[1].Channel__type == "object" and json.loads(rows[1].other_fields) == {"other": [1]}
    with pytest.raises(ValueError):
        drift.conform(raw.withColumnRenamed("extra", "EventID"), NAMES, ["EventID"])


def test_changes_of_paths_that_no_catalog_knows(spark):
    lines = [(1, '{"EventID": 1}'), (2, '{"EventID": 1, "new": {"in": 1}}'), (3, '{"EventID": 1, "new": {"in": "x"}, "other": []}')]
    assert changes(spark, lines, False) == {(2, "added", "new"), (2, "added", "new.in"), (3, "retyped", "new.in"), (3, "added", "other")}


def test_ranges_of_sparse_values_are_even(spark):
    df = spark.range(20_000).select((F.pow(F.col("id"), 2) * 1000003 - 7).cast("long").alias("id"))
    cuts = ranges.bounds(df, "id", 500)
    sizes = [r["count"] for r in ranges.numbered(df, "id", cuts).groupBy("_part").count().collect()]
    assert len(sizes) == 40 and max(sizes) < 700
    one = keychunks.placed(df.withColumn("k", F.lit("hot")), ["k"], "id", 500)
    assert keychunks.key_offsets(one, ["k"]).count() == 40
    got = keychunks.key_counts(df.withColumn("k", F.lit("hot")), ["k"], "id", 500, 300).first()
    assert (got.n_rows, got.n_chunks) == (20_000, 67)
    assert ranges.bounds(df.limit(0), "id", 10) == []


def test_repeated_and_missing_places_in_the_order(spark):
    """Rows of one id, rows without one, and columns called like the operator's own."""
    rows = [(1, i // 3 if i % 10 else None, "h" if i < 80 else "x", "clash") for i in range(100)]
    df = spark.createDataFrame(rows, "c long, id long, b string, _part string")
    for width in (8, 1 << 16):
        assert {(r.key_value, r.n_rows) for r in keychunks.heavy_keys(df, "c", ["b"], "id", 20, width, 7).collect()} == {("h", 80), ("x", 20)}
