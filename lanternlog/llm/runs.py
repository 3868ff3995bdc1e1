"""Repeated consecutive events: each run of one rule becomes one row.

Events are range-partitioned by (group, order), which a hot group cannot
unbalance because the order is part of the range. Inside a partition each event
is compared with its predecessor (lag), changes are flagged, and the running
sum of the flags is the run. Only the first and last run of a partition can go
on in a neighbour; these few rows are merged in a second, small pass. The runs
of the partitions are written once: read from two plans, they would rest on two
range partitionings, whose sampled bounds need not agree.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from lanternlog.session import Tables

IPV4 = r"^\d{1,3}(\.\d{1,3}){3}$"


def same_text(column: Column) -> Column:
    """Case and surrounding blanks do not matter."""
    return F.lower(F.regexp_replace(column, r"^[\s ]+|[\s ]+$", ""))


def host_key(column: Column) -> Column:
    """A host without its DNS suffix, an address in full; null for no host (null, empty, `-`)."""
    host = same_text(column)
    address = host.rlike(IPV4) | host.contains(":")
    return F.when(host.isNull() | host.isin("", "-"), None).when(address, F.regexp_replace(host, "^::ffff:(?=[0-9.]+$)", "")).otherwise(F.split_part(host, F.lit("."), F.lit(1)))


def _same(column: pa.Array) -> np.ndarray:
    """Whether each value equals the one before; nulls are equal."""
    codes = pc.fill_null(pc.dictionary_encode(column).indices, -1).to_numpy(zero_copy_only=False)
    return codes[1:] == codes[:-1]


_STATE = ["_grp", "_what", "_part", "_run", "first_id", "last_id", "n", "start_us", "end_us", "_edge"]


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one partition, batch by batch; the last run of a batch waits for the next batch."""
    part, number, held = None, 0, None

    def out(rows: pa.Table, edge: int) -> pa.RecordBatch:
        rows = rows.append_column("_edge", pa.array(np.full(len(rows), edge), pa.int32()))
        return rows.select(_STATE).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch["_part"][0].as_py()
        change = np.concatenate([[True], ~(_same(batch["_grp"]) & _same(batch["_what"]))])
        starts = np.flatnonzero(change)
        ends = np.concatenate([starts[1:], [batch.num_rows]]) - 1
        at = pa.array(starts)
        end_us = pc.fill_null(batch["_end"], np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        runs = pa.table({
            "_grp": batch["_grp"].take(at), "_what": batch["_what"].take(at), "_part": batch["_part"].take(at), "_run": pa.array(np.arange(len(starts)) + number, pa.int64()),
            "first_id": batch["_id"].take(at), "last_id": batch["_id"].take(pa.array(ends)), "n": pa.array(ends - starts + 1, pa.int64()),
            "start_us": batch["_start"].take(at), "end_us": pa.array(np.maximum.reduceat(end_us, starts), pa.int64()),
        })
        number += len(starts)
        if held is not None:
            one, two = held.to_pylist()[0], runs.slice(0, 1).to_pylist()[0]
            if (one["_grp"], one["_what"]) == (two["_grp"], two["_what"]):
                joined = {**one, "last_id": two["last_id"], "n": one["n"] + two["n"], "end_us": max(one["end_us"], two["end_us"])}
                runs = pa.concat_tables([pa.Table.from_pylist([joined], schema=runs.schema), runs.slice(1)])
            else:
                runs = pa.concat_tables([held, runs])
        held = runs.slice(len(runs) - 1)
        done = runs.slice(0, len(runs) - 1)
        first = int(len(done) > 0 and done["_run"][0].as_py() == 0)
        if first:
            yield out(done.slice(0, 1), 1)
        if len(done) > first:
            yield out(done.slice(first), 0)
    if held is not None:
        yield out(held, 1)


def collapse(df: DataFrame, group: list[Column], what: Column, start: str, end: str, order_id: str, partitions: int | None = None) -> DataFrame:
    """first_id, last_id, n, start_ts, end_ts of each run, single events included.

    Events are ordered by (`start`, `order_id`) in their group; a run is a
    maximal stretch of neighbours with equal `what`. It lasts from its first
    start to its latest end (a missing end counts as the start). Rows in which
    a group column is null are left out, null `what`s are equal to each other,
    rows with a null start come first. `order_id` is unique.
    """
    spark = df.sparkSession
    key = F.concat_ws("\x1f", *group)
    rows = df.where(functools.reduce(operator.and_, [g.isNotNull() for g in group])).select(
        key.alias("_grp"), what.alias("_what"), F.unix_micros(start).alias("_start"), F.coalesce(F.unix_micros(end), F.unix_micros(start)).alias("_end"), F.col(order_id).cast("long").alias("_id"))
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.repartitionByRange(parts, "_grp", "_start", "_id").sortWithinPartitions("_grp", "_start", "_id").withColumn("_part", F.spark_partition_id())
    schema = "_grp string, _what string, _part int, _run long, first_id long, last_id long, n long, start_us long, end_us long, _edge int"
    states = Tables(spark, "runs").put(laid.mapInArrow(_partial, schema))
    # Edge runs of one group in neighbouring partitions are neighbours, as all rows between them would be edge
    # runs too. A group has at most two of them a partition, so this window grows with partitions, not rows.
    along = Window.partitionBy("_grp").orderBy("_part", "_run")
    goes_on = (F.lag("_part").over(along) != F.col("_part")) & F.lag("_what").over(along).eqNullSafe(F.col("_what"))
    edge = states.where("_edge = 1").withColumn("_flag", F.when(goes_on, 0).otherwise(1))
    edge = edge.withColumn("_no", F.sum("_flag").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    place = F.struct("_part", "_run")
    merged = edge.groupBy("_grp", "_no").agg(
        F.min_by("first_id", place).alias("first_id"), F.max_by("last_id", place).alias("last_id"), F.sum("n").alias("n"),
        F.min_by("start_us", place).alias("start_us"), F.max("end_us").alias("end_us"))
    columns = ["first_id", "last_id", "n", F.timestamp_micros("start_us").alias("start_ts"), F.timestamp_micros(F.when(F.col("end_us") > -(2**62), F.col("end_us"))).alias("end_ts")]
    return states.where("_edge = 0").select(*columns).unionByName(merged.select(*columns))
