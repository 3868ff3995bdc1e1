"""Connected components by minimum propagation in star-contraction form.

Every vertex hands the smallest id it knows to its larger neighbours, then to
its smaller ones, which halves the paths in each round, so a chain of n
vertices takes some log n rounds. Each round is written to the shared folder,
which cuts the lineage; what a round left is counted while it is written, and
only counts come to the driver. Where a caller allows it, a graph of a proven
size is finished in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lanternlog.session import Tables

#: Edges that one task can hold: two arrays of 8 MB.
ONE_TASK = 1 << 20


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The labels of a whole graph of at most ONE_TASK edges: roots are hooked to smaller roots, then paths are halved."""
    parts = [(b["u"].to_numpy(), b["v"].to_numpy()) for b in batches]
    if not parts:
        return
    ends = np.concatenate([np.concatenate(side) for side in zip(*parts)])
    ids, place = np.unique(ends, return_inverse=True)
    a, b = np.split(place, 2)
    root = np.arange(len(ids))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while not np.array_equal(root, root[root]):
            root = root[root]
    other = root != np.arange(len(ids))
    yield pa.RecordBatch.from_arrays([pa.array(ids[other]), pa.array(ids[root[other]])], ["u", "label"])


def label(tables: Tables, edges: DataFrame, one_task: int = 0) -> DataFrame:
    """u, label: the smallest id of the component of every vertex but the smallest itself. edges: u, v, null-free longs.

    one_task: edges, up to ONE_TASK, at which a single task takes over.
    """
    seen = {"n": F.count(F.lit(1)), "x": F.bit_xor(F.xxhash64("u", "v")), "y": F.bit_xor(F.xxhash64("v", "u", F.lit(1)))}
    now, state = tables.put_seen(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), **seen)
    while True:
        if state["n"] <= min(one_task, ONE_TASK):
            return now.repartition(1).mapInArrow(_settle, "u long, label long")
        # every vertex links its larger neighbours to the smallest vertex it knows
        both = both_ways(now)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = tables.put(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # and its smaller neighbours, and itself, to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        links = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))
        after, found = tables.put_seen(large.join(least, "u").select(F.explode(links)).select("col.u", "col.v").where("u <> v").distinct(), **seen)
        tables.drop(now)
        tables.drop(large)
        now = after
        if found == state:
            return now.select("u", F.col("v").alias("label"))
        state = found


def components(edges: DataFrame, one_task: int = 0) -> DataFrame:
    """id, component of every vertex of the edges (u, v); the component is named by its smallest id. Self-edges keep their vertex."""
    tables = Tables(edges.sparkSession, "components")
    edges = tables.put(edges.where("u is not null and v is not null"))
    labels = label(tables, edges, one_task)
    every = both_ways(edges).select(F.col("u").alias("id")).distinct()
    return every.join(labels, every["id"] == labels["u"], "left").select("id", F.coalesce("label", "id").alias("component"))
