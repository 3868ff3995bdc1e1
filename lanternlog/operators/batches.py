"""Functions over many small groups at once: rows arrive sorted by group, and whole groups are handed on a batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F


def codes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A number for each value, nulls alike."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(pc.dictionary_encode(column).indices, -1).to_numpy(zero_copy_only=False) + 1


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where groups begin in a sorted table."""
    new = np.zeros(len(table), bool)
    new[:1] = True
    for key in keys:
        code = codes(table[key])
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _run(keys: list[str], function: Callable[[pa.Table, np.ndarray], pa.Table]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            starts = group_starts(table, keys)
            group = np.zeros(len(table), np.int64)
            group[starts[1:]] = 1
            yield from function(table.combine_chunks(), np.cumsum(group)).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            edge = pa.concat_tables([held[-1].slice(len(held[-1]) - 1), table]) if held else table
            starts = group_starts(edge, keys) - bool(held)
            last = int(starts[-1])
            if last <= 0 and held and last < 0:
                held.append(table)  # the open group goes on through the whole batch
                continue
            whole = pa.concat_tables([*held, table.slice(0, max(last, 0))])
            if len(whole):
                yield from done(whole)
            held = [table.slice(max(last, 0))]
        if held:
            yield from done(pa.concat_tables(held))

    return run


def by_groups(df: DataFrame, keys: list[str], order: list[str], function: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """function(table, group of each row) over whole groups of `keys`, many at a time, rows in `order` inside a group. A group must fit into a task.

    Rows are laid out by a hash of the keys: by the keys alone, Spark leaves
    the exchange out behind a join on them, whose own one adaptive execution
    then splits or reads map by map, and groups with it.
    """
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).mapInArrow(_run(keys, function), schema)
