"""Per-key results without per-key tasks: exact offset chunking.

A few keys hold most rows, so a task per key leaves most of a cluster idle.
Here a task never holds a key, only an equal-sized chunk of one:

1. rows fall into input partitions, ranges of an integer order column that is
   unique; quantiles give each about `width` rows, be the values dense or not;
2. keys are counted per partition (with map-side combine);
3. a prefix sum of those counts gives each (partition, key) its offset;
4. offset + rank inside (partition, key) is the row's exact number in its key;
5. number // size is the chunk; chunks are aggregated apart, and their ordered
   boundary states (first and last row) are merged per key.

Only step 3 and the merge look at one key at once, over a row a partition or
a chunk, not a row a record. Keys are compared by their text and whether they
are null, so that equality joins serve null keys too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lanternlog.operators.ranges import bounds, numbered

WIDTH, SIZE = 1 << 16, 1 << 15


def _codes(keys: list[str]) -> list[str]:
    return [f"_kc_{what}_{i}" for i in range(len(keys)) for what in ("null", "key")]


def placed(df: DataFrame, keys: list[str], order: str, width: int = WIDTH) -> DataFrame:
    """df with _kc_part, the input partition, and the coded keys."""
    cuts = bounds(df.select(order), order, width)
    coded = {f"_kc_null_{i}": F.col(k).isNull() for i, k in enumerate(keys)} | {f"_kc_key_{i}": F.coalesce(F.col(k).cast("string"), F.lit("")) for i, k in enumerate(keys)}
    return numbered(df, order, cuts, "_kc_part").withColumns(coded)


def key_offsets(rows: DataFrame, keys: list[str]) -> DataFrame:
    """coded keys, _kc_part, _n, _kc_before: the rows of a key in and before each input partition. rows: as of placed()."""
    codes = _codes(keys)
    counts = rows.groupBy(*codes, "_kc_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*codes).orderBy("_kc_part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_kc_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def _numbered_rows(rows: DataFrame, keys: list[str], order: str, size: int) -> DataFrame:
    """Placed rows with _number and _chunk_of_key."""
    codes = _codes(keys)
    inside = Window.partitionBy(*codes, "_kc_part").orderBy(order)
    ranked = rows.withColumn("_kc_rank", F.row_number().over(inside))
    joined = ranked.join(key_offsets(rows, keys).drop("_n"), [*codes, "_kc_part"]).withColumn("_number", F.col("_kc_before") + F.col("_kc_rank") - 1)
    return joined.withColumn("_chunk_of_key", F.floor(F.col("_number") / size))


def number_rows(df: DataFrame, keys: list[str], order: str, width: int = WIDTH, size: int = SIZE) -> DataFrame:
    """df with _number (from 0 in its key, by `order`) and _chunk_of_key.

    Null keys form a key of their own. `order` is an integer, negative and
    sparse values are fine; rows of one place are numbered in any order among
    themselves, rows without a place come first. An empty table gives an empty
    one.
    """
    return _numbered_rows(placed(df, keys, order, width), keys, order, size).select(*df.columns, "_number", "_chunk_of_key")


def key_counts(df: DataFrame, keys: list[str], order: str, width: int = WIDTH, size: int = SIZE) -> DataFrame:
    """keys, n_rows, n_chunks: rows are numbered, each chunk gives its first and last number, and a key's chunks are merged in order.

    A chunk follows on the one before it exactly if it begins behind its last
    number; numbers with a gap would be no count and raise an error.
    """
    codes = _codes(keys)
    rows = _numbered_rows(placed(df, keys, order, width), keys, order, size)
    states = rows.groupBy(*codes, "_chunk_of_key").agg(F.min("_number").alias("_first"), F.max("_number").alias("_last"), F.count(F.lit(1)).alias("_n"), *[F.first(k).alias(k) for k in keys])
    along = Window.partitionBy(*codes).orderBy("_chunk_of_key")
    follows = F.col("_first") == F.coalesce(F.lag("_last").over(along), F.lit(-1)) + 1
    whole = follows & (F.col("_n") == F.col("_last") - F.col("_first") + 1)
    merged = states.withColumn("_whole", whole).groupBy(*codes).agg(*[F.first(k).alias(k) for k in keys], (F.max("_last") + 1).alias("n_rows"), F.count(F.lit(1)).alias("n_chunks"), F.min("_whole").alias("_whole"))
    checked = F.when(F.col("_whole"), F.col("n_rows")).otherwise(F.raise_error(F.lit("numbers of a key have a gap")).cast("long"))
    return merged.select(*keys, checked.alias("n_rows"), "n_chunks")


def key_profile(df: DataFrame, keys: list[str], order: str, ts: str, width: int = WIDTH, size: int = SIZE) -> DataFrame:
    """An order-dependent result per key: how its rows follow one another.

    n_rows, first_at, last_at (first and last row by `order`), max_step_us and
    n_back: the largest step of `ts` (microseconds) between neighbours, 0 for
    a key of one row, and the number of neighbours whose `ts` steps back. Rows
    with a null `ts` count in n_rows only.
    """
    codes = _codes(keys)
    rows = _numbered_rows(placed(df.select(*keys, order, ts), keys, order, width), keys, order, size).withColumn("_us", F.unix_micros(ts))
    one = Window.partitionBy(*codes, "_chunk_of_key").orderBy("_number")
    step = rows.withColumn("_step", F.col("_us") - F.last("_us", True).over(one.rowsBetween(Window.unboundedPreceding, -1)))
    timed = F.when(F.col("_us").isNotNull(), F.col("_number"))
    states = step.groupBy(*codes, "_chunk_of_key").agg(
        F.min_by("_us", timed).alias("_first"), F.max_by("_us", timed).alias("_last"), F.max("_step").alias("_max"),
        F.count_if(F.col("_step") < 0).alias("_back"), F.count(F.lit(1)).alias("_n"), *[F.first(k).alias(k) for k in keys])
    seam = F.col("_first") - F.last("_last", True).over(Window.partitionBy(*codes).orderBy("_chunk_of_key").rowsBetween(Window.unboundedPreceding, -1))
    merged = states.withColumn("_seam", seam).groupBy(*codes).agg(
        *[F.first(k).alias(k) for k in keys], F.sum("_n").alias("n_rows"),
        F.timestamp_micros(F.min_by("_first", F.when(F.col("_first").isNotNull(), F.col("_chunk_of_key")))).alias("first_at"),
        F.timestamp_micros(F.max_by("_last", F.when(F.col("_last").isNotNull(), F.col("_chunk_of_key")))).alias("last_at"),
        F.coalesce(F.greatest(F.max("_max"), F.max("_seam")), F.lit(0)).alias("max_step_us"),
        (F.sum("_back") + F.count_if(F.col("_seam") < 0)).alias("n_back"))
    return merged.select(*keys, "n_rows", "first_at", "last_at", "max_step_us", "n_back")


def heavy_keys(df: DataFrame, scope: str, fields: list[str], order: str, share: int = 20, width: int = WIDTH, size: int = SIZE) -> DataFrame:
    """scope, field, key_value, n_rows: values that hold at least 1/share of all rows of their scope.

    Null values are no keys but count as rows of the scope; a null scope is a
    scope of its own. Numbers come out as decimal text.
    """
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("key_value")) for f in fields])
    # a row comes once a field, so `order` stays unique in a key
    long = df.select(F.col(scope).alias("_scope"), F.col(order).alias("_order"), F.inline(entries))
    counts = key_counts(long, ["_scope", "field", "key_value"], "_order", width, size)
    # every row has one entry a field, null values included, so a field's counts add up to the scope's rows
    rows = counts.withColumns({"_none": F.col("_scope").isNull(), "_in": F.coalesce(F.col("_scope").cast("string"), F.lit(""))})
    total = rows.groupBy("_none", "_in", "field").agg(F.sum("n_rows").alias("_rows"))
    enough = F.col("key_value").isNotNull() & (F.col("n_rows") * share >= F.col("_rows"))
    return rows.join(total, ["_none", "_in", "field"]).where(enough).select(F.col("_scope").alias(scope), "field", "key_value", "n_rows")
