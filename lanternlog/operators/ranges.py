"""Ranges of an integer order column that hold about equally many rows, however its values are spread."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

#: Bounds that are kept on the driver and looked up in every row.
MOST = 1 << 16


def bounds(df: DataFrame, order: str, width: int, most: int = MOST, rows: int | None = None) -> list[float]:
    """Ascending values that cut `order` into ranges of about `width` rows, in at most `most` ranges.

    One pass over the one column, and one to count where `rows` isn't known.
    The quantiles are approximate, by a tenth of a range, which changes the
    ranges' sizes and nothing else.
    """
    rows = df.count() if rows is None else rows
    parts = min(most, math.ceil(rows / width))
    if parts < 2:
        return []
    cut = F.percentile_approx(order, [i / parts for i in range(1, parts)], parts * 10)
    found = df.agg(cut.alias("cut")).first().cut or []
    return sorted({float(v) for v in found})


def numbered(df: DataFrame, order: str, cuts: list[float], to: str = "_part") -> DataFrame:
    """df with the number of the range that `order` lies in, null in the first. Values that differ beyond a double's digits may share a range, never swap theirs."""
    if not cuts:
        return df.withColumn(to, F.lit(0).cast("long"))
    cutter = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_as_double", outputCol="_range", handleInvalid="keep")
    return cutter.transform(df.withColumn("_as_double", F.coalesce(F.col(order).cast("double"), F.lit(-math.inf)))).withColumn(to, F.col("_range").cast("long")).drop("_as_double", "_range")
