"""Consolidating pairwise matches into groups: connected components over billions of pairs.

1. Peel the giant component: breadth-first search from the vertex of highest
   degree by frontier joins. Most of a giant component lies within few steps of
   its hub; the search ends when a step adds less than 1 / SLOW of what is
   reached (at least STEPS steps), as following a long chain step by step would
   need a join for every vertex of it.
2. The peeled vertices are anti-joined away. Edges that lead out of them, if
   the search was ended early, are kept as edges of one vertex that stands for
   all of them, so nothing is lost.
3. The remaining components are labelled by minimum propagation in its
   star-contraction form: every vertex hands the smallest id it knows to its
   larger neighbours, then to its smaller ones, which halves the paths in each
   round; a chain of n vertices takes some log n rounds instead of n.

Each step writes its frontier alone to the shared folder, which cuts the
lineage; a vertex next to a frontier lies in it, in the one before it or is
fresh, so a step never looks at all that was reached. Only counts come to the
driver.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, functions as F

from lanternlog.operators.components import both_ways, label
from lanternlog.session import Tables

STEPS, SLOW = 3, 50


def edges_of(pairs: DataFrame, a: str, b: str, ids: DataFrame | None = None, id_column: str = "id") -> DataFrame:
    """u < v: distinct undirected edges; pairs with a null end, of a row with itself, or with an end not in `ids` give none."""
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = pairs.select(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")).where(x.isNotNull() & y.isNotNull() & (x != y)).distinct()
    if ids is not None:
        known = ids.select(F.col(id_column).cast("long").alias("k")).distinct()
        edges = edges.join(known, edges["u"] == known["k"], "left_semi").join(known, edges["v"] == known["k"], "left_semi")
    return edges


def peel(tables: Tables, edges: DataFrame, steps: int = STEPS, slow: int = SLOW) -> tuple[DataFrame | None, int | None]:
    """(the vertices reached from the hub, their smallest id)."""
    hub = both_ways(edges).groupBy("u").count().orderBy(F.desc("count"), "u").limit(1).collect()
    if not hub:
        return None, None
    layers = [tables.put(edges.sparkSession.createDataFrame([(hub[0].u,)], "u long"))]
    size, least = 1, hub[0].u
    both = tables.put(both_ways(edges))
    while True:
        near = both.join(layers[-1], "u", "left_semi").select(F.col("v").alias("u")).distinct()
        fresh = tables.put(functools.reduce(lambda left, layer: left.join(layer, "u", "left_anti"), layers[-2:], near))
        more = fresh.agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("least")).first()
        if not more.n:
            tables.drop(fresh)
            break
        layers.append(fresh)
        size, least = size + more.n, min(least, more.least)
        if len(layers) > steps and more.n * slow < size:
            break
    tables.drop(both)
    return functools.reduce(DataFrame.unionAll, layers), least


def components(edges: DataFrame, steps: int = STEPS, slow: int = SLOW) -> DataFrame:
    """id, group_id of every vertex of `edges` (u, v); group_id is the smallest id of the group.

    An empty table of edges gives an empty result.
    """
    tables = Tables(edges.sparkSession, "groups")
    edges = tables.put(edges)
    reached, least = peel(tables, edges, steps, slow)
    if reached is None:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("group_id")).limit(0)
    inside = reached.select(F.col("u").alias("k"))
    outside = edges.join(inside, edges["u"] == inside["k"], "left_anti").join(inside, edges["v"] == inside["k"], "left_anti")
    crossing = both_ways(edges).join(inside, F.col("u") == F.col("k"), "left_semi").join(inside, F.col("v") == F.col("k"), "left_anti").select(F.lit(least).alias("u"), "v").distinct()
    rest = label(tables, outside.unionAll(crossing))
    # a chain that leads out of the peeled part may hold a smaller id than it
    up = rest.where(F.col("u") == least).select("label").first()
    giant = inside.select(F.col("k").alias("id"), F.lit(up.label if up else least).alias("group_id"))
    small = rest.where(F.col("u") != least)
    roots = small.select(F.col("label").alias("id")).where(F.col("id") != least).distinct()
    others = small.select(F.col("u").alias("id"), F.col("label").alias("group_id")).unionAll(roots.select("id", F.col("id").alias("group_id")))
    return giant.unionAll(others)
