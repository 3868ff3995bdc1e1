"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The mix is a stream of N blocks of B tokens. Blocks go to sources by highest
quotient share / (2 k + 1), so every prefix of the stream, and with it every
shard, has integer quotas as near to the shares as whole blocks can be. Each
source's documents lie in a seeded order, cut into blocks of B tokens; a
seeded permutation of its blocks fills its quota, and begins anew for a repeat.
Documents are never cut, so a source misses its quota by less than one
document.

A source with most of the rows makes no large task: positions, of documents in
their seeded order and of blocks in theirs, are prefix sums over buckets of the
order, then sums inside a bucket.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window, functions as F

from lanternlog.llm.sizes import NAME, VOCABULARIES, add_sizes
from lanternlog.session import Tables, spread

BUCKETS, BLOCKS, SHARDS = 4096, 1024, 8


def apportion(shares: dict[str, float], blocks: int) -> list[str]:
    """The source of each block in turn: highest quotients first, ties to the larger share, then by name."""
    heap = [(-share, -share, source, 0) for source, share in shares.items() if share > 0]
    heapq.heapify(heap)
    out = []
    while heap and len(out) < blocks:
        _, minus, source, k = heapq.heappop(heap)
        out.append(source)
        heapq.heappush(heap, (minus / (2 * k + 3), minus, source, k + 1))
    return out


def sizes(documents: DataFrame, targets: DataFrame, folder: str = VOCABULARIES, name: str = NAME) -> DataFrame:
    """doc_id, source, n_tokens of the documents whose source has a target."""
    wanted = targets.select("source").where("source is not null").distinct()
    return spread(documents.select("doc_id", "source", "text")).join(wanted, "source").mapInArrow(add_sizes("text", ["doc_id", "source"], folder, name), "doc_id long, source string, n_tokens long")


def mix(sized: DataFrame, targets: DataFrame, tokens: int | None = None, seed: int = 17, blocks: int = BLOCKS, shards: int = SHARDS, buckets: int = BUCKETS, most_sources: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(the mix, the shares reached).

    sized: doc_id, source, n_tokens, read several times, so a written table.
    targets: source, target_share, max_repeats (how often a document may be
    used at most); shares need not sum to 1. tokens: the size of the mix; if
    None, or more than the repeats allow at these shares, the largest mix at
    which every source reaches its share. A source without tokens, with a
    share of 0 or null, or max_repeats under 1 gives nothing, and the others
    share the whole. Documents without a source take no part; those without
    tokens come along with their block. Rows of one doc_id are documents of
    their own.

    The mix: doc_id, source, copy_no (from 0), n_tokens, shard. The shares:
    source, target_share, actual_share, n_tokens, n_rows, most_copies.
    """
    spark = sized.sparkSession
    goal = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    key = F.xxhash64(F.lit(seed), F.col("doc_id"))
    docs = sized.withColumn("_key", key).withColumn("_bucket", F.pmod(F.shiftright("_key", 20), F.lit(buckets)))
    sums = docs.groupBy("source", "_bucket").agg(F.sum("n_tokens").alias("_tokens"))
    rows = goal.join(sums.groupBy("source").agg(F.sum("_tokens").alias("have")), "source", "left").limit(most_sources + 1).collect()
    if len(rows) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    usable = {r.source: r for r in rows if (r.have or 0) > 0 and (r.target_share or 0) > 0 and (r.max_repeats or 0) >= 1}
    whole = sum(r.target_share for r in usable.values())
    shares = {s: r.target_share / whole for s, r in usable.items()}
    most = min((int(r.have * r.max_repeats / shares[s]) for s, r in usable.items()), default=0)
    size = min(most, tokens) if tokens is not None else most
    block = max(1, size // blocks)
    turn = apportion(shares, size // block if size else 0)
    cap = {s: r.have * r.max_repeats // block for s, r in usable.items()}
    edges: dict[str, list[int]] = {s: [0] * shards for s in usable}
    used = dict.fromkeys(usable, 0)
    for i, source in enumerate(turn):
        # rounding may give a source a block more than its repeats hold
        if used[source] < cap[source]:
            used[source] += 1
        edges[source][min(shards - 1, i * shards // len(turn))] = used[source]
    for own in edges.values():
        for j in range(1, shards):
            own[j] = max(own[j], own[j - 1])
    plan = spark.createDataFrame([(s, r.have, int(r.max_repeats), used[s] * block, edges[s]) for s, r in usable.items()], "source string, _have long, _most int, _quota long, _edges array<int>")

    # where each document begins in its source's seeded order
    ahead = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_tokens").over(ahead), F.lit(0))).drop("_tokens")
    inside = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = docs.withColumn("_end", F.sum("n_tokens").over(inside)).join(offsets, ["source", "_bucket"]).withColumn("_at", F.col("_offset") + F.col("_end") - F.col("n_tokens"))
    placed = placed.withColumn("_block", F.floor(F.col("_at") / block))
    # a seeded permutation of each source's blocks; a source much larger than the mix has many, so its order is cut into buckets too
    cut = placed.groupBy("source", "_block").agg(F.min("_at").alias("_first"), F.sum("n_tokens").alias("_tokens")).withColumn("_mixed", F.xxhash64(F.lit(seed + 1), F.col("source"), F.col("_block")))
    cut = cut.withColumn("_slot", F.pmod(F.shiftright("_mixed", 20), F.lit(buckets)))
    slots = cut.groupBy("source", "_slot").agg(F.sum("_tokens").alias("_sum")).withColumn("_ahead", F.coalesce(F.sum("_sum").over(Window.partitionBy("source").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    shuffled = Window.partitionBy("source", "_slot").orderBy("_mixed", "_block").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("_inside", F.coalesce(F.sum("_tokens").over(shuffled), F.lit(0))).join(slots, ["source", "_slot"])
    cut = cut.select("source", "_block", "_first", (F.col("_ahead") + F.col("_inside")).alias("_turn"))
    laid = placed.join(cut, ["source", "_block"]).withColumn("_pos", F.col("_turn") + F.col("_at") - F.col("_first")).join(plan, "source")
    copies = F.sequence(F.lit(0), F.least(F.col("_most"), F.ceil(F.col("_quota") / F.col("_have")).cast("int")) - 1)
    laid = laid.where(F.col("_quota") > 0).select("doc_id", "source", "n_tokens", "_pos", "_have", "_quota", "_edges", F.explode(copies).alias("copy_no"))
    laid = laid.withColumn("_from", F.col("copy_no") * F.col("_have") + F.col("_pos")).where(F.col("_from") + F.col("n_tokens") <= F.col("_quota"))
    shard = F.size(F.filter("_edges", lambda e: e * block <= F.col("_from")))
    out = laid.select("doc_id", "source", "copy_no", "n_tokens", F.least(shard, F.lit(shards - 1)).alias("shard"))

    reached = out.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_rows"), (F.max("copy_no") + 1).alias("most_copies"))
    reached = goal.join(reached, "source", "left").select("source", "target_share", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
    total = F.sum("n_tokens").over(Window.partitionBy())
    reached = reached.withColumn("actual_share", F.when(total > 0, F.col("n_tokens") / total).otherwise(F.lit(0.0)))
    return out, reached.select("source", "target_share", "actual_share", "n_tokens", "n_rows", "most_copies")


def mix_documents(documents: DataFrame, targets: DataFrame, **options: object) -> tuple[DataFrame, DataFrame]:
    """mix() of documents (doc_id, source, text); tokens are counted once and written to the shared folder."""
    folder, name = options.pop("folder", VOCABULARIES), options.pop("name", NAME)
    return mix(Tables(documents.sparkSession, "mix").put(sizes(documents, targets, folder, name)), targets, **options)
