"""Ordered multi-step sequences joined on entities.

A step's candidate is keyed by its normalised join values. For each first-step
detection the earliest feasible second, then third, ... step is chosen, which
is the lexicographically least tuple of ranks. Steps follow one another by
looking ahead in one order of time, key by key in buckets as wide as the
sequence, so a hot entity is spread over its time and no pairs are made.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

from lanternlog.functions.entities import HOST_KINDS, domains, entity, filled
from lanternlog.operators.hits import DETECTION, ENTITIES, detections
from lanternlog.plans.rulebook import Rule, inline_rule

PRINCIPALS = ["User", "AccountUpn", "UserPrincipalName", "InitiatingProcessAccountUpn", "UserId"]


def join_fields(sequence: Rule) -> set[str]:
    """Event fields that the joins read beyond actor, host, source and domain."""
    return {side.split(".", 1)[1] for pair in sequence.meta["sequence"].get("join", []) for side in pair} - {"actor", "host", "source", "domain"}


def with_values(found: DataFrame, events: DataFrame, fields: set[str], need_domain: bool) -> DataFrame:
    """found with values_<field>: the distinct values of event fields over each detection's events."""
    if not fields and not need_domain:
        return found
    text = lambda f: filled(F.col(f"`{f}`").cast("string")) if f in events.columns else filled(F.col("fields")[f]) if "fields" in events.columns else F.lit(None).cast("string")
    columns = [text(f).alias(f"_f{i}") for i, f in enumerate(sorted(fields))]
    if need_domain:
        columns.append(F.array_join(domains(text("Computer"), [text(p) for p in PRINCIPALS]), "\x1f").alias("_dom"))
    ids = found.select("det_id", F.explode("event_rids").alias("_rid"))
    met = ids.join(events.select("_rid", *columns), "_rid")
    aggs = [F.collect_set(f"_f{i}").alias(f"values_{f}") for i, f in enumerate(sorted(fields))]
    if need_domain:
        aggs.append(F.array_distinct(F.flatten(F.collect_set(F.split("_dom", "\x1f")))).alias("values_domain"))
    return found.join(met.groupBy("det_id").agg(*aggs), "det_id", "left")


def _values(field: str, columns: list[str]) -> Column:
    """The normalised values of a join side."""
    if field in ("actor", "host", "source"):
        raw = F.array_compact(F.array(filled(F.col(field))))
    else:
        raw = F.coalesce(F.col(f"values_{field}"), F.array().cast("array<string>")) if f"values_{field}" in columns else F.array().cast("array<string>")
    norm = F.transform(raw, lambda v: entity(v, field in HOST_KINDS))
    return F.array_distinct(F.filter(norm, lambda v: v != ""))


def match(steps: list[DataFrame], joins: list[tuple[int, str, int, str]], window_us: int) -> DataFrame:
    """For each first-step detection that completes, the chosen tuple: s0, s1, ... as structs (us, det_id).

    steps: det_id, start_ts, actor, host, source and values_<field>, one frame
    a step. joins: (step, field, step, field). A later step starts at or after
    the step before and within the window of the first. A detection may fill
    two steps. Empty values join nothing.

    Of the candidates of a step that bring the same values to later joins the
    earliest is the best for every choice of earlier steps, as it leaves most
    time and ranks first. So a step keeps one candidate for a choice and such
    values, and no step multiplies pairs.
    """
    own = [s.select("*", F.unix_micros("start_ts").alias("us")) for s in steps]

    def later(i: int) -> list[str]:
        """The fields of step i that joins with later steps read."""
        return sorted({f for a, fa, b, fb in joins for s, f, o in ((a, fa, b), (b, fb, a)) if s == i and o > i})

    def frame(i: int, now: list[tuple[str, str]]) -> DataFrame:
        fields = sorted({*later(i), *(mine.split("_", 1)[1] for mine, _ in now)})
        return own[i].select(F.struct("us", "det_id").alias(f"s{i}"), *[_values(f, own[i].columns).alias(f"k{i}_{f}") for f in fields])

    bound = frame(0, [])
    for i in range(1, len(steps)):
        pairs = [(fa, a, fb) if b == i else (fb, b, fa) for a, fa, b, fb in joins if max(a, b) == i and a != b]
        now = [(f"k{i}_{mine}", f"k{other}_{theirs}") for theirs, other, mine in pairs]
        # what a choice is known by, and the values that later steps ask for
        kept = [f"k{j}_{f}" for j in range(i) for f in later(j) if any(max(a, b) > i and j in (a, b) for a, _, b, _ in joins)]
        prefix, wanted = [f"s{j}" for j in range(i)], [f"k{i}_{f}" for f in later(i)]
        single = len(now) <= 1 and (not wanted or (bool(now) and wanted == [now[0][0]] and now[0][0].split("_", 1)[1] in ENTITY_FIELDS))
        step = _following if single else _least
        bound = step(bound, frame(i, now), i, now, window_us, prefix, [k for k in kept if k in bound.columns], wanted)
    chosen = F.struct(*[F.col(f"s{j}") for j in range(1, len(steps))]) if len(steps) > 1 else F.struct(F.col("s0").alias("s1"))
    best = bound.groupBy("s0").agg(F.min(chosen).alias("_best"))
    return best.select("s0", *[F.col(f"_best.s{j}") for j in range(1, len(steps))])


#: Fields with one value a detection.
ENTITY_FIELDS = ["actor", "host", "source"]


def _bucket(column: Column, window_us: int) -> Column:
    return F.floor(column / (window_us + 1))


def _following(bound: DataFrame, after: DataFrame, i: int, now: list[tuple[str, str]], window_us: int, prefix: list[str], kept: list[str], wanted: list[str]) -> DataFrame:
    """The first candidate at or after each choice, by key: choices and candidates in one order of time, each looking ahead.

    Linear in both. They are laid in buckets as wide as the window, a candidate
    in its own and the one before, so a hot key is spread over its time.
    """
    mine, theirs = now[0] if now else (None, None)
    at = F.col(f"s{i - 1}.us")
    left = bound.select(*prefix, *kept, (F.explode(theirs) if theirs else F.lit("")).alias("_k"), at.alias("_us"), _bucket(at, window_us).alias("_b"), F.lit(0).alias("_side"), F.lit(None).cast("struct<us:bigint,det_id:bigint>").alias("_s"))
    one = F.col(f"s{i}.us")
    right = after.select((F.explode(mine) if mine else F.lit("")).alias("_k"), one.alias("_us"), F.explode(F.array(_bucket(one, window_us), _bucket(one, window_us) - 1)).alias("_b"), F.lit(1).alias("_side"), F.col(f"s{i}").alias("_s"))
    ahead = Window.partitionBy("_k", "_b").orderBy("_us", "_side", "_s.det_id").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    met = left.unionByName(right, allowMissingColumns=True).withColumn("_next", F.first("_s", True).over(ahead)).where("_side = 0 and _next is not null")
    met = met.where(F.col("_next.us") - F.col("s0.us") <= window_us)
    key = [F.array("_k").alias(w) for w in wanted]
    return met.select(*prefix, *kept, F.col("_next").alias(f"s{i}"), *key).distinct()


def _least(bound: DataFrame, after: DataFrame, i: int, now: list[tuple[str, str]], window_us: int, prefix: list[str], kept: list[str], wanted: list[str]) -> DataFrame:
    """The first candidate for each choice and values that later steps ask for, where several joins or many-valued fields decide: pairs meet on the first join and a bucket of time, and are aggregated as they come."""
    both = bound.withColumn("_b", F.explode(F.array(_bucket(F.col("s0.us"), window_us), _bucket(F.col("s0.us"), window_us) + 1)))
    cand, on = after.withColumn("_b", _bucket(F.col(f"s{i}.us"), window_us)), ["_b"]
    if now:
        mine, theirs = now[0]
        both, cand = both.withColumn("_k", F.explode(theirs)), cand.withColumn("_k", F.explode(mine))
        on.append("_k")
    met = both.join(cand, on).where((F.col(f"s{i}.us") >= F.col(f"s{i - 1}.us")) & (F.col(f"s{i}.us") - F.col("s0.us") <= window_us))
    for m, t in now[1:]:
        met = met.where(F.arrays_overlap(m, t))
    return met.groupBy(*prefix, *kept, *wanted).agg(F.min(f"s{i}").alias(f"s{i}"))


def merge(chosen: DataFrame, n: int, found: DataFrame, rule: Rule) -> DataFrame:
    """Sequence detections: starts that complete through the same later steps are one."""
    tail = [F.col(f"s{j}.det_id") for j in range(1, n)]
    groups = chosen.withColumn("seq_id", F.xxhash64(F.lit(rule.id), *(tail or [F.col("s0.det_id")])))
    parts = groups.select("seq_id", F.explode(F.array(*[F.struct(F.lit(j).alias("step"), F.col(f"s{j}.us").alias("us"), F.col(f"s{j}.det_id").alias("det_id")) for j in range(n)])).alias("p")).select("seq_id", "p.*").distinct()
    d = found.select("det_id", "end_ts", "start_ts", "actor", "host", "source", "event_rids", "targets")
    place = F.struct("step", "us", "det_id")
    say = lambda c: F.when(F.col(c) != "", F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")))
    out = parts.join(d, "det_id").withColumn("_e", F.array_compact(F.array(say("actor"), say("host"), say("source")))).groupBy("seq_id").agg(
        F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.min_by("actor", place).alias("_first_actor"), F.max_by("actor", place).alias("_last_actor"),
        F.max_by("host", place).alias("host"), F.min_by("source", place).alias("source"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("event_rids")))).alias("event_rids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_e")))).alias("extra_entities"), F.count_if(F.col("step") == 0).alias("n_starts"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("targets")))).alias("targets"))
    return out.select(
        F.col("seq_id").alias("det_id"), F.lit(rule.id).alias("rule_id"), F.lit(rule.title).alias("title"), F.lit("sequence").alias("kind"), F.lit(rule.level).alias("level"), F.lit(rule.kill_chain).alias("kill_chain"),
        F.array(*map(F.lit, rule.techniques)).cast("array<string>").alias("techniques"), "start_ts", "end_ts",
        F.coalesce(F.nullif("_first_actor", F.lit("")), "_last_actor").alias("actor"), "host", "source", "event_rids", F.col("extra_entities").cast(ENTITIES), "targets", F.lit(rule.risk).alias("risk"), "n_starts")


def sequence(rule: Rule, found: DataFrame, events: DataFrame) -> DataFrame:
    """Detections of one sequence rule over signature detections and raw events; never over other sequences."""
    spec = rule.meta["sequence"]
    names = [s["id"] for s in spec["steps"]]
    fields, domain = join_fields(rule), any(side.endswith(".domain") for pair in spec.get("join", []) for side in pair)
    steps, pool = [], found.select(*DETECTION)
    for step in spec["steps"]:
        if "rule" in step:
            ids = step["rule"] if isinstance(step["rule"], list) else [step["rule"]]
            own = found.where(F.col("rule_id").isin(ids)).select(*DETECTION)
        else:
            own = detections(events, [inline_rule(rule, step)])
            pool = pool.unionByName(own)
        steps.append(with_values(own, events, fields, domain))
    side = lambda s: (names.index(s.split(".", 1)[0]), s.split(".", 1)[1])
    joins = [(*side(a), *side(b)) for a, b in spec.get("join", [])]
    chosen = match(steps, joins, int(spec.get("within_seconds", 3600)) * 1_000_000)
    return merge(chosen, len(steps), pool, rule)


def sequences(rules: list[Rule], found: DataFrame, events: DataFrame) -> DataFrame | None:
    """Detections of all sequence rules; None if there are none."""
    parts = [sequence(r, found, events).select(*DETECTION) for r in rules if r.kind == "sequence"]
    return functools.reduce(DataFrame.unionByName, parts) if parts else None
