"""Schemas that drift between files: tagged-union inference over JSON lines.

Each batch of lines is fused to the set of (file, path, type) it holds, over
all paths, so a shuffle carries a row a file, path and type and batch, never a
row a record. A path keeps all types it is seen with (a tagged union); a
catalog of spellings, joined afterwards, only renames paths; a conflict splits
the field into typed branches beside one canonical text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lanternlog.session import Tables

TYPES = ["string", "number", "boolean", "array", "object"]
BOM = "﻿"


def json_type(value: object) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "string" if isinstance(value, str) else "array" if isinstance(value, list) else "object"


def parse_line(text: str | None) -> dict | None:
    """The JSON object of a line; None for anything else. Of a name given twice the last value counts."""
    if not text:
        return None
    try:
        value = json.loads(text.removeprefix(BOM), parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _refuse(name: str) -> None:
    raise ValueError(name)  # NaN and Infinity are not JSON


def leaves(obj: dict) -> Iterator[tuple[str, object]]:
    """(dotted path, value) of every value but null, objects before what they hold; a dotted name and nested objects give the same path."""
    todo = [("", obj)]
    while todo:
        prefix, at = todo.pop()
        for name, value in at.items():
            if value is None:
                continue
            path = prefix + name
            yield path, value
            if isinstance(value, dict):
                todo.append((path + ".", value))


def _fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: set[tuple] = set()
        for feed, file_no, payload in zip(*(batch[c].to_pylist() for c in ("feed", "file_no", "payload"))):
            obj = parse_line(payload)
            seen.add((feed, file_no, None, None))
            if obj:
                seen.update((feed, file_no, path, json_type(value)) for path, value in leaves(obj))
        rows = list(zip(*seen)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), *(pa.array(r, pa.string()) for r in rows[2:])], ["feed", "file_no", "path", "json_type"])


def alias_names(aliases: DataFrame, most: int = 1_000_000) -> dict[str, str]:
    """spelling -> field, of a catalog of at most `most` rows; of a spelling given to two fields the first by name counts."""
    rows = aliases.where("spelling is not null and field is not null").groupBy("spelling").agg(F.min("field").alias("field")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} spellings")
    return {r.spelling: r.field for r in rows}


def schemas(raw: DataFrame, aliases: DataFrame) -> DataFrame:
    """feed, file_no, field, named, spellings, types: a row a file and field; a row with a null field a file.

    aliases: spelling, field, of any size. A path that is no spelling is a
    field under its own name, with `named` false. spellings, types are sorted
    arrays. Lines delivered twice or late change nothing; a file without any
    good line still is a file.
    """
    fused = raw.select("feed", F.col("file_no").cast("long").alias("file_no"), "payload").mapInArrow(_fuse, "feed string, file_no long, path string, json_type string")
    fused = fused.groupBy("feed", "file_no", "path").agg(F.collect_set("json_type").alias("types"))
    known = aliases.where("spelling is not null and field is not null").groupBy(F.col("spelling").alias("path")).agg(F.min("field").alias("_field"))
    named = fused.join(known, "path", "left").select("feed", "file_no", F.coalesce("_field", "path").alias("field"), F.col("_field").isNotNull().alias("named"), "path", "types")
    return named.groupBy("feed", "file_no", "field", "named").agg(F.sort_array(F.collect_set("path")).alias("spellings"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))).alias("types"))


def changes(schema: DataFrame) -> DataFrame:
    """feed, file_no, change_kind, field, named, was, now: each change from the file before.

    The file before is the one with the next smaller file_no of the feed. A
    feed's first file has no changes. Rows with a null feed or file_no are
    left out.
    """
    # read from three sides below, so the lines are parsed once for a table of a row a file and field
    schema = Tables(schema.sparkSession, "drift").put(schema.where(F.col("feed").isNotNull() & F.col("file_no").isNotNull()))
    files = schema.select("feed", "file_no").distinct()
    along = Window.partitionBy("feed").orderBy("file_no")
    files = files.withColumn("_before", F.lag("file_no").over(along)).withColumn("_after", F.lead("file_no").over(along))
    has = schema.where(F.col("field").isNotNull()).join(files, ["feed", "file_no"])
    own = has.select("feed", "file_no", "_before", "field", "named", F.lit(1).alias("_side"), "spellings", "types")
    # what a file leaves to the next, so that one aggregation meets both
    left = has.where(F.col("_after").isNotNull()).select("feed", F.col("_after").alias("file_no"), F.col("file_no").alias("_before"), "field", "named", F.lit(0).alias("_side"), "spellings", "types")
    both = own.where(F.col("_before").isNotNull()).unionByName(left).groupBy("feed", "file_no", "field", "named").agg(
        *[F.first(F.when(F.col("_side") == s, F.col(c)), True).alias(f"{n}_{c}") for s, n in ((0, "was"), (1, "now")) for c in ("spellings", "types")])
    kinds = F.when(F.col("was_spellings").isNull(), F.array(F.lit("added"))).when(F.col("now_spellings").isNull(), F.array(F.lit("removed"))).otherwise(
        F.array_compact(F.array(F.when(F.col("was_spellings") != F.col("now_spellings"), F.lit("renamed")), F.when(F.col("was_types") != F.col("now_types"), F.lit("retyped")))))
    show = lambda side: F.concat_ws(" as ", F.array_join(f"{side}_spellings", ", "), F.array_join(f"{side}_types", ", "))
    return both.select("feed", "file_no", F.explode(kinds).alias("change_kind"), "field", "named", show("was").alias("was"), show("now").alias("now"))


def _canonical(value: object) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def _conform(names: dict[str, str], fields: list[str], keep: list[str]):
    wanted = frozenset(names)

    def conform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: dict[str, list] = {f"{f}{s}": [None] * batch.num_rows for f in fields for s in ("", "__type", "__number", "__boolean")}
            other: list[str | None] = [None] * batch.num_rows
            ok = [False] * batch.num_rows
            for i, payload in enumerate(batch["payload"].to_pylist()):
                if (obj := parse_line(payload)) is None:
                    continue
                ok[i], rest = True, {}
                for path, value in sorted(leaves(obj), key=lambda x: x[0]):
                    field = names.get(path)
                    if field is None or columns[field][i] is not None:
                        # what no field takes stays with the record; parts of an object that a field takes are in the field
                        if not isinstance(value, dict) and not any(path.startswith(w + ".") for w in wanted if path[: len(w)] == w):
                            rest[path] = value
                        continue
                    kind = json_type(value)
                    columns[field][i], columns[f"{field}__type"][i] = _canonical(value), kind
                    if kind == "number":
                        columns[f"{field}__number"][i] = float(value) if abs(value) < 1e308 else None
                    elif kind == "boolean":
                        columns[f"{field}__boolean"][i] = value
                other[i] = json.dumps(rest, ensure_ascii=False, sort_keys=True) if rest else None
            kinds = {"": pa.string(), "__type": pa.string(), "__number": pa.float64(), "__boolean": pa.bool_()}
            arrays = [batch[c] for c in keep] + [pa.array(ok), *(pa.array(v, kinds[c[len(c.split("__")[0]) :]]) for c, v in columns.items()), pa.array(other, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "is_object", *columns, "other_fields"])

    return conform


def conform(raw: DataFrame, names: dict[str, str], keep: list[str]) -> DataFrame:
    """One row a line under the fields' own names.

    Of each field: its canonical text, the JSON type it had, and typed
    branches for numbers and booleans (objects and arrays are JSON text in the
    canonical column). other_fields keeps, as JSON, what no spelling names.
    Lines that are no JSON object keep their row with is_object false. keep:
    columns carried along; they must not be called like a field.
    """
    fields = sorted(set(names.values()))
    if clash := set(keep) & {*fields, "is_object", "other_fields"}:
        raise ValueError(f"columns called like a field: {sorted(clash)}")
    types = dict(raw.dtypes)
    schema = [f"`{c}` {types[c]}" for c in keep] + ["is_object boolean"] + [f"`{f}{s}` {t}" for f in fields for s, t in (("", "string"), ("__type", "string"), ("__number", "double"), ("__boolean", "boolean"))] + ["other_fields string"]
    return raw.select(*dict.fromkeys([*keep, "payload"])).mapInArrow(_conform(names, fields, keep), ", ".join(schema))
