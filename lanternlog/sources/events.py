"""Reading and writing event sets: JSON, XML, binary logs, and the columnar lake."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from lanternlog.session import Tables
from lanternlog.sources.normalize import PROMOTED, decode, json_of_xml, silver_schema

SUFFIXES = [".json", ".ndjson", ".jsonl", ".xml", ".evtx"]


class NoEventsError(ValueError):
    """Nothing to analyse; raised rather than returning an empty result."""


def _status(spark: SparkSession, path: str):
    """(the path as its file system names it, whether it is a folder); NoEventsError if it isn't there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(at):
        raise NoEventsError(f"no such path: {path}")
    found = system.getFileStatus(at)
    return found.getPath().toString(), found.isDirectory()


def files_of(spark: SparkSession, paths: list[str], suffixes: list[str] = SUFFIXES) -> list[str]:
    """Files under the paths, of any file system that Spark reads, in sorted order; NoEventsError for a missing path or no file."""
    known = [_status(spark, p) for p in paths]
    folders = [p for p, is_folder in known if is_folder]
    out = {p for p, is_folder in known if not is_folder}
    if folders:
        # the listing is Spark's own; no file is opened
        out |= {f for f in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folders).inputFiles() if f.lower().endswith(tuple(suffixes))}
    if not out:
        raise NoEventsError(f"no event files in {', '.join(paths)}")
    return sorted(out)


def array_files(spark: SparkSession, files: list[str]) -> set[str]:
    """Those of the files that hold one JSON array: their first sign that is no blank is `[`. A pass over them in the JVM; only names come back, as many as a listing has."""
    rows = spark.read.text(files).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", r"^\ufeff?\s+|^\ufeff", "").alias("text")).where("text <> ''")
    return {r.file for r in rows.groupBy("file").agg(F.min_by(F.substring("text", 1, 1), "at").alias("sign")).where("sign = '['").select("file").collect()}


def json_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """file, value: one record a row, of files of one object a line or of one array. Line files stay splittable; `.json` files are looked into first, others hold lines by their name."""
    doubtful = [f for f in files if not f.lower().endswith((".ndjson", ".jsonl"))]
    arrays = array_files(spark, doubtful) if doubtful else set()
    # a name as the file system writes it, which a path given as a file may differ from
    whole = sorted(arrays)
    lines = [f for f in files if f not in arrays]
    parts = []
    if lines:
        parts.append(spark.read.text(lines).select(F.input_file_name().alias("file"), "value"))
    if whole:
        text = spark.read.text(whole, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", r"^\ufeff?\s*", "").alias("value"))
        items = F.try_parse_json("value").cast("array<variant>")
        # an array that can't be parsed stays one record, which then is no object
        parts.append(text.select("file", F.explode(F.coalesce(F.transform(items, lambda v: F.to_json(v)), F.array("value"))).alias("value")))
    return functools.reduce(DataFrame.unionAll, parts)


def records(spark: SparkSession, files: list[str]) -> DataFrame:
    """file, value: the records of all files as JSON text."""
    of = lambda *kinds: [f for f in files if f.lower().endswith(kinds)]
    xml, logs = of(".xml"), of(".evtx")
    plain = [f for f in files if f not in {*xml, *logs}]
    parts = []
    if plain:
        parts.append(json_lines(spark, plain))
    if xml:
        parts.append(json_of_xml(spark.read.text(xml, wholetext=True).select(F.input_file_name().alias("file"), "value"), ("file",)))
    if logs:
        parts.append(json_of_xml(evtx_records(spark, logs), ("file",)))
    return functools.reduce(DataFrame.unionAll, parts)


def load(spark: SparkSession, paths: list[str], promoted: list[str] = PROMOTED, by_file: bool = False) -> DataFrame:
    """Events of all files with `_rid`, written once, so that `_rid` stays the same; the order is (TimeCreated, _rid).

    Records without a time or with an event id that is no number are left out
    (`normalize.quarantine` has them). A line that is no JSON object raises
    NoEventsError, as does a load without events. by_file: with `file`, and
    files with a broken line as an event without a time each, for callers that
    judge files one by one.
    """
    found = decode(records(spark, files_of(spark, paths)), "value", promoted, ("file",))
    broken = F.col("problem") == "no JSON object"
    kept = found.where(F.col("problem").isNull() | broken)
    rows, seen = Tables(spark, "events").put_seen(kept.withColumn("_rid", F.monotonically_increasing_id()), n=F.count_if(F.col("problem").isNull()), bad=F.count_if(broken), where=F.min(F.when(broken, F.col("file"))))
    if by_file:
        return rows
    if seen["bad"]:
        raise NoEventsError(f"{seen['bad']} lines are no JSON object, the first file with one is {seen['where']}")
    if not seen["n"]:
        raise NoEventsError("the files hold no event with a time")
    return rows.select("_rid", *silver_schema(promoted))


def evtx_records(spark: SparkSession, files: list[str]) -> DataFrame:
    """file, value: the records of binary event logs as XML, if the optional reader is installed; a task a file, decoded in memory, corrupt records are skipped."""
    try:
        import Evtx.Evtx  # noqa: F401
    except ImportError as e:
        raise NoEventsError("binary event logs need the optional package python-evtx") from e

    def read(batches):
        import pyarrow as pa
        from Evtx.Evtx import FileHeader

        def texts(content: bytes):
            for chunk in FileHeader(content, 0).chunks():
                for record in chunk.records():
                    try:
                        yield record.xml()
                    except Exception:  # noqa: BLE001 - a corrupt record
                        continue

        for batch in batches:
            for file, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                found = list(texts(content))
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(found), pa.string()), pa.array(found, pa.string())], ["file", "value"])

    return spark.read.format("binaryFile").load(files).select("path", "content").mapInArrow(read, "file string, value string")


def write_lake(events: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The columnar lake: range-partitioned and sorted by (EventID, TimeCreated), so row groups prune both."""
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = events.repartitionByRange(parts, "EventID", "TimeCreated").sortWithinPartitions("EventID", "TimeCreated")
    laid.write.mode(mode).option("compression", "zstd").parquet(path)


def read_lake(spark: SparkSession, *paths: str) -> DataFrame:
    """Lakes united by name; a column that a part lacks is null there."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def query(events: DataFrame, where=None, limit: int | None = None, fields: list[str] | None = None) -> DataFrame:
    """A projection in time order; field names are matched without case."""
    if where is not None:
        events = events.where(where)
    if fields is not None:
        low = {c.lower(): c for c in events.columns}
        events = events.select(*dict.fromkeys(low[f.lower()] for f in ["TimeCreated", "_rid", *fields] if f.lower() in low))
    events = events.orderBy("TimeCreated", "_rid")
    return events if limit is None else events.limit(limit)


def of_event_ids(events: DataFrame, ids: list[int], fields: list[str] | None = None) -> DataFrame:
    """Events of some ids; none for an empty list."""
    return query(events, F.col("EventID").isin(list(ids)) if ids else F.lit(False), fields=fields)


def verify_sha256(spark: SparkSession, pins: dict[str, str]) -> DataFrame:
    """path, ok: whether files have the pinned digests."""
    digests = spark.read.format("binaryFile").load(list(pins)).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.sha2("content", 256).alias("digest"))
    want = spark.createDataFrame(list(pins.items()), "path string, want string")
    return want.join(digests, "path", "left").select("path", F.coalesce(F.lower("want") == F.col("digest"), F.lit(False)).alias("ok"))
