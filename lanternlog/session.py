"""Session set-up and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import Column, DataFrame, Observation, SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return _session(SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(partitions)), **conf)


def submitted_session() -> SparkSession:
    """The session of the command line: on the master that it was submitted to, else a local one."""
    return _session(SparkSession.builder) if SparkConf().contains("spark.master") else local_session()


def _session(builder: SparkSession.Builder, **conf: str) -> SparkSession:
    builder = builder.appName("lanternlog")
    for key, value in {**CONF, "spark.ui.enabled": "false", "spark.driver.memory": "8g", **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, a temporary one in local mode, and an error on a cluster, whose machines would not share it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(spark, "_lanternlog_dir"):
        spark._lanternlog_dir = "file://" + tempfile.mkdtemp(prefix="lanternlog-")
    return spark._lanternlog_dir


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it comes from fewer files than there are cores, which one row group each would leave idle. More files stay as they are, unshuffled."""
    context = df.sparkSession.sparkContext
    files = context._jvm.java.lang.reflect.Array.getLength(df._jdf.inputFiles())
    return df.repartition(context.defaultParallelism) if 0 < files < context.defaultParallelism else df


def _at(spark: SparkSession, path: str):
    """(the path, its file system)."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file of any file system Spark reads; None if it isn't there."""
    at, system = _at(spark, path)
    if not system.exists(at):
        return None
    stream = system.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """The file as a whole or not at all: written beside it, then renamed over it."""
    at, system = _at(spark, path)
    beside, _ = _at(spark, f"{path}.{uuid.uuid4().hex[:8]}")
    stream = system.create(beside, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    system.delete(at, False)
    system.rename(beside, at)


class Tables:
    """Intermediate tables of one run, written once to the shared folder and read from there.

    A written table cuts the lineage as checkpoint() does, but computes its
    plan once and survives the loss of any executor.
    """

    def __init__(self, spark: SparkSession, name: str, root: str | None = None):
        """root: a folder of the caller's, whose tables outlive this driver."""
        self.spark = spark
        self.root = root or f"{shared_dir(spark)}/lanternlog-{name}-{uuid.uuid4().hex}"
        self.count = 0
        if root is None:
            atexit.register(self.drop_all)

    def put(self, df: DataFrame, *partition_by: str) -> DataFrame:
        path = f"{self.root}/{self.count}-{uuid.uuid4().hex[:8]}"
        self.count += 1
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lanternlog_path = path
        return out

    def put_seen(self, df: DataFrame, **seen: Column) -> tuple[DataFrame, dict]:
        """put(), and aggregates over the rows as they are written, without a pass of their own."""
        watch = Observation()
        out = self.put(df.observe(watch, *[column.alias(name) for name, column in seen.items()]))
        return out, watch.get

    def drop(self, df: DataFrame | None) -> None:
        """Remove a table that no plan still to run reads."""
        path = getattr(df, "_lanternlog_path", None)
        if path:
            self._delete(path)

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def drop_all(self) -> None:
        """Remove what is left when the driver ends, if its session still lives."""
        try:
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.root)
        except Exception:  # noqa: BLE001 - the session is gone
            pass
