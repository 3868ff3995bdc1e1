"""Reading the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream(spark: SparkSession, folder: str, name: str, files: int = 64) -> DataFrame:
    """A table, be it a file or a folder of files, as a stream of at most `files` files a batch."""
    path = f"{folder}/{name}.parquet"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    reader = spark.readStream.schema(table(spark, folder, name).schema).option("maxFilesPerTrigger", files)
    return reader.parquet(path) if whole else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
