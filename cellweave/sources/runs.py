"""Run logs and metric files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_metrics(runs: DataFrame, path: str, key: str) -> None:
    """One JSON document, in a file of its own, for each row.

    Rows are dealt over all cores by a number of parts, as their few bytes would otherwise be joined to one task. Tasks
    move their own files into place as they end; the driver would otherwise move them one after the other.
    """
    dealt = runs.repartition(4 * runs.sparkSession.sparkContext.defaultParallelism, key).write.option("maxRecordsPerFile", 1)
    dealt.option("mapreduce.fileoutputcommitter.algorithm.version", 2).json(path)


def read_metrics(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """Per-fold or per-variant JSON documents, one row per file; a known `schema` spares a pass over all files."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return (
        reader.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
        .option("mode", "PERMISSIVE").json(path)
        .withColumn("file", F.input_file_name())
    )


def read_epochs(spark: SparkSession, path: str, *keys: str, schema: str | StructType | None = None) -> DataFrame:
    """One row per epoch of every run file that has a log."""
    runs = read_metrics(spark, path, schema)
    return runs.where(F.col("log").isNotNull()).select(*keys, F.explode("log").alias("_l")).select(*keys, "_l.*")
