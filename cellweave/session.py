"""Session construction, checkpoints and tables in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "cellweave", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster pass your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", os.environ.get("CELLWEAVE_SHUFFLE_PARTITIONS", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """The folder for derived tables that all executors see.

    The folder given to `setCheckpointDir` or named by `spark.checkpoint.dir`. Where neither is set, a
    temporary folder serves a local master; on a cluster, whose machines would not see it, this raises.
    """
    global _own_folder
    context = spark.sparkContext
    given = context._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return os.path.dirname(given.get().rstrip("/"))  # Spark adds a folder of its own below the given one
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not _is_local(context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="cellweave-")
    return _own_folder


def _is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


_own_folder: str | None = None


def keep_checkpoints(spark: SparkSession) -> None:
    """Set the checkpoint folder, in the shared folder, unless there is one."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def checkpointed(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and cut its lineage; lost executors cost nothing."""
    keep_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; whatever is written there goes when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/cellweave-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place.getParent())
    files.deleteOnExit(place)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    For a derived table that is scanned several times: later scans still prune columns and
    push filters down, which a checkpoint cannot. The table goes when the driver's JVM ends.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
