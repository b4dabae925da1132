"""Session set-up, the shared folder, and cutting lineage."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "epochline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on; `conf` entries win over them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by `spark.checkpoint.dir`.

    Only a local master may go without the setting; it then gets a temporary folder of its own.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="epochline-"))
    return context.getCheckpointDir().rstrip("/")


_scratch: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_scratch(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application once its results are written.

    Frames that still read from them can no longer be used.
    """
    for path in _scratch.pop(spark.sparkContext.applicationId, []):
        location = spark._jvm.org.apache.hadoop.fs.Path(path)
        location.getFileSystem(spark._jsc.hadoopConfiguration()).delete(location, True)


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Used where a result feeds several later steps: the expensive part runs once, the table survives
    the loss of executors, and later steps still prune columns because it is Parquet.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Shuffle files of steps that are over go now, and not only when the driver happens to collect its garbage."""
    for pause in (0.3, 0):  # what the first round frees holds others
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def sized(df: DataFrame) -> DataFrame:
    """Settle a join side that is expected to be small, so that the planner knows its real size.

    An aggregate has no useful size estimate. Joined directly, the large side is shuffled before Spark
    finds out that the other one would have fitted into a broadcast. Read from a table, a small side is
    broadcast from the start and a large one is joined by sorting; nothing is forced.
    """
    return settle(df, "side")
