"""The scoreboard: one metric per model, kept in a small JSON table."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epochline.functions.columns import title_label
from epochline.sources.files import read_document

METRIC_SCHEMA = "model string, mse double"
#: Versions after which a writer sets down the whole board, so that readers look at no more than these.
FOLD = 16


def _log(spark: SparkSession, path: str) -> list[tuple[int, str, bool]]:
    """Committed versions in order, from the last whole board on: number, folder of its rows, whether it is whole."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/log")
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        return []
    entries = []
    for status in system.listStatus(place):
        name = status.getPath().getName()
        if name.isdigit() and status.getLen():  # a claim whose writer was lost stays empty and counts for nothing
            rows = spark.read.text(status.getPath().toString()).first()
            folder, whole = rows["value"].split(" ")
            entries.append((int(name), folder, whole == "whole"))
    entries.sort()
    start = max((k for k, e in enumerate(entries) if e[2]), default=0)
    return entries[start:]


def _claim(spark: SparkSession, path: str, content: str) -> bool:
    """Create a file with this content, unless there is one: of several writers one succeeds."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(place.getParent())
    if system.getScheme() == "file":  # Hadoop's local file system looks first and creates then
        try:
            with open(place.toUri().getPath(), "x", encoding="utf-8") as handle:
                handle.write(content)
        except FileExistsError:
            return False
        return True
    try:
        stream = system.create(place, False)
    except Py4JJavaError:
        if system.exists(place):
            return False
        raise
    stream.write(content.encode())
    stream.close()
    return True


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The newest entry of each model."""
    return _board(spark, path, _log(spark, path))


def _board(spark: SparkSession, path: str, log: list[tuple[int, str, bool]]) -> DataFrame:
    rows = spark.createDataFrame([], f"{METRIC_SCHEMA}, version bigint")
    for version, folder, _ in log:
        rows = rows.unionByName(spark.read.schema(METRIC_SCHEMA).json(f"{path}/{folder}").withColumn("version", F.lit(version).cast("bigint")))
    return rows.groupBy("model").agg(F.max_by("mse", "version").alias("mse"))


def metrics_from_document(spark: SparkSession, path: str) -> DataFrame:
    """A scoreboard kept as one JSON object `{model: metric}`, as rows."""
    return spark.createDataFrame([(m, float(v)) for m, v in read_document(path).items()], METRIC_SCHEMA)


def upsert_metric(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Replace the entries of the models in `rows`, keep the others; returns the board.

    The rows are written to a folder of their own; they count from when the next version's file in the log is created, which
    only one writer can do for a number. One that comes second takes the next. A write that fails leaves the board as it was.
    Every FOLD versions a writer adds the whole board as a version, from which readers start.
    """
    folder = f"rows-{uuid.uuid4().hex}"
    rows.select("model", F.col("mse").cast("double").alias("mse")).write.json(f"{path}/{folder}")
    version = max((v for v, _, _ in _log(spark, path)), default=0) + 1
    while not _claim(spark, f"{path}/log/{version:012d}", f"{folder} rows"):
        version += 1
    log = _log(spark, path)
    if len(log) > FOLD and log[-1][0] == version:
        whole = f"rows-{uuid.uuid4().hex}"
        _board(spark, path, log).write.json(f"{path}/{whole}")
        # lost to another writer, the fold is left to a later one: its board would lack that version
        _claim(spark, f"{path}/log/{version + 1:012d}", f"{whole} whole")
    return read_metrics(spark, path)


def scoreboard(df: DataFrame, metric: str = "mse", model: str = "model") -> DataFrame:
    """Models with a readable label, ranked with the best (least) metric first."""
    ranked = F.rank().over(Window.orderBy(F.col(metric)))
    return df.select(title_label(F.col(model)).alias(model), F.col(metric), ranked.cast("bigint").alias("rank"))
