"""Reading and writing files and tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from epochline.functions.columns import names


def read_csv(spark: SparkSession, paths: str | Iterable[str], schema: T.StructType | str, **options) -> DataFrame:
    """One or several CSV files with a header, read with a declared schema (no inference pass)."""
    return spark.read.schema(schema).options(header=True, **options).csv(names(paths))


def write_csv(df: DataFrame, path: str, columns: Iterable[str] | None = None, mode: str = "overwrite") -> None:
    chosen = df.select(*names(columns)) if columns is not None else df
    chosen.write.mode(mode).csv(path, header=True)


def write_predictions(df: DataFrame, path: str, key: str = "year_bin", y: str = "anomaly", pred: str = "pred_anomaly", places: int = 5):
    """Predictions as CSV: key, actual and predicted value, rounded."""
    from epochline.functions.columns import round_all

    write_csv(round_all(df.select(key, y, pred), places, exclude=[key]), path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Iterable[str] = ()) -> None:
    writer = df.write.mode(mode)
    if names(partition_by):
        writer = writer.partitionBy(*names(partition_by))
    writer.parquet(path)


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame], recompute: bool = False) -> DataFrame:
    """Read `path` if it holds a finished table, else build it, write it, and read it back."""
    if recompute or not path_exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


def replace_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """Drop the table if it exists and write it anew, at `path` if one is given."""
    writer = df.write.mode("overwrite")
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def append_rows(df: DataFrame, name: str) -> None:
    df.write.mode("append").saveAsTable(name)


def create_table(spark: SparkSession, name: str, columns: dict[str, str]) -> None:
    body = ", ".join(f"`{c}` {kind}" for c, kind in columns.items())
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({body}) USING parquet")


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def save_star(tables: dict[str, DataFrame], update: Iterable[str] | None = None, prefix: str = "") -> None:
    """Write the tables of a star schema; a failed write is raised and not only printed."""
    for name in update if update is not None else tables:
        replace_table(tables[name], f"{prefix}{name}")


def read_document(path: str) -> dict:
    """A small JSON document such as a configuration."""
    with open(path, encoding="utf-8") as handle:
        return json.load(handle)


def read_json_rows(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=multi_line)
