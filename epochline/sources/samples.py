"""Nested measurement records: one row per record, with parallel arrays of ages and values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_SCHEMA = T.StructType(
    [
        T.StructField("age", T.ArrayType(T.DoubleType())),
        T.StructField("paleoData_values", T.ArrayType(T.DoubleType())),
        T.StructField("geo_meanLat", T.DoubleType()),
        T.StructField("geo_meanLon", T.DoubleType()),
        T.StructField("paleoData_units", T.StringType()),
        T.StructField("paleoData_useInGlobalTemperatureAnalysis", T.StringType()),
        T.StructField("paleoData_QCnotes", T.StringType()),
        T.StructField("paleoData_description", T.StringType()),
        T.StructField("paleoData_habitatSeason", T.StringType()),
        T.StructField(
            "paleoData_interpretation", T.ArrayType(T.StructType([T.StructField("seasonality", T.StringType())]))
        ),
    ]
)


NUMBER_ARRAYS = ("age", "paleoData_values")


def read_samples(spark: SparkSession, path: str, fmt: str = "json", schema: T.StructType = SAMPLE_SCHEMA) -> DataFrame:
    """Records from JSON lines or Parquet, with every missing number as null.

    JSON files may hold the text "nan" inside the number arrays, so these are read as text first.
    """
    if fmt != "json":
        return spark.read.schema(schema).format(fmt).load(path)
    text = T.StructType(
        [T.StructField(f.name, T.ArrayType(T.StringType()) if f.name in NUMBER_ARRAYS else f.dataType) for f in schema]
    )
    df = spark.read.schema(text).json(path)

    def number(x):
        value = x.try_cast("double")
        return F.when(~F.isnan(value), value)

    return df.withColumns({c: F.transform(F.col(c), number) for c in NUMBER_ARRAYS if c in df.columns})


def explode_pairs(df: DataFrame, key: str, value: str, out_key: str, out_value: str, pos: str = "pos") -> DataFrame:
    """One row per array position that has both a key and a value."""
    pairs = F.posexplode(F.arrays_zip(F.col(key), F.col(value)))
    rows = df.select(*[c for c in df.columns if c not in (key, value)], pairs.alias(pos, "__pair"))
    k, v = F.col("__pair").getField(key), F.col("__pair").getField(value)
    known = k.isNotNull() & v.isNotNull() & ~F.isnan(k) & ~F.isnan(v)
    return rows.where(known).withColumns({out_key: k, out_value: v}).drop("__pair")
