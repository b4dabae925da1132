"""Reading the source tables of the star schema from files."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochline.functions.bins import year_before
from epochline.functions.columns import names
from epochline.operators.clean import repair_shifted
from epochline.plans.star_build import RawInputs, sediment_series
from epochline.sources.samples import read_samples


@dataclass(frozen=True)
class InputPaths:
    """Where the source tables are. `shifted_sediment` holds files whose first rows lost their first cell."""

    samples: str
    grid: str
    climatology: str
    orbital: str
    ice_co2: str
    modern_co2: str
    sediment: tuple[str, ...]
    shifted_sediment: tuple[str, ...]
    field: str

    @classmethod
    def in_folder(cls, folder: str) -> InputPaths:
        """The layout `<folder>/<table>`; sediment files are folders of CSV files with one header each."""
        return cls(
            samples=f"{folder}/samples.json",
            grid=f"{folder}/grid.parquet",
            climatology=f"{folder}/climatology.parquet",
            orbital=f"{folder}/orbital.csv",
            ice_co2=f"{folder}/ice_co2.csv",
            modern_co2=f"{folder}/modern_co2.csv",
            sediment=(f"{folder}/sediment",),
            shifted_sediment=(f"{folder}/shifted_sediment",),
            field=f"{folder}/field.csv",
        )


def read_named(spark: SparkSession, paths: str | Iterable[str], columns: Mapping[str, str], repair: bool = False) -> DataFrame:
    """Some columns of CSV files by header name, as numbers under new names.

    Files with dozens of columns need no full schema this way; everything is read as text and only the
    named columns are parsed. `repair` first moves rows back that lost their leading cell: the first two
    columns are depths in two cores, of which the second is greater, so a row with the greater value first
    (a depth and an age) and without a last cell is shifted.
    """
    df = spark.read.csv(names(paths), header=True)
    if repair:
        safe = [f"c{i}" for i in range(len(df.columns))]
        first, second = (F.col(c).try_cast("double") for c in safe[:2])
        shifted = F.coalesce((first > second) & F.col(safe[-1]).isNull(), F.lit(False))
        fixed = repair_shifted(df.toDF(*safe), safe, shifted)
        df = fixed.toDF(*df.columns)
    return df.select(*[F.col(f"`{source}`").try_cast("double").alias(out) for source, out in columns.items()])


def read_inputs(spark: SparkSession, paths: InputPaths, repair: bool = True) -> RawInputs:
    orbital = {
        "year": "year",
        "eccentricity": "eccentricity",
        "obliquity": "obliquity",
        "perihelion": "perihelion",
        "insolation": "insolation",
        "global.insolation": "global_insolation",
    }
    ice = read_named(spark, paths.ice_co2, {"age_gas_calBP": "age", "co2_ppm": "co2_ppm"})
    modern = read_named(spark, paths.modern_co2, {"year": "year_bin", "mean": "co2_ppm"})
    parts = []
    if paths.sediment:
        parts.append(read_named(spark, paths.sediment, {"age_ka-BP": "age_ka", "Be_ppm": "be_ppm"}))
    if paths.shifted_sediment:
        parts.append(read_named(spark, paths.shifted_sediment, {"age_calkaBP": "age_ka", "Be ppm": "be_ppm"}, repair))
    return RawInputs(
        samples=read_samples(spark, paths.samples),
        grid=spark.read.parquet(paths.grid),
        climatology=spark.read.parquet(paths.climatology),
        orbital=read_named(spark, paths.orbital, orbital),
        ice_co2=ice.select(year_before(F.col("age")).alias("year"), "co2_ppm"),
        modern_co2=modern.withColumn("year_bin", F.col("year_bin").cast("bigint")),
        sediment=sediment_series(parts),
        field=read_named(spark, paths.field, {"year": "year", "VADM": "VADM"}),
    )
