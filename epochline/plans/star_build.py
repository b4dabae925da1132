"""From raw measurements to the star schema."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochline.functions.bins import tiered_bin, year_before
from epochline.functions.columns import lookup_first, missing_to_null
from epochline.functions.derive import radiative_forcing, solar_modulation
from epochline.operators.clean import iqr_filter, sample_rule, split_valid
from epochline.operators.grid import axis_mean, decimate, year_of_month
from epochline.operators.lookup import forward_lookup, grid_lookup, rebased, shift_future
from epochline.operators.series import bin_and_fill, dense_id, make_spine, number_rows, stride_fill
from epochline.operators.star import extend_dimension, merge_sources, star_join, star_split
from epochline.session import settle

# The month (0 = January) that a season label stands for.
SEASON_MONTHS = {
    "january": 0,
    "february": 1,
    "march": 2,
    "april": 3,
    "may": 4,
    "june": 5,
    "july": 6,
    "august": 7,
    "september": 8,
    "october": 9,
    "november": 10,
    "december": 11,
    "winter": 0,
    "spring": 3,
    "summer": 6,
    "fall": 9,
    "cold season": 0,
    "coldest month": 0,
    "coldest": 0,
    "mean summer": 6,
    "1; summer": 6,
    "1 (summer)": 6,
    "warmest month": 6,
    "warmest": 6,
}

# The tables of the star schema and their columns.
STAR_TABLES = {
    "fact_temperature": ["temperature_id", "time_id", "sample_id", "degC", "anomaly"],
    "dim_time": ["time_id", "year_bin"],
    "dim_atmosphere": ["time_id", "co2_ppm", "co2_radiative_forcing"],
    "dim_orbital": ["time_id", "eccentricity", "obliquity", "perihelion", "insolation", "global_insolation"],
    "dim_cosmic": ["time_id", "be_ppm", "VADM", "solar_modulation"],
    "dim_location": ["sample_id", "geo_meanLat", "geo_meanLon"],
}

FIRST_GRID_YEAR = 1850
LOOKUP_STRIDE = 10
CELL = ["geo_meanLat", "geo_meanLon"]
TEMPERATURE_COLUMNS = ["sample_id", "year", "degC", "anomaly", *CELL]


@dataclass(frozen=True)
class RawInputs:
    """The source tables.

    `grid` is (month since January 1850, geo_meanLat, geo_meanLon, anomaly) and `climatology` is (month_idx 0..11,
    geo_meanLat, geo_meanLon, climate). `orbital`, `ice_co2`, `sediment` and `field` have a `year` column;
    `modern_co2` has `year_bin`.
    """

    samples: DataFrame
    grid: DataFrame
    climatology: DataFrame
    orbital: DataFrame
    ice_co2: DataFrame
    modern_co2: DataFrame
    sediment: DataFrame
    field: DataFrame


def prepare_samples(
    samples: DataFrame, id_cols: Iterable[str] | None = None, ids: str = "dense"
) -> tuple[DataFrame, DataFrame]:
    """Usable records with id, month and cell, and the rejected ones.

    Ids are consecutive: in the order of `id_cols`, or in any if there are none. With `ids="sparse"` they have gaps.
    Only an order of their own needs the records sorted. Equal records have ids of their own.
    """
    good, rejected = split_valid(samples, sample_rule())
    if id_cols is None or ids == "sparse":
        numbered = number_rows(good, "sample_id", consecutive=ids != "sparse")
    else:
        numbered = dense_id(good, list(id_cols), "sample_id")
    season = F.get(F.col("paleoData_interpretation"), F.lit(0)).getField("seasonality")
    placed = lookup_first(
        numbered, [(season, True), (F.col("paleoData_habitatSeason"), False)], SEASON_MONTHS, "month_idx"
    ).withColumns({c: F.bround(c).cast("bigint") for c in CELL})
    return placed.withColumn("age", shift_future(F.col("age"))), rejected


def reference_anomaly(heads: DataFrame, grid: DataFrame) -> DataFrame:
    """The modern anomaly at each record's most recent observation, by sample.

    Monthly records look up their month, the others all twelve. Records that end before the grid begins
    use its first year. A missing value is looked for ten years later, and so on.
    """
    modern = F.col("newest_year") >= FIRST_GRID_YEAR
    months = F.when(modern & F.col("month_idx").isNotNull(), F.array("month_idx")).otherwise(
        F.sequence(F.lit(0), F.lit(11))
    )
    probes = heads.where(F.col("newest_year") > 0).select(
        "sample_id",
        *CELL,
        F.greatest(F.col("newest_year"), F.lit(FIRST_GRID_YEAR)).alias("at_year"),
        F.explode(months).alias("month_idx"),
    )
    ref = grid.select(
        *CELL,
        year_of_month(F.col("month"), FIRST_GRID_YEAR).alias("year"),
        F.pmod("month", F.lit(12)).cast("int").alias("month_idx"),
        F.col("anomaly"),
    ).join(probes.select(*CELL).distinct(), CELL, "left_semi")
    found = forward_lookup(probes, ref, [*CELL, "month_idx"], "at_year", "year", "anomaly", LOOKUP_STRIDE, "reference")
    return found.groupBy("sample_id").agg(F.avg("reference").alias("reference"))


EXTREME_ANOMALY = 20


def sample_temperatures(placed: DataFrame, grid: DataFrame, climatology: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per observation relative to the record's newest one, and a side table of doubtful rows.

    Everything a record needs from outside is joined to the record before its arrays are unfolded, so
    the observations themselves are never shuffled. The side table has the rows of records whose last
    anomaly is extreme (they are kept in the result too), and of those that have no modern baseline.
    """
    known = F.filter(
        F.arrays_zip("age", "paleoData_values"),
        lambda x: x["age"].isNotNull() & x["paleoData_values"].isNotNull() & ~F.isnan(x["age"]) & ~F.isnan(x["paleoData_values"]),
    )
    records = settle(placed.withColumn("pairs", known).drop("age", "paleoData_values"), "records")
    newest = F.get(F.col("pairs"), F.lit(0))
    heads = records.select(
        "sample_id",
        *CELL,
        "month_idx",
        (F.lit(1950) - newest["age"].cast("bigint")).alias("newest_year"),
        F.coalesce(F.col("paleoData_description").contains("T anomalies"), F.lit(False)).alias("is_anomaly"),
    )
    monthly = climatology.select(*CELL, F.col("month_idx").cast("int").alias("month_idx"), F.col("climate").alias("of_month"))
    yearly = axis_mean(climatology, CELL, "climate", "of_year")
    climate = grid_lookup(grid_lookup(heads, monthly, [*CELL, "month_idx"]), yearly, CELL)
    modern = reference_anomaly(heads.where(~F.col("is_anomaly")), grid)
    based = climate.join(modern, "sample_id", "left").select(
        "sample_id",
        F.when(F.col("month_idx").isNull(), F.col("of_year")).otherwise(F.col("of_month")).alias("climate"),
        F.when(F.col("is_anomaly"), F.lit(0.0)).otherwise(F.col("reference")).alias("reference"),
    )
    last = F.element_at("pairs", -1)["paleoData_values"] - newest["paleoData_values"] + F.col("reference")
    unfolded = records.join(based, "sample_id").select(
        "sample_id",
        *CELL,
        "climate",
        "reference",
        newest.alias("newest"),
        (F.abs(last) > EXTREME_ANOMALY).alias("is_extreme"),
        F.explode("pairs").alias("pair"),
    )
    columns = rebased(
        F.col("pair.age"),
        F.col("pair.paleoData_values"),
        F.col("newest.age"),
        F.col("newest.paleoData_values"),
        F.col("reference"),
        F.col("climate"),
    )
    rows = unfolded.withColumns(columns)
    reason = F.when(F.col("degC").isNull(), "no baseline").when(F.col("is_extreme"), "extreme").alias("reason")
    doubtful = rows.select(*TEMPERATURE_COLUMNS, reason).where(F.col("reason").isNotNull())
    return rows.where(F.col("degC").isNotNull()).select(*TEMPERATURE_COLUMNS), doubtful


def grid_temperatures(grid: DataFrame, climatology: DataFrame, id_offset: int | None = 0) -> DataFrame:
    """Yearly means of every second grid cell. Gaps take the value of the same month two years later.

    Cells are numbered from `id_offset + 1` on, or from -1 downwards, with gaps, if it is None.
    """
    thinned = decimate(missing_to_null(grid, ["anomaly"]), CELL)
    filled = stride_fill(thinned, "month", "anomaly", 24, CELL)
    yearly = filled.withColumn("year", year_of_month(F.col("month"), FIRST_GRID_YEAR))
    yearly = yearly.groupBy(*CELL, "year").agg(F.avg("anomaly").alias("anomaly"))
    climate = axis_mean(decimate(climatology, CELL), CELL, "climate")
    cells = climate.select(*CELL).distinct()
    if id_offset is None:
        located = number_rows(cells, "sample_id", consecutive=False).withColumn("sample_id", -F.col("sample_id"))
    else:
        located = dense_id(cells, CELL, "sample_id", id_offset)
    placed = climate.join(located, CELL).join(yearly, CELL)
    return placed.withColumn("degC", F.col("climate") + F.col("anomaly")).select(*TEMPERATURE_COLUMNS)


def co2_series(ice: DataFrame, modern: DataFrame, spine: DataFrame, extra: Sequence[tuple[int, float]] = ((2024, 424.61),)):
    """Ice-core and modern concentrations on the spine; where both exist the modern one counts."""
    bins = bin_and_fill(ice, "year", tiered_bin(F.col("year")), spine, ["co2_ppm"], horizon=2025, horizon_cols=["co2_ppm"])
    recent = modern.select(F.col("year_bin").cast("bigint").alias("year_bin"), F.col("co2_ppm").cast("double"))
    if extra:
        recent = recent.unionByName(ice.sparkSession.createDataFrame(list(extra), "year_bin bigint, co2_ppm double"))
    merged = merge_sources([(bins, 0), (recent, 1)], ["year_bin"], ["co2_ppm"])
    return merged.withColumn("co2_radiative_forcing", radiative_forcing(F.col("co2_ppm")))


def sediment_series(parts: Sequence[DataFrame], oldest: int | None = None, sentinel: float = 999_999) -> DataFrame:
    """Concentrations of several cores as (year, be_ppm); each part has `age_ka` and `be_ppm`."""
    merged = None
    for part in parts:
        rows = part.select(year_before(F.col("age_ka"), unit=1000).alias("year"), F.col("be_ppm").cast("double").alias("be_ppm"))
        merged = rows if merged is None else merged.unionByName(rows)
    known = missing_to_null(merged, ["be_ppm"], sentinel).where(F.col("be_ppm").isNotNull())
    return known if oldest is None else known.where(F.col("year") >= oldest)


def cosmic_series(sediment: DataFrame, field: DataFrame, spine: DataFrame) -> DataFrame:
    """Sediment concentration, field strength (absolute after averaging) and solar modulation on the spine."""
    year = tiered_bin(F.col("year"))
    be = bin_and_fill(sediment, "year", year, spine, ["be_ppm"], horizon=2025, horizon_cols=["be_ppm"])
    vadm = bin_and_fill(field, "year", year, spine, ["VADM"], horizon=2025, horizon_cols=["VADM"])
    both = be.join(vadm.withColumn("VADM", F.abs("VADM")), "year_bin", "left")
    return both.withColumn("solar_modulation", solar_modulation(F.col("be_ppm"), F.col("VADM")))


def build_star(
    inputs: RawInputs, id_cols: Iterable[str] | None = None, ids: str = "dense", left: dict[str, DataFrame] | None = None
) -> dict[str, DataFrame]:
    """All six tables. `ids="sparse"` gives unique ids with gaps, without ordering any rows.

    The temperatures are written out once before they fan out. The dimensions are built from the distinct
    bins, which are few, and never from a wide join with the facts. `left`, if given, takes what the build leaves out or doubts:
    `rejected_samples`, whole, and `doubtful_temperatures`, with the reason.
    """
    placed, rejected = prepare_samples(inputs.samples, id_cols, ids)
    proxies, doubtful = sample_temperatures(placed, inputs.grid, inputs.climatology)
    if left is not None:
        left |= {"rejected_samples": rejected, "doubtful_temperatures": doubtful}
    proxies = settle(proxies, "proxies")
    bounded = iqr_filter(proxies, "degC")
    offset = None if ids == "sparse" else proxies.agg(F.max("sample_id").alias("n")).first()["n"] or 0
    cells = grid_temperatures(inputs.grid, inputs.climatology, offset)
    rows = settle(bounded.unionByName(cells), "temperatures")
    rows = rows.withColumn("year_bin", tiered_bin(F.col("year"))).withColumn("time_id", F.col("year_bin"))

    fact_bins = make_spine(rows, key="year_bin")
    orbital_cols = STAR_TABLES["dim_orbital"][1:]
    orbital = settle(
        bin_and_fill(inputs.orbital, "year", tiered_bin(F.col("year")), fact_bins, orbital_cols), "orbital"
    )
    spine = settle(make_spine(fact_bins, orbital, key="year_bin"), "spine")
    oldest = spine.agg(F.min("year_bin").alias("y")).first()["y"]
    co2 = co2_series(inputs.ice_co2, inputs.modern_co2, spine)
    cosmic = cosmic_series(
        inputs.sediment.where(F.col("year") >= oldest), inputs.field.where(F.col("year") >= oldest), spine
    )
    wide = star_join(fact_bins, {"co2": co2, "orbital": orbital, "cosmic": cosmic}, "year_bin")
    by_time = wide.withColumn("time_id", F.col("year_bin"))

    # The facts have a unique id, so they need no de-duplication.
    if ids == "sparse":
        numbered = number_rows(rows, "temperature_id", consecutive=False)
    else:
        numbered = dense_id(rows, ["year", "sample_id", "degC", "anomaly"], "temperature_id")
    tables = {"fact_temperature": numbered.select(*STAR_TABLES["fact_temperature"])}
    tables.update(star_split(rows, {"dim_location": STAR_TABLES["dim_location"]}))
    tables.update(star_split(by_time, {n: STAR_TABLES[n] for n in ("dim_time", "dim_atmosphere", "dim_cosmic")}))
    tables["dim_orbital"] = orbital.select(F.col("year_bin").alias("time_id"), *orbital_cols)
    tables["dim_time"] = extend_dimension(tables["dim_time"], tables["dim_orbital"], "time_id", repeat=["year_bin"])
    return {name: tables[name] for name in STAR_TABLES}
