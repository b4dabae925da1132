from pyspark.sql import functions as F

from epochline.functions import columns as C
from epochline.functions.bins import Tier, floor_bin, tiered_bin, year_before, year_of_mega_offset
from epochline.functions.derive import radiative_forcing, solar_modulation
from tests.conftest import close

BINS = {
    -875000: -900000, -825000: -800000, -800001: -800000, -800000: -800000, -21000: -20000, -20001: -20000,
    -20000: -20000, -375: -500, -125: 0, -1: 0, 0: 0, 25: 0, 75: 100, 1849: 1850, 1849.9: 1850, 1850: 1850,
    2024.4: 2024, 2024.5: 2024, 2024.9: 2025, 2025: 3000, 2499: 3000, 2500: 4000, 3000: 4000, 3500: 4000,
}


def test_tiered_bin_edges(spark):
    df = spark.createDataFrame([(float(y),) for y in BINS], "year double")
    got = {row.year: row.bin for row in df.select("year", tiered_bin(F.col("year")).alias("bin")).collect()}
    assert got == {float(y): b for y, b in BINS.items()}


def test_tiered_bin_takes_other_tiers_and_nulls(spark):
    df = spark.createDataFrame([(3.0,), (17.0,), (None,)], "x double")
    tiers = [Tier(10, 2), Tier(None, 10)]
    assert [r.b for r in df.select(tiered_bin(F.col("x"), tiers).alias("b")).collect()] == [4, 20, None]


def test_floor_bin(spark):
    df = spark.createDataFrame([(-3000,), (-1,), (0,), (3999,)], "x bigint")
    assert [r.b for r in df.select(floor_bin(F.col("x"), 2000).alias("b")).collect()] == [-4000, -2000, 0, 2000]


def test_years(spark):
    df = spark.createDataFrame([(100.0, 3.55, -2.0)], "age double, ka double, t double")
    row = df.select(
        year_before(F.col("age")).alias("a"),
        year_before(F.col("ka"), unit=1000).alias("b"),
        year_of_mega_offset(F.col("t")).alias("c"),
    ).first()
    assert (row.a, row.b, row.c) == (1850.0, -1600.0, 1000)


def test_forcing_and_modulation(spark):
    df = spark.createDataFrame([(228.0,), (424.61,), (173.71,), (None,)], "c double")
    got = [r.f for r in df.select(radiative_forcing(F.col("c")).alias("f")).collect()]
    assert all(close(a, b, 1e-8) for a, b in zip(got, [0.0, 3.326766273, -1.454977370, None]))
    df = spark.createDataFrame([(2.0, 5.0), (1.1, 5.0), (50.0, 5.0), (None, 5.0), (2.0, None)], "q double, m double")
    got = [r.s for r in df.select(solar_modulation(F.col("q"), F.col("m")).alias("s")).collect()]
    assert all(close(a, b, 1e-8) for a, b in zip(got, [0.471699134, 0.389413690, 0.584841963, None, None]))
    inverted = df.limit(1).select(solar_modulation(F.col("q"), F.col("m"), "inverted").alias("s")).first().s
    assert close(inverted, -1.840800012, 1e-8)


def test_missing_to_null(spark):
    df = spark.createDataFrame([(1.0, 2), (float("nan"), 999999), (999999.0, 3)], "a double, b int")
    got = [tuple(r) for r in C.missing_to_null(df, sentinel=999999).collect()]
    assert got == [(1.0, 2), (None, None), (None, 3)]


def test_rounding_modes(spark):
    df = spark.createDataFrame([(2.5, 2.5)], "a double, kept double")
    assert C.round_all(df, 0, exclude=["kept"]).first().a == 3.0
    assert C.round_all(df, 0, mode="half_even").first().a == 2.0
    assert C.round_all(df, 0, exclude=["kept"]).first().kept == 2.5


def test_column_choice(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a_squared int, delta_b int, c_lagged_2 int, d int")
    assert C.drop_matching(df, ["lagged"], ["delta_"], ["_squared"]).columns == ["d"]
    assert C.drop_matching(df, ["lagged"], ["delta_"], ["_squared"], keep=["delta_b"]).columns == ["delta_b", "d"]
    assert C.select_mask(df, df.columns, [0, 1, 0, 1]).columns == ["delta_b", "d"]


def test_null_after_keeps_the_horizon(spark):
    df = spark.createDataFrame([(2025, 1.0), (3000, 2.0)], "t bigint, v double")
    assert [r.v for r in C.null_after(df, "t", 2025, ["v", "absent"]).orderBy("t").collect()] == [1.0, None]


def test_lookup_precedence(spark):
    df = spark.createDataFrame([("Summer", "winter"), ("x", "winter"), (None, "Winter"), (None, None)], "a string, b string")
    found = C.lookup_first(df, [(F.col("a"), True), (F.col("b"), False)], {"summer": 6, "winter": 0}, "m")
    assert [r.m for r in found.collect()] == [6, 0, None, None]


def test_config_key_tells_settings_apart(spark):
    df = spark.createDataFrame([("1_2", None), ("1", "2")], "a string, b string")
    keys = [r.k for r in df.select(C.config_key(["a", "b"]).alias("k")).collect()]
    assert len(set(keys)) == 2
