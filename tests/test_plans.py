"""The plans on small fixtures, against values worked out by hand or in plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochline.models.search import SearchConfig
from epochline.operators.clean import duplicate_keys
from epochline.plans import flow, report, star_build, views
from epochline.plans.config import FlowConfig
from epochline.sources.inputs import read_named
from epochline.sources.samples import SAMPLE_SCHEMA
from tests.conftest import close

NAN = float("nan")


def record(age, values, lat=2.4, lon=4.0, **more):
    base = dict.fromkeys(SAMPLE_SCHEMA.names)
    base |= {"age": age, "paleoData_values": values, "geo_meanLat": lat, "geo_meanLon": lon, "paleoData_units": "degC"}
    return base | {f"paleoData_{k}": v for k, v in more.items()}


@pytest.fixture(scope="module")
def places(spark):
    """A cell whose climate is 10 + month, and whose anomaly is 1 except where it is missing."""
    climatology = spark.createDataFrame([(m, 2, 4, 10.0 + m) for m in range(12)], "month_idx int, geo_meanLat bigint, geo_meanLon bigint, climate double")
    rows = []
    for month in range(12 * 160):
        year, m = divmod(month, 12)
        value = 1.0 + year / 100
        if year == 0 and m == 6:
            value = None if month % 2 == 0 else NAN
        rows.append((month, 2, 4, value))
    grid = spark.createDataFrame(rows, "month int, geo_meanLat bigint, geo_meanLon bigint, anomaly double")
    return grid, climatology


def rows_of(spark, places, records):
    samples = spark.createDataFrame(records, SAMPLE_SCHEMA).withColumn("n", F.monotonically_increasing_id())
    placed, rejected = star_build.prepare_samples(samples, ["n"])
    rows, extreme = star_build.sample_temperatures(placed, *places)
    return rows.orderBy("sample_id", F.col("year").desc()).collect(), extreme.collect(), rejected.count()


def test_record_before_the_grid(spark, places):
    rows, extreme, rejected = rows_of(spark, places, [record([500.0, 600.0, NAN, 700.0], [5.0, 7.0, 9.0, NAN]), record([1.0], [2.0], units="m")])
    # First grid year, annual mean; July is missing there and taken from ten years later.
    reference = (11 * 1.0 + 1.1) / 12
    climate = np.mean([10 + m for m in range(12)])
    assert [(r.year, r.geo_meanLat, r.geo_meanLon) for r in rows] == [(1450, 2, 4), (1350, 2, 4)]
    assert close(rows[0].anomaly, reference) and close(rows[1].anomaly, reference + 2)
    assert close(rows[1].degC, climate + reference + 2)
    assert rejected == 1 and not extreme


def test_monthly_record_from_the_future(spark, places):
    rows, _, _ = rows_of(spark, places, [record([-70.0, 30.0], [5.0, 4.0], interpretation=[{"seasonality": "SUMMER"}])])
    # Shifted to age -50, so its newest year is 2000; month 6 of the climate and of the grid.
    assert [r.year for r in rows] == [2000, 1900]
    assert close(rows[0].anomaly, 2.5) and close(rows[1].anomaly, 1.5) and close(rows[0].degC, 16 + 2.5)


def test_anomaly_records_and_those_without_a_baseline(spark, places):
    rows, extreme, _ = rows_of(
        spark,
        places,
        [
            record([500.0, 600.0], [0.0, 30.0], description="T anomalies against the mean"),
            record([3000.0, 3100.0], [1.0, 2.0]),
            record([500.0], [1.0], lat=80.0),
        ],
    )
    assert [r.anomaly for r in rows] == [0.0, 30.0]
    assert {r.sample_id for r in extreme if r.reason == "extreme"} == {rows[0].sample_id}
    assert sorted(r.reason for r in extreme) == ["extreme"] * 2 + ["no baseline"] * 3


def test_season_falls_back_to_the_habitat(spark, places):
    rows, _, _ = rows_of(spark, places, [record([0.0], [1.0], habitatSeason="winter", interpretation=[{"seasonality": "Annual"}])])
    assert close(rows[0].degC - rows[0].anomaly, 10.0)


def test_grid_temperatures(spark, places):
    grid, climatology = places
    odd = grid.withColumn("geo_meanLat", F.lit(3).cast("bigint"))
    rows = star_build.grid_temperatures(grid.unionByName(odd), climatology, 100).orderBy("year").collect()
    assert len(rows) == 160 and {r.sample_id for r in rows} == {101}
    first = (11 * 1.0 + 1.02) / 12
    assert close(rows[0].anomaly, first) and close(rows[0].degC, 15.5 + first) and rows[0].year == 1850


def test_star_with_either_kind_of_ids(spark):
    from catalog.stars import raw_inputs
    from tests.conftest import TESTDATA

    inputs = raw_inputs(spark, TESTDATA)
    dense = star_build.build_star(inputs, ["vec_id"])
    sparse = star_build.build_star(inputs, ["vec_id"], ids="sparse")
    for tables in (dense, sparse):
        fact, location = tables["fact_temperature"], tables["dim_location"]
        assert duplicate_keys(fact, ["temperature_id"]).count() == 0
        assert duplicate_keys(location, ["sample_id"]).count() == 0
        assert fact.join(location, "sample_id", "left_anti").count() == 0
        for name in ("dim_time", "dim_atmosphere", "dim_orbital", "dim_cosmic"):
            assert duplicate_keys(tables[name], ["time_id"]).count() == 0
    ends = dense["fact_temperature"].agg(F.min("temperature_id"), F.max("temperature_id"), F.count("*")).first()
    assert ends[0] == 1 and ends[1] == ends[2] == sparse["fact_temperature"].count()
    assert dense["dim_location"].count() == sparse["dim_location"].count()


def test_sediment_sources(spark, tmp_path):
    one = tmp_path / "one.csv"
    one.write_text('Sample_label,depth_m,age_ka-BP,Be_ppm\n"A,1",1,3.55,1.6\n"A,2",2,29.3,999999\n', encoding="utf-8")
    two = tmp_path / "two.csv"
    two.write_text("d1,d2,age_calkaBP,Al%-s,Be ppm,toc%\n9,2.23,5.36,1.1,4.0,\n8,9,2.25,5,1.2,4.1\n", encoding="utf-8")
    a = read_named(spark, str(one), {"age_ka-BP": "age_ka", "Be_ppm": "be_ppm"})
    b = read_named(spark, str(two), {"age_calkaBP": "age_ka", "Be ppm": "be_ppm"}, repair=True)
    got = star_build.sediment_series([a, b]).orderBy("year").collect()
    assert [(round(r.year, 6), r.be_ppm) for r in got] == [(-1600.0, 1.6), (-300.0, 1.2), (-280.0, 1.1)]


CONFIG = FlowConfig(train_from=-40_000, lags=(2, 3), test_start=-30_000, test_end=-24_000, forecast_end=20_000)


@pytest.fixture(scope="module")
def star(spark):
    rng = np.random.default_rng(2)
    years = [y for y in range(-100_000, -40_000, 50_000)] + list(range(-40_000, 20_001, 1_000))
    fact = [(y, 3 * math.sin(y / 9000) + float(rng.normal()) * 0.1) for y in years if y <= 2000 for _ in range(3)]
    times = spark.createDataFrame([(y, y) for y in years], "time_id bigint, year_bin bigint")
    co2 = [(y, 200 + math.cos(y / 7000) * 20 if y <= 2000 else None) for y in years]
    orbital = [(y, *[math.sin(y / p) for p in (9000, 5000, 7000, 3000, 2000)]) for y in years]
    cosmic = [(y, 1.5 + (y % 7000) / 7000 if y % 3000 == 0 and y <= 2000 else None) for y in years]
    return spark.createDataFrame(fact, "time_id bigint, anomaly double"), {
        "dim_time": times,
        "dim_atmosphere": spark.createDataFrame(co2, "time_id bigint, co2_ppm double").withColumn("co2_radiative_forcing", F.ln("co2_ppm")),
        "dim_orbital": spark.createDataFrame(
            orbital, "time_id bigint, eccentricity double, obliquity double, perihelion double, insolation double, global_insolation double"
        ),
        "dim_cosmic": spark.createDataFrame(cosmic, "time_id bigint, be_ppm double").withColumns(
            {"VADM": F.col("be_ppm") * 2, "solar_modulation": F.col("be_ppm") / 2}
        ),
    }


def test_raw_view_is_scaled(spark, star):
    raw = views.raw_view(views.joined_base(*star, CONFIG), CONFIG)
    row = raw.agg(F.avg("obliquity").alias("m"), F.stddev_pop("obliquity").alias("s"), F.max("co2_ppm").alias("c")).first()
    assert abs(row.m) < 1e-4 and abs(row.s - 1) < 1e-4 and row.c > 200
    assert raw.where("year_bin > 2025").count() == 18 and raw.where("year_bin > 2025 and anomaly is not null").count() == 0


def test_padding_counts_in_the_scaler(spark, star):
    base = views.joined_base(*star, CONFIG)
    padded = views.resampled_view(base, CONFIG).orderBy("year_bin").collect()
    bare = views.resampled_view(base, FlowConfig(**{**CONFIG.__dict__, "pad_copies": 0})).orderBy("year_bin").collect()
    binned = base.groupBy((F.floor(F.col("year_bin") / 2000) * 2000).alias("y")).agg(F.avg("eccentricity").alias("e")).orderBy("y").collect()
    e = np.array([r.e for r in binned if r.y >= -42_000])
    copies = np.r_[np.full(50, e[0]), e]
    assert np.allclose([r.eccentricity for r in padded], (e - copies.mean()) / copies.std(), atol=1e-5)
    assert np.allclose([r.eccentricity for r in bare], (e - e.mean()) / e.std(), atol=1e-5)
    assert padded[0].eccentricity_lagged_3 == padded[0].eccentricity == padded[2].eccentricity_lagged_2


def test_training_view_columns(spark, star):
    resampled = views.resampled_view(views.joined_base(*star, CONFIG), CONFIG)
    training = views.training_view(resampled, CONFIG)
    five = ["eccentricity", "obliquity", "perihelion", "insolation", "global_insolation"]
    lags = [f"{c}_lagged_{k}" for c in ("perihelion", "eccentricity", "obliquity", "insolation") for k in (2, 3)]
    assert set(training.columns) == {"year_bin", "anomaly", *five, *[f"delta_{c}" for c in five], *lags}
    assert training.agg(F.min("year_bin")).first()[0] == -40_000
    assert training.where("anomaly is null").count() > 0
    assert views.training_view(resampled, CONFIG, fill=0.0).where("anomaly is null").count() == 0


def test_the_stages_meet_at_files(spark, star, tmp_path):
    fact, dims = star
    root = str(tmp_path)
    for name, df in {"fact_temperature": fact, **dims}.items():
        df.write.parquet(f"{root}/star/{name}")
    flow.run_views(spark, f"{root}/star", f"{root}/views", CONFIG)
    search = SearchConfig(population=4, generations=1, retrain_k=3)
    board = flow.run_models(spark, f"{root}/views", f"{root}/models", CONFIG, search, folds=2, maxIter=2, maxDepth=2)
    assert {r.model for r in board.collect()} == {"linear_model", "lagged_linear_model", "tree_model", "searched_model"}
    predicted = flow.read_predictions(spark, f"{root}/models/arimax_model_predictions")
    assert predicted.where("year_bin > 2025 and pred_anomaly is null").count() == 0
    assert predicted.where("year_bin <= 2025 and pred_anomaly <> anomaly").count() == 0
    flow.run_reports(spark, f"{root}/views", f"{root}/models", f"{root}/reports", CONFIG)
    shown = spark.read.parquet(f"{root}/reports/predictions")
    assert {r.band for r in shown.select("band").distinct().collect()} == {"Train", "Test", "Forecast"}
    assert shown.where("band = 'Forecast' and anomaly is not null").count() == 0
    assert shown.where("model = 'Arima Model' and band = 'Train' and pred_anomaly is not null").count() == 0
    assert spark.read.parquet(f"{root}/reports/search_progress").count() >= 1


def test_report_trend_uses_roots(spark):
    view = spark.createDataFrame([(float(i * i), 2.0 * i + 1) for i in range(6)], "global_insolation double, anomaly double")
    row = report.predictor_trends(view).first()
    assert row.predictor == "global_insolation" and close(row.slope, 2) and close(row.intercept, 1)


def test_config_document(tmp_path):
    path = tmp_path / "config.json"
    path.write_text('{"present": 2030, "anomaly_decimal_places": 3, "gpu": false}', encoding="utf-8")
    config = FlowConfig.from_document(str(path))
    assert (config.present, config.places, config.forecast_end) == (2030, 3, 200_000)
