"""Plot-ready tables from the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import Registry, r, rounded
from catalog.views import BASE_CTES, CONFIG, MEASURES, RAW_SQL, RESAMPLED_CTES, base, long_term_view, raw_view
from epochline.operators.stats import mse
from epochline.plans import modeling, report
from epochline.session import scratch_path
from epochline.sources.metrics import upsert_metric

QUERIES = Registry()
query = QUERIES.query

RAW = f"WITH {BASE_CTES}, raw AS (SELECT * FROM ({RAW_SQL}) WHERE year_bin BETWEEN -700000 AND 2025)"
LONG = f"""WITH {RESAMPLED_CTES}, lt AS (SELECT year_bin, {', '.join(f'(round({c}, 5) + 0.0) AS {c}' for c in MEASURES)} FROM fi WHERE year_bin <= 2025)"""
SPANS = "spans AS (SELECT * FROM (VALUES " + ", ".join(f"({lo}, {hi}, '{t}')" for lo, hi, t in report.GLACIATIONS) + ") s(lo, hi, label))"


@query(
    "report_windows",
    "R1",
    f"""SELECT win, year_bin, {r('anomaly', 5)} AS anomaly, {r('co2_ppm', 5)} AS co2_ppm FROM (
    ({RAW} SELECT 'modern' AS win, year_bin, anomaly, co2_ppm FROM raw WHERE year_bin BETWEEN 1850 AND 2025
    UNION ALL SELECT 'since_ice_age', year_bin, anomaly, co2_ppm FROM raw WHERE year_bin >= -12000) UNION ALL
    ({LONG} SELECT 'eruption', year_bin, anomaly, co2_ppm FROM lt WHERE year_bin BETWEEN -700000 AND -600000
    UNION ALL SELECT 'long_term', year_bin, anomaly, co2_ppm FROM lt WHERE year_bin >= -800000))""",
)
def report_windows(spark, sf_dir):
    raw, long_term = past_raw(spark, sf_dir), past_long_term(spark, sf_dir)
    merged = None
    for name in report.WINDOWS:
        view = long_term if name in report.LONG_TERM_WINDOWS else raw
        part = report.series_window(view, name).select(F.lit(name).alias("win"), "year_bin", "anomaly", "co2_ppm")
        merged = part if merged is None else merged.unionByName(part)
    return rounded(merged, ["anomaly", "co2_ppm"], 5)


def past_raw(spark, sf_dir):
    return report.report_base(raw_view(spark, sf_dir))


def past_long_term(spark, sf_dir):
    return long_term_view(spark, sf_dir).where(F.col("year_bin") <= CONFIG.present)


@query(
    "report_co2_trend",
    "R2 A15",
    f"""{RAW} SELECT CASE WHEN year_bin < 1750 THEN 'Before 1750' ELSE '1750-Present' END AS period, CASE WHEN var_pop(co2_ppm) > 0 THEN {r('regr_slope(anomaly, co2_ppm)')} END AS slope,
      {r('regr_intercept(anomaly, co2_ppm)', 4)} AS intercept, {r('regr_r2(anomaly, co2_ppm)')} AS r2, regr_count(anomaly, co2_ppm)::BIGINT AS n FROM raw GROUP BY 1""",
)
def report_co2_trend(spark, sf_dir):
    _, lines = report.anomaly_by_co2(past_raw(spark, sf_dir))
    return rounded(rounded(lines, ["slope", "r2"]), ["intercept"], 4)


CYCLES = ["anomaly", "co2_ppm", "eccentricity", "global_insolation"]


@query(
    "report_glacial_cycles",
    "R3 C13 A4 C15 J10",
    f"""{RAW}, {SPANS}, p AS (SELECT year_bin, {', '.join(CYCLES)} FROM raw WHERE year_bin <= 1850),
    b AS (SELECT {', '.join(f'min({c}) AS lo_{c}, max({c}) AS hi_{c}' for c in CYCLES)} FROM p),
    s AS (SELECT year_bin::DOUBLE AS year_bin, {', '.join(f'({c} - lo_{c}) / (hi_{c} - lo_{c}) AS {c}' for c in CYCLES)} FROM p, b),
    l AS (SELECT year_bin, variable, value FROM s UNPIVOT INCLUDE NULLS (value FOR variable IN ({', '.join(CYCLES)})) WHERE year_bin >= -650000)
    SELECT year_bin, variable, {r('value')} AS value, label FROM l LEFT JOIN spans ON year_bin BETWEEN lo AND hi""",
)
def report_glacial_cycles(spark, sf_dir):
    return rounded(report.glacial_cycles(past_raw(spark, sf_dir)), ["value"])


@query(
    "report_scatter",
    "R4",
    f"""{RAW}, p AS (SELECT * FROM raw WHERE year_bin <= 1850), b AS (SELECT min(anomaly) AS l0, max(anomaly) AS h0, min(eccentricity) AS l1, max(eccentricity) AS h1,
      min(global_insolation) AS l2, max(global_insolation) AS h2 FROM p)
    SELECT year_bin, 'eccentricity' AS predictor, {r('(eccentricity - l1) / (h1 - l1)')} AS x, {r('(anomaly - l0) / (h0 - l0)')} AS y, year_bin >= -12000 AS post_ice_age FROM p, b
    UNION ALL SELECT year_bin, 'global_insolation', {r('(global_insolation - l2) / (h2 - l2)')}, {r('(anomaly - l0) / (h0 - l0)')}, year_bin >= -12000 FROM p, b""",
)
def report_scatter(spark, sf_dir):
    return rounded(report.scatter_pairs(past_raw(spark, sf_dir)), ["x", "y"])


@query(
    "report_modulation",
    "R5",
    f"""{LONG}, {SPANS}, ends AS (SELECT min(solar_modulation) AS l0, max(solar_modulation) AS h0, min(anomaly) AS l1, max(anomaly) AS h1 FROM lt)
    SELECT year_bin, {r('(solar_modulation - l0) / (h0 - l0)', 5)} AS solar_modulation, {r('(anomaly - l1) / (h1 - l1)', 5)} AS anomaly, label
    FROM lt LEFT JOIN spans ON year_bin BETWEEN lo AND hi, ends""",
)
def report_modulation(spark, sf_dir):
    return rounded(report.modulation_overlay(past_long_term(spark, sf_dir)), ["solar_modulation", "anomaly"], 5)


@query(
    "report_predictions",
    "R6 P9 P26",
    f"""WITH {BASE_CTES}, p AS (SELECT year_bin, CASE WHEN year_bin <= 2025 THEN anomaly END AS anomaly, ln(co2_ppm) AS a, insolation / 3 AS b FROM base WHERE year_bin <= 200000)
    SELECT 'Linear Model' AS model, year_bin, {r('anomaly')} AS anomaly, {r('a')} AS pred_anomaly,
      CASE WHEN year_bin BETWEEN -500000 AND -300000 THEN 'Test' WHEN year_bin <= 2025 THEN 'Train' ELSE 'Forecast' END AS band FROM p
    UNION ALL SELECT 'Arima Model', year_bin, {r('anomaly')}, CASE WHEN year_bin > 2025 THEN {r('b')} END, CASE WHEN year_bin > 2025 THEN 'Forecast' ELSE 'Train' END FROM p""",
)
def report_predictions(spark, sf_dir):
    rows = base(spark, sf_dir)
    predictions = {
        "linear_model": rows.select("year_bin", "anomaly", F.ln("co2_ppm").alias("pred_anomaly")),
        "arima_model": rows.select("year_bin", "anomaly", (F.col("insolation") / 3).alias("pred_anomaly")),
    }
    return rounded(report.prediction_report(predictions, CONFIG), ["anomaly", "pred_anomaly"])


@query(
    "report_predictions_scored",
    "R6 M13",
    f"""WITH {BASE_CTES}, p AS (SELECT year_bin, CASE WHEN year_bin <= 2025 THEN anomaly END AS anomaly, ln(co2_ppm) AS a, insolation / 3 AS b FROM base WHERE year_bin <= 200000),
    s AS (SELECT avg(pow(anomaly - a, 2)) AS mse FROM p),
    z AS (SELECT *, CASE WHEN year_bin BETWEEN -500000 AND -300000 THEN 'Test' WHEN year_bin <= 2025 THEN 'Train' ELSE 'Forecast' END AS band FROM p)
    SELECT 'Linear Model' AS model, year_bin, {r('anomaly')} AS anomaly, {r('a')} AS pred_anomaly, band, {r('mse', 4)} AS mse FROM z, s
    UNION ALL SELECT 'Arima Model', year_bin, {r('anomaly')}, CASE WHEN year_bin > 2025 THEN {r('b')} END, CASE WHEN year_bin > 2025 THEN 'Forecast' ELSE 'Train' END, NULL FROM z
    UNION ALL SELECT 'Default', year_bin, {r('anomaly')}, NULL, band, NULL FROM z""",
)
def report_predictions_scored(spark, sf_dir):
    """All panels: the actual values alone, and each model with its error on the scoreboard."""
    rows = base(spark, sf_dir)
    linear = rows.select("year_bin", "anomaly", F.ln("co2_ppm").alias("pred_anomaly"))
    predictions = {"linear_model": linear, "arima_model": rows.select("year_bin", "anomaly", (F.col("insolation") / 3).alias("pred_anomaly"))}
    path = scratch_path(spark, "scoreboard")
    judged = linear.where((F.col("year_bin") <= CONFIG.present) & (F.col("year_bin") <= CONFIG.forecast_end))
    board = upsert_metric(spark, path, mse(judged, "anomaly", "pred_anomaly").select(F.lit("linear_model").alias("model"), "mse"))
    shown = report.prediction_report(predictions, CONFIG, actual=rows.select("year_bin", "anomaly"), scores=board)
    return rounded(rounded(shown, ["anomaly", "pred_anomaly"]), ["mse"], 4)


@query(
    "report_latest",
    "R1 W12",
    f"""{RAW} SELECT year_bin, {r('anomaly')} AS anomaly, concat(year_bin, ': Anomaly of ', CASE WHEN anomaly >= 0 THEN '+' ELSE '' END, printf('%.2f', anomaly), '°C') AS label
    FROM raw WHERE anomaly IS NOT NULL ORDER BY year_bin DESC LIMIT 1""",
)
def report_latest(spark, sf_dir):
    return rounded(report.latest_label(past_raw(spark, sf_dir)), ["anomaly"])


@query(
    "window_errors",
    "A12 C14",
    f"""WITH {BASE_CTES}, p AS (SELECT CASE WHEN year_bin BETWEEN -500000 AND -300000 THEN 'test' ELSE 'train' END AS split, anomaly, ln(co2_ppm) AS a FROM base WHERE year_bin <= 2025)
    SELECT split, {r('avg(pow(anomaly - a, 2))')} AS mse, count(*) AS n FROM p GROUP BY 1""",
)
def window_errors(spark, sf_dir):
    predicted = base(spark, sf_dir).select("year_bin", "anomaly", F.ln("co2_ppm").alias("pred_anomaly"))
    return rounded(modeling.window_errors(predicted, CONFIG), ["mse"])


_TRENDS = " UNION ALL ".join(
    f"""SELECT '{c}' AS predictor, {r(f'regr_slope(anomaly, {v})', 5)} AS slope, {r(f'regr_intercept(anomaly, {v})', 5)} AS intercept, regr_count(anomaly, {v})::BIGINT AS n FROM lt"""
    for c, v in [
        (c, "CASE WHEN global_insolation >= 0 THEN sqrt(greatest(global_insolation, 0)) END" if c == "global_insolation" else c)
        for c in report.PREDICTORS
    ]
)


@query("report_predictor_trends", "R8 A15", f"{LONG} {_TRENDS}")
def report_predictor_trends(spark, sf_dir):
    lines = report.predictor_trends(past_long_term(spark, sf_dir)).drop("r2")
    return rounded(lines, ["slope", "intercept"], 5)
