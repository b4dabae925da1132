"""The whole flow in stages that meet at files: star schema, views, models, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochline.functions.columns import round_all
from epochline.models.search import SearchConfig
from epochline.plans import modeling, report, views
from epochline.plans.config import FlowConfig
from epochline.plans.star_build import STAR_TABLES, RawInputs, build_star
from epochline.sources.files import write_parquet, write_predictions
from epochline.sources.metrics import read_metrics, scoreboard, upsert_metric

VIEW_NAMES = ("raw_view", "long_term_view", "training_view")
FORECASTERS = ("arima_model", "arimax_model")


def run_star(inputs: RawInputs, out: str, id_cols=None, update=None, ids: str = "dense") -> None:
    """Build the star schema and write its tables (or only those in `update`) under `out`.

    Rejected records and doubtful temperatures are written beside them, for review.
    """
    left: dict[str, DataFrame] = {}
    tables = build_star(inputs, id_cols, ids, left)
    for name, df in (tables | left).items():
        if update is None or name in update:
            write_parquet(df, f"{out}/{name}")


def run_views(spark: SparkSession, star_dir: str, out: str, config: FlowConfig = FlowConfig(), fill: float | None = None) -> None:
    """Read the star schema and write the three views. `fill` replaces missing targets in the training view."""
    tables = {name: spark.read.parquet(f"{star_dir}/{name}") for name in STAR_TABLES if name != "dim_location"}
    fact = tables.pop("fact_temperature")
    base = views.joined_base(fact, tables, config)
    write_parquet(views.raw_view(base, config), f"{out}/raw_view")
    resampled = views.resampled_view(base, config)
    write_parquet(views.long_term_view(resampled), f"{out}/long_term_view")
    write_parquet(views.training_view(resampled, config, fill), f"{out}/training_view")


def run_models(
    spark: SparkSession,
    views_dir: str,
    out: str,
    config: FlowConfig = FlowConfig(),
    settings: SearchConfig = SearchConfig(),
    folds: int = 5,
    tree_folds: int = 10,
    **gbt,
) -> DataFrame:
    """Fit every model on the training view; write predictions, the search history and the scoreboard."""
    training = spark.read.parquet(f"{views_dir}/training_view")
    scores = {}
    predictions = {}
    for name, lagged in (("linear_model", False), ("lagged_linear_model", True)):
        predictions[name], result = modeling.linear_predictions(training, config, lagged, folds)
        scores[name] = result.mse
    predictions["tree_model"], scores["tree_model"] = modeling.tree_predictions(training, config, tree_folds, **gbt)
    predictions["searched_model"], scores["searched_model"], history = modeling.searched_predictions(training, config, settings)
    predictions["arima_model"] = modeling.forecast_predictions(training, config)
    predictions["arimax_model"] = modeling.forecast_predictions(training, config, exogenous=True)
    for name, df in predictions.items():
        write_predictions(df, f"{out}/{name}_predictions", places=config.places)
    history.write.mode("overwrite").json(f"{out}/search_history")
    rows = spark.createDataFrame([(name, float(mse)) for name, mse in scores.items()], "model string, mse double")
    return upsert_metric(spark, f"{out}/scoreboard", round_all(rows, config.places))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("year_bin bigint, anomaly double, pred_anomaly double").csv(path, header=True)


def _window_errors(predictions: dict[str, DataFrame], config: FlowConfig) -> DataFrame:
    """Error of every model inside and outside of the test window."""
    errors = None
    for model, df in predictions.items():
        rows = modeling.window_errors(df, config).withColumn("model", F.lit(model))
        errors = rows if errors is None else errors.unionByName(rows)
    return errors


def run_reports(spark: SparkSession, views_dir: str, models_dir: str, out: str, config: FlowConfig = FlowConfig()) -> None:
    """Write the plot-ready tables."""
    past = F.col(views.KEY) <= config.present
    raw = report.report_base(spark.read.parquet(f"{views_dir}/raw_view"), (report.RAW_RANGE[0], config.present))
    long_term = spark.read.parquet(f"{views_dir}/long_term_view").where(past)
    points, lines = report.anomaly_by_co2(raw)
    board = read_metrics(spark, f"{models_dir}/scoreboard")
    models = [row.model for row in board.select("model").collect()]
    predictions = {m: read_predictions(spark, f"{models_dir}/{m}_predictions") for m in [*models, *FORECASTERS]}
    history = spark.read.schema("generation int, fitness double").json(f"{models_dir}/search_history")
    tables = {
        "anomaly_vs_co2": points,
        "anomaly_vs_co2_trend": lines,
        "glacial_cycles": report.glacial_cycles(raw),
        "scatter_pairs": report.scatter_pairs(raw),
        "modulation_overlay": report.modulation_overlay(long_term),
        "predictions": report.prediction_report(predictions, config, actual=spark.read.parquet(f"{views_dir}/long_term_view"), scores=board),
        "latest_anomaly": report.latest_label(raw),
        "window_errors": _window_errors(predictions, config),
        "event_markers": report.event_markers(spark),
        "search_progress": report.fitness_by_generation(history),
        "scoreboard": scoreboard(board),
        "predictor_trends": report.predictor_trends(long_term),
    }
    for name in report.WINDOWS:
        view = long_term if name in report.LONG_TERM_WINDOWS else raw
        tables[f"window_{name}"] = report.series_window(view, name)
    for name, df in tables.items():
        write_parquet(df, f"{out}/{name}")
