"""From the training view to predictions and a scoreboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochline.functions.columns import null_after, round_all
from epochline.models.forecast import ar_forecast
from epochline.models.linear import (
    CrossValidation,
    Stepwise,
    collect_grams,
    cross_validate,
    fit_matrix,
    gram,
    predict_ensemble,
    stepwise,
)
from epochline.models.search import SearchConfig, retrain, search
from epochline.models.trees import gbt_kfold
from epochline.operators.star import range_split
from epochline.plans.config import FlowConfig
from epochline.plans.views import KEY, TARGET, feature_columns

PRED = "pred_anomaly"


def split_training(training: DataFrame, config: FlowConfig = FlowConfig()) -> tuple[DataFrame, DataFrame]:
    """The whole frame with future targets blanked and a `split` label, and its training rows."""
    whole = null_after(training, KEY, config.present, [TARGET])
    whole = range_split(whole, KEY, (config.test_start, config.test_end), config.present, config.forecast_end)
    return whole, whole.where(F.col("split") == "train").drop("split")


def _prediction_columns(df: DataFrame, config: FlowConfig) -> DataFrame:
    return round_all(df.select(KEY, TARGET, PRED), config.places, exclude=[KEY])


def linear_predictions(
    training: DataFrame,
    config: FlowConfig = FlowConfig(),
    lagged: bool = True,
    k: int = 5,
    seed: int = 42,
    rule: Stepwise | None = Stepwise(),
) -> tuple[DataFrame, CrossValidation]:
    """Stepwise least squares under stratified folds; the prediction is the mean of the fold models."""
    whole, train = split_training(training, config)
    x = [c for c in feature_columns(training) if lagged or "lagged" not in c]
    result = cross_validate(train, x, TARGET, KEY, k, seed, rule=rule, stratify=TARGET)
    return _prediction_columns(predict_ensemble(whole, result.models, PRED), config), result


def tree_predictions(training: DataFrame, config: FlowConfig = FlowConfig(), k: int = 10, seed: int = 42, **gbt):
    whole, train = split_training(training, config)
    predicted, errors = gbt_kfold(train, feature_columns(training), TARGET, KEY, k, seed, full=whole, out=PRED, **gbt)
    return _prediction_columns(predicted, config), sum(errors) / len(errors)


def searched_predictions(training: DataFrame, config: FlowConfig = FlowConfig(), settings: SearchConfig = SearchConfig()):
    """Predictions of the model found by the search, its error, and the history of the search."""
    whole, train = split_training(training, config)
    x = feature_columns(training)
    best, history = search(train, x, TARGET, KEY, settings)
    final = retrain(train, x, TARGET, KEY, best, settings)
    return _prediction_columns(predict_ensemble(whole, final.models, PRED), config), final.mse, history


def forecast_predictions(
    training: DataFrame,
    config: FlowConfig = FlowConfig(),
    exogenous: bool = False,
    p_grid: tuple[int, ...] = (1, 2, 3, 4, 5),
    rule: Stepwise = Stepwise(),
) -> DataFrame:
    """Autoregressive forecast of the target, optionally with the features that stepwise selection keeps.

    Known rows carry the actual value as their prediction.
    """
    whole, _ = split_training(training, config)
    past, future = whole.where(F.col(KEY) <= config.present), whole.where(F.col(KEY) > config.present)
    exog: list[str] = []
    if exogenous:
        x = feature_columns(training)
        matrix = collect_grams(gram(past, x, TARGET), len(x) + 1)[()]
        exog = list(fit_matrix(matrix, x, stepwise(matrix, rule)).features)
    horizon = future.count()
    ahead = ar_forecast(
        past, [], KEY, TARGET, horizon, p_grid, exog=exog, future=future.select(KEY, *exog) if exog else None, step=config.width
    )
    joined = whole.join(ahead.select(F.col(KEY).cast("bigint").alias(KEY), F.col("pred")), KEY, "left")
    return _prediction_columns(joined.withColumn(PRED, F.coalesce(F.col("pred"), F.col(TARGET))), config)


def window_errors(predictions: DataFrame, config: FlowConfig = FlowConfig()) -> DataFrame:
    """Mean squared error inside and outside the test window, past rows only."""
    past = range_split(predictions, KEY, (config.test_start, config.test_end), config.present)
    past = past.where(F.col("split") != "forecast")
    return past.groupBy("split").agg(
        F.avg(F.pow(F.col(TARGET) - F.col(PRED), 2)).alias("mse"), F.count(F.lit(1)).alias("n")
    )
