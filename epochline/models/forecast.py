"""Autoregressive forecasts for many series at once: the cases of `arima` that need no differences and no shocks, and backtests."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochline.functions.columns import names
from epochline.models.arima import LONG_AR, Order, arima_forecast, fit_arima
from epochline.operators.ordered import Position, Size, with_ordered
from epochline.operators.stats import mse
from epochline.session import settle


def fit_ar(
    df: DataFrame, series: Iterable[str], key: str, y: str, p_grid: Sequence[int], exog: Sequence[str] = (), **limits
) -> DataFrame:
    """One row per series: chosen order, coefficients, residual spread, and its last values (newest first)."""
    fits = fit_arima(df, series, key, y, [(p, 0, 0) for p in p_grid], exog, **limits)
    return fits.select(*names(series), "p", "intercept", "phi", "beta", "sigma", "aicc", "n", "last_key", "recent")


def ar_forecast(
    df: DataFrame,
    series: Iterable[str],
    key: str,
    y: str,
    horizon: int,
    p_grid: Sequence[int] = (1, 2, 3),
    exog: Sequence[str] = (),
    future: DataFrame | None = None,
    step: float = 1,
    z: float | None = None,
    echo: bool = False,
    **limits,
) -> DataFrame:
    """`arima_forecast` of orders (p, 0, 0)."""
    return arima_forecast(df, series, key, y, horizon, [(p, 0, 0) for p in p_grid], exog, future, step, z, echo, **limits)


def backtest(
    df: DataFrame,
    series: Iterable[str],
    key: str,
    y: str,
    horizon: int,
    p_grid: Sequence[int] = (1, 2, 3),
    origins: Sequence[int] = (0,),
    orders: Sequence[Order] | None = None,
    long_ar: int = LONG_AR,
    **limits,
) -> DataFrame:
    """Error of forecasts from inside the known rows, per series and origin.

    Origin 0 withholds the last `horizon` rows of each series, origin n ends n rows earlier. A forecast
    that merely echoes the past has no error to speak of; this is the one that can be compared. `orders` take
    the place of `p_grid`.
    """
    series = names(series)
    orders = [(p, 0, 0) for p in p_grid] if orders is None else orders
    rows = df.select(*series, key, F.col(y).cast("double").alias(y)).where(F.col(y).isNotNull())
    exprs = {"__pos": Position(), "__rows": Size()}
    placed = settle(with_ordered(settle(rows, "series"), key, exprs, series, **limits), "placed")
    result = None
    for origin in origins:
        step = (F.col("__pos") - (F.col("__rows") - F.lit(horizon + origin))).cast("int")
        stepped = placed.withColumn("step", step)
        known = stepped.where(F.col("step") <= 0).drop("__pos", "__rows", "step")
        ahead = arima_forecast(known, series, key, y, horizon, orders, long_ar=long_ar, **limits).select(*series, "step", "pred")
        truth = stepped.where(F.col("step").between(1, horizon)).select(*series, "step", y)
        scored = mse(truth.join(ahead, [*series, "step"]), y, "pred", series).withColumn("origin", F.lit(origin))
        result = scored if result is None else result.unionByName(scored)
    return result
