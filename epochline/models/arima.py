"""ARIMA models of many series at once, by two regressions (Hannan and Rissanen).

Differences and lags of a series are ordered columns, so a model of order (p, d, q) is a regression on them. Where
moving-average terms are asked for, a long autoregression comes first; its residuals, lagged in turn, stand for
the unknown shocks in the second regression. Both regressions need only the moments of each series, one combined
aggregate per difference. All orders are solved from these moments, for all series of a batch at once, and are
compared on the same rows by the corrected Akaike criterion; models of other differences predict the same values one step
ahead, so they can be compared too.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochline.functions.columns import names
from epochline.models.linear import gram, solve_many, squared_errors, unpack_many
from epochline.operators.ordered import Lag, with_ordered
from epochline.session import settle, sized

Order = tuple[int, int, int]
FIT_TYPE = (
    "struct<p int, d int, q int, intercept double, phi array<double>, theta array<double>, beta array<double>, "
    "ar array<double>, sigma double, aicc double, n bigint>"
)
#: Lags of the first regression that estimates shocks.
LONG_AR = 8


def _difference(cols: Sequence[Column], d: int) -> Column:
    """The d-th difference of a column from it and its lags."""
    return reduce(lambda a, b: a + b, [c * float((-1) ** i * comb(d, i)) for i, c in enumerate(cols[: d + 1])])


def _expanded(phi: np.ndarray, d: int, size: int) -> np.ndarray:
    """Weights of earlier values when (1 - phi(B))(1 - B)^d of a series is white noise."""
    left = np.concatenate([[1.0], -phi])
    for _ in range(d):
        left = np.convolve(left, [1.0, -1.0])
    return np.pad(-left[1:], (0, size - len(left) + 1))


def _choice(orders: Sequence[Order], p_max: int, q_max: int, n_exog: int, size: int):
    """A function that picks the order of each series by the corrected Akaike criterion, all series of a batch at once."""
    ds = sorted({d for _, d, _ in orders})

    def fit(*grams: pd.Series) -> pd.DataFrame:
        count = len(grams[0])
        best = [None] * count
        score = np.full(count, np.inf)
        rows = np.zeros(count)
        for d, flat in zip(ds, grams):
            n, mean, comoment = unpack_many(flat, p_max + q_max + n_exog + 1)
            rows = n
            for p, _, q in (o for o in orders if o[1] == d):
                used = [*range(1, p + 1), *range(p_max + 1, p_max + q + 1), *range(p_max + q_max + 1, p_max + q_max + n_exog + 1)]
                params = len(used) + 2
                beta = solve_many(n, mean, comoment, used)
                error = squared_errors(n, mean, comoment, used, beta)
                with np.errstate(divide="ignore", invalid="ignore"):
                    aicc = n * np.log(np.maximum(error / n, 1e-300)) + 2 * params + 2 * params * (params + 1) / (n - params - 1)
                for i in np.flatnonzero((n > params + 1) & (aicc < score)).tolist():
                    b = beta[i]
                    score[i] = aicc[i]
                    best[i] = {
                        "p": p,
                        "d": d,
                        "q": q,
                        "intercept": float(b[0]),
                        "phi": b[1 : p + 1].tolist(),
                        "theta": b[p + 1 : p + q + 1].tolist(),
                        "beta": b[p + q + 1 :].tolist(),
                        "ar": _expanded(b[1 : p + 1], d, size).tolist(),
                        "sigma": float(np.sqrt(error[i] / max(n[i] - len(used) - 1, 1))),
                        "aicc": float(aicc[i]),
                    }
        none = {c: None for c in ("p", "d", "q", "intercept", "sigma", "aicc")} | {c: [] for c in ("phi", "theta", "beta", "ar")}
        found = pd.DataFrame([(b or none) | {"n": int(n)} for b, n in zip(best, rows)])
        return found[["p", "d", "q", "intercept", "phi", "theta", "beta", "ar", "sigma", "aicc", "n"]].astype({"p": "Int32", "d": "Int32", "q": "Int32"})

    # Kept out of filters and never repeated, as a deterministic function might be.
    return F.pandas_udf(fit, FIT_TYPE).asNondeterministic()


def _long_fit(size: int):
    def fit(flat: pd.Series) -> pd.Series:
        n, mean, comoment = unpack_many(flat, size)
        return pd.Series(solve_many(n, mean, comoment, list(range(1, size))).tolist())

    return F.pandas_udf(fit, "array<double>").asNondeterministic()


def _beside(rows: DataFrame, few: DataFrame, series: list[str]) -> DataFrame:
    """Columns of a row per series beside all its rows; without series, `few` is one row and its values are constants."""
    if series:
        return rows.join(sized(few), series)
    row, kinds = few.first(), dict(few.dtypes)

    def constant(c: str) -> Column:
        value = None if row is None else row[c]
        return (F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value)).cast(kinds[c])

    return rows.withColumns({c: constant(c) for c in few.columns})


def fit_arima(
    df: DataFrame, series: Iterable[str], key: str, y: str, orders: Sequence[Order], exog: Sequence[str] = (), long_ar: int = LONG_AR, **limits
) -> DataFrame:
    """One row per series: chosen (p, d, q), coefficients, spread of the residuals, and what a forecast starts from.

    `orders` are tried in turn; all are compared on the rows that have every lag that any of them needs. `ar` are the weights of
    earlier values in levels, `recent` and `shocks` the last values and residuals, newest first, `inputs` the last
    values of the `exog` columns, which are differenced as the series is. A series too short for any order has null orders.
    """
    series, exog, orders = names(series), list(exog), [tuple(o) for o in orders]
    ds = sorted({d for _, d, _ in orders})
    p_max, d_max, q_max = (max(o[k] for o in orders) for k in range(3))
    p_max = max(p_max, 1)
    size = p_max + d_max
    lags = d_max + max(p_max, long_ar if q_max else 0)
    cast = [F.col(c).cast("double").alias(c) for c in exog]
    rows = settle(df.select(*series, key, F.col(y).cast("double").alias("__y0"), *cast).where(F.col("__y0").isNotNull()), "series")
    exprs = {f"__y{k}": Lag("__y0", k=k) for k in range(1, lags + 1)}
    exprs |= {f"__x{i}_{k}": Lag(c, k=k) for i, c in enumerate(exog) for k in range(1, d_max + 1)}
    lagged = with_ordered(rows, key, exprs, series, **limits)
    lagged = settle(lagged.withColumns({f"__x{i}_0": F.col(c) for i, c in enumerate(exog)}), "lagged")

    def change(d: int, k: int = 0) -> Column:
        return _difference([F.col(f"__y{k + i}") for i in range(d + 1)], d)

    def driven(d: int) -> list[Column]:
        return [_difference([F.col(f"__x{i}_{k}") for k in range(d + 1)], d) for i in range(len(exog))]

    if q_max:
        for d in ds:
            x = [change(d, k) for k in range(1, long_ar + 1)] + driven(d)
            used = lagged.select(*series, change(d).alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(x)])
            long = gram(used, [f"x{i}" for i in range(len(x))], "y", series).select(*series, _long_fit(len(x) + 1)("g").alias("__long"))
            lagged = _beside(lagged, long, series)
            fitted = reduce(lambda a, b: a + b, [F.get("__long", F.lit(i + 1)) * c for i, c in enumerate(x)], F.get("__long", F.lit(0)))
            lagged = lagged.withColumn(f"__e{d}_0", change(d) - fitted).drop("__long")
        shocks = {f"__e{d}_{k}": Lag(f"__e{d}_0", k=k) for d in ds for k in range(1, q_max + 1)}
        lagged = settle(with_ordered(settle(lagged, "shocks"), key, shocks, series, **limits), "lagged")

    enough = F.col(f"__y{d_max + p_max}").isNotNull()  # the same rows for all orders
    for d in ds if q_max else []:
        enough = enough & F.col(f"__e{d}_{q_max}").isNotNull()
    grams = None
    for d in ds:
        x = [change(d, k) for k in range(1, p_max + 1)]
        x += [F.col(f"__e{d}_{k}") for k in range(1, q_max + 1)] + driven(d)
        used = lagged.where(enough).select(*series, change(d).alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(x)])
        own = gram(used, [f"x{i}" for i in range(len(x))], "y", series).withColumnRenamed("g", f"__g{d}")
        grams = own if grams is None else (grams.join(own, series) if series else _beside(grams, own, series))
    pick = _choice(orders, p_max, q_max, len(exog), size)
    fits = grams.select(*series, pick(*[f"__g{d}" for d in ds]).alias("fit"))

    # The newest row carries its own lags, so one row per series is all a forecast starts from.
    kept = [f"__y{k}" for k in range(size)] + [f"__e{d}_{k}" for d in ds for k in range(q_max)] + [f"__x{i}_{k}" for i in range(len(exog)) for k in range(d_max)]
    ends = lagged.groupBy(*series).agg(F.max(key).alias("last_key"), *[F.max_by(c, key).alias(c) for c in kept])
    joined = fits.join(ends, series) if series else _beside(fits, ends, series)
    array = lambda cols: F.array(*cols).cast("array<double>")
    own = [F.when(F.col("fit.d") == d, array([f"__e{d}_{k}" for k in range(q_max)])) for d in ds] if q_max else [array([])]
    inputs = F.array(*[array([f"__x{i}_{k}" for i in range(len(exog))]) for k in range(d_max)]).cast("array<array<double>>")
    return joined.select(*series, "fit.*", "last_key", array([f"__y{k}" for k in range(size)]).alias("recent"), F.coalesce(*own).alias("shocks"), inputs.alias("inputs"))


def _walk(horizon: int, n_exog: int):
    """Forecasts of all series of a batch and the spread of each step; the steps are the only loop."""

    def stacked(rows: pd.Series, size: int) -> np.ndarray:
        out = np.zeros((len(rows), size))
        for i, r in enumerate(rows):
            if r is not None and len(r):
                out[i, : len(r)] = r
        return out

    def walk(start: pd.DataFrame) -> pd.DataFrame:
        count = len(start)
        width = lambda c: max((len(r) for r in start[c] if r is not None), default=0)
        ar, theta, beta = (stacked(start[c], width(c)) for c in ("ar", "theta", "beta"))
        values, shocks = stacked(start["recent"], ar.shape[1]), np.zeros((count, theta.shape[1]))
        shocks[:] = stacked(start["shocks"], max(width("shocks"), theta.shape[1]))[:, : theta.shape[1]]
        constant = start["intercept"].to_numpy(float)
        outer = np.zeros((count, horizon))
        if n_exog:
            past = width("inputs")
            x = np.full((count, past + horizon, n_exog), np.nan)
            for i, (before, after) in enumerate(zip(start["inputs"], start["future"])):
                for k, r in enumerate(before if before is not None else []):
                    x[i, past - 1 - k] = np.asarray(r, float)
                for k, r in enumerate(after if after is not None else []):
                    if r is not None:
                        x[i, past + k] = np.asarray(r, float)
            for d in sorted(set(start["d"].dropna().astype(int))):
                changed = sum((-1) ** j * comb(d, j) * x[:, past - j : past - j + horizon] for j in range(d + 1))
                own = (start["d"] == d).to_numpy(bool, na_value=False)
                outer[own] = np.einsum("sht,st->sh", changed[own], beta[own])
        pred, psi = np.zeros((count, horizon)), np.zeros((count, horizon))
        for h in range(horizon):
            pred[:, h] = constant + (ar * values).sum(axis=1) + (theta * shocks).sum(axis=1) + outer[:, h]
            values = np.concatenate([pred[:, h : h + 1], values], axis=1)[:, : ar.shape[1]]
            shocks = np.concatenate([np.zeros((count, 1)), shocks], axis=1)[:, : theta.shape[1]]
            psi[:, h] = 1.0 if h == 0 else theta[:, h - 1] if h <= theta.shape[1] else 0.0
            for k in range(1, min(h, ar.shape[1]) + 1):
                psi[:, h] += ar[:, k - 1] * psi[:, h - k]
        spread = start["sigma"].to_numpy(float)[:, None] * np.sqrt(np.cumsum(psi**2, axis=1))
        return pd.DataFrame({"pred": pred.tolist(), "spread": spread.tolist()})

    return F.pandas_udf(walk, "struct<pred array<double>, spread array<double>>").asNondeterministic()


def arima_forecast(
    df: DataFrame,
    series: Iterable[str],
    key: str,
    y: str,
    horizon: int,
    orders: Sequence[Order],
    exog: Sequence[str] = (),
    future: DataFrame | None = None,
    step: float = 1,
    z: float | None = None,
    echo: bool = False,
    long_ar: int = LONG_AR,
    **limits,
) -> DataFrame:
    """`horizon` steps past the end of each series, with intervals that widen with the steps if `z` is given.

    A step's interval is `pred ± z` times its spread: that of the residuals times the root of the summed squares of the weights that
    earlier shocks have at that step. `future` holds the values of the `exog` columns at the future keys; a step without
    them has no prediction. `echo` also returns the known rows, with the actual value as prediction.
    """
    series, exog = names(series), list(exog)
    fits = fit_arima(df, series, key, y, orders, exog, long_ar, **limits).where(F.col("p").isNotNull())
    if exog:
        fits = _with_future(settle(fits, "fits"), future, series, key, exog, horizon, step)
    else:
        fits = fits.withColumn("future", F.lit(None).cast("array<array<double>>"))
    needed = ["d", "intercept", "theta", "beta", "ar", "sigma", "recent", "shocks", "inputs", "future"]
    walked = fits.withColumn("walk", _walk(horizon, len(exog))(F.struct(*needed)))
    out = walked.select(*series, "last_key", F.posexplode(F.arrays_zip("walk.pred", "walk.spread")).alias("__i", "__at"))
    known = lambda c: F.when(~F.isnan(c), c)
    pred, spread = known(F.col("__at.pred")), F.col("__at.spread")
    columns = {key: F.col("last_key") + (F.col("__i") + 1) * F.lit(step), "step": (F.col("__i") + 1).cast("int"), "pred": pred}
    if z is not None:
        columns |= {"lo": pred - z * spread, "hi": pred + z * spread}
    out = out.select(*series, *[c.alias(n) for n, c in columns.items()])
    if not echo:
        return out
    past = df.select(*series, F.col(key), F.lit(0).alias("step"), F.col(y).cast("double").alias("pred"))
    return past.unionByName(out, allowMissingColumns=True)


def _with_future(fits: DataFrame, future: DataFrame, series: list[str], key: str, exog: list[str], horizon: int, step: float) -> DataFrame:
    """Column `future`: the exogenous values of each step.

    A key between two steps belongs to neither; several values at one step are averaged.
    """
    later = _beside(future, fits.select(*series, "last_key"), series)
    at = (F.col(key) - F.col("last_key")) / F.lit(step)
    later = later.where(F.abs(at - F.round(at)) < 1e-9).withColumn("__step", F.round(at).cast("int")).where(F.col("__step").between(1, horizon))
    later = later.groupBy(*series, "__step").agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in exog])
    known = later.groupBy(*series).agg(F.map_from_entries(F.collect_list(F.struct("__step", F.array(*exog).alias("x")))).alias("__known"))
    if series:
        fits = fits.join(known, series, "left")
    else:  # `horizon` entries at most
        entries = (known.first() or {"__known": {}})["__known"] or {}
        flat = [e for k, v in sorted(entries.items()) for e in (F.lit(k), F.array(*map(F.lit, v)))]
        fits = fits.withColumn("__known", F.create_map(*flat).cast("map<int,array<double>>"))
    steps = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda s: F.try_element_at("__known", s))
    return fits.withColumn("future", steps.cast("array<array<double>>")).drop("__known")
