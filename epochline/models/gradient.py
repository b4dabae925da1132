"""Gradient descent with early stopping under cross-validation, without looking at the data again after one pass.

A model that is linear in a fixed basis (hinges of the features, say) has a squared error that the moments of the basis
determine. The moments of each fold are one combined aggregate; from there on every step of the descent, its error on
the rows it trains on and its error on the rows held out are sums over small matrices. Steps stop when the held-out error
has not improved for `patience` steps, and the best step counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochline.models.linear import LinearModel, Moments, assign_folds, collect_grams, gram, merged


def hinges(knots: Mapping[str, Sequence[float]]) -> dict[str, Column]:
    """A basis for continuous, piecewise linear effects: each feature, and what it exceeds each knot by."""
    out = {}
    for c, at in knots.items():
        out[c] = F.col(c).cast("double")
        out |= {f"{c}_above_{k}": F.greatest(F.col(c).cast("double") - F.lit(float(v)), F.lit(0.0)) for k, v in enumerate(at)}
    return out


def quantile_knots(df: DataFrame, cols: Iterable[str], n: int) -> dict[str, list[float]]:
    """`n` knots per feature at its approximate quantiles, without repeats."""
    cols, at = list(cols), [(k + 1) / (n + 1) for k in range(n)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), at).alias(c) for c in cols]).first()
    return {c: sorted(set(row[c] or [])) for c in cols}


@dataclass(frozen=True)
class Descent:
    """Step width, L2 penalty of the scaled weights, most steps, and steps without improvement after which it ends."""

    rate: float = 0.05
    penalty: float = 0.0
    steps: int = 2000
    patience: int = 10


@dataclass(frozen=True)
class Stopped:
    """What a fold came to: the step that counts, the one it ended at, the held-out error of the former, and its model."""

    fold: int
    best_step: int
    last_step: int
    mse: float
    model: LinearModel


def _error(moments: Moments, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, base: float) -> float:
    """Mean squared error of `base + w · (x - mean) / scale` on the rows behind the moments."""
    weights = np.append(-w / scale, 1.0)
    bias = moments.mean[-1] - base - (w / scale) @ (moments.mean[:-1] - mean)
    return max(float(weights @ moments.comoment @ weights) / moments.n, 0.0) + float(bias) ** 2


def descend(folds: Mapping[int, Moments], basis: Sequence[str], how: Descent = Descent()) -> list[Stopped]:
    """For each fold, descent on the others from weights of zero, judged on it after every step.

    Features are scaled to unit variance on the rows that are trained on; a constant one keeps weight zero. The gradient is
    that of half the mean squared error and half `penalty` times the squared weights.
    """
    out = []
    for fold in sorted(folds):
        rest = [m for f, m in sorted(folds.items()) if f != fold]
        if not rest:
            raise ValueError("early stopping needs two folds with complete rows")
        train, held = merged(rest), folds[fold]
        mean, base = train.mean[:-1], float(train.mean[-1])
        spread = np.sqrt(np.diag(train.comoment)[:-1] / train.n)
        scale = np.where(spread > 1e-13 * np.abs(mean), spread, np.inf)
        a = train.comoment[:-1, :-1] / train.n / np.outer(scale, scale)
        b = train.comoment[:-1, -1] / train.n / scale
        w = np.zeros(len(basis))
        best, best_step, best_w, step = _error(held, mean, scale, w, base), 0, w, 0
        while step < how.steps and step - best_step < how.patience:
            w = w - how.rate * (a @ w - b + how.penalty * w)
            step += 1
            error = _error(held, mean, scale, w, base)
            if error < best:
                best, best_step, best_w = error, step, w
        coefs = best_w / scale
        out.append(Stopped(fold, best_step, step, best, LinearModel(tuple(basis), float(base - coefs @ mean), tuple(map(float, coefs)))))
    return out


def early_stopped(
    df: DataFrame,
    basis: Mapping[str, Column],
    y: str,
    key: str,
    k: int = 10,
    seed: int = 42,
    how: Descent = Descent(),
    fold: str | None = None,
    **folding,
) -> tuple[list[Stopped], list[str]]:
    """k-fold descent over a basis. `fold` names a column that has the folds; otherwise they are assigned as in `assign_folds`."""
    names = [f"__b{i}" for i in range(len(basis))]
    folded = df if fold is not None else assign_folds(df, key, k, seed, **folding)
    rows = folded.select(F.col(fold or "fold").alias("fold"), F.col(y), *[c.alias(n) for n, c in zip(names, basis.values())])
    grams = collect_grams(gram(rows, names, y, ["fold"]), len(names) + 1)
    return descend({f: m for (f,), m in grams.items()}, list(basis), how), list(basis)


def predict_stopped(df: DataFrame, basis: Mapping[str, Column], stopped: Sequence[Stopped], out: str = "pred") -> DataFrame:
    """Mean prediction of the folds' models, as one expression over the basis."""
    n = float(len(stopped))
    total = F.lit(sum(s.model.intercept for s in stopped) / n)
    for i, c in enumerate(basis.values()):
        total = total + c * F.lit(sum(s.model.coefs[i] for s in stopped) / n)
    return df.withColumn(out, total)


def table(spark, stopped: Sequence[Stopped]) -> DataFrame:
    rows = [(s.fold, s.best_step, s.last_step, s.mse) for s in stopped]
    return spark.createDataFrame(rows, "fold int, best_step int, last_step int, mse double")
