"""Linear models from one pass over the data.

Everything a least-squares fit needs is in the number of rows, the means and the centred co-moments of
features and target. They merge stably, so they are computed by one map-side combined aggregate whatever the
number of rows and wherever the columns lie (years, keys, epoch times); fits, ridge fits, stepwise selection,
folds and errors then work on these small tables. Features are scaled to unit variance before solving.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochline.functions.columns import names
from epochline.operators.ordered import Position, with_ordered

GROUPS_ON_DRIVER = 10_000
#: Singular values of the scaled features below this share of the largest count as linear dependence.
DEPENDENT = 1e-11


@dataclass(frozen=True)
class Moments:
    """Rows, means and centred co-moments of (x…, y)."""

    n: float
    mean: np.ndarray
    comoment: np.ndarray

    def merge(self, other: Moments) -> Moments:
        """The moments of both sets of rows together, by the pairwise update."""
        if not self.n or not other.n:
            return self if self.n else other
        n, apart = self.n + other.n, other.mean - self.mean
        shift = np.outer(apart, apart) * (self.n * other.n / n)
        return Moments(n, self.mean + apart * (other.n / n), self.comoment + other.comoment + shift)


def merged(parts: Iterable[Moments]) -> Moments:
    return reduce(Moments.merge, parts)


def gram(df: DataFrame, x: Sequence[str], y: str, by: Iterable[str] = (), out: str = "g") -> DataFrame:
    """Moments per group as array `out`: rows, means of x… and y, and the upper triangle of their co-moments row by row.

    Only rows that have all values count.
    """
    by, used = names(by), [*x, y]
    complete = F.lit(True)
    for c in used:
        complete = complete & F.col(c).isNotNull()
    z = [F.col(c).cast("double") for c in used]
    n = F.count(F.lit(1)).cast("double")
    pairs = [(F.covar_pop(z[i], z[j]) if i != j else F.var_pop(z[i])) * n for i in range(len(z)) for j in range(i, len(z))]
    return df.where(complete).groupBy(*by).agg(F.array(n, *[F.avg(c) for c in z], *pairs).alias(out))


def unpack(g: Sequence[float], size: int) -> Moments:
    """Moments of `size` columns from an array of `gram`."""
    flat = np.asarray(g, dtype=float)
    upper = np.zeros((size, size))
    upper[np.triu_indices(size)] = flat[1 + size :]
    return Moments(float(flat[0]), flat[1 : 1 + size], upper + np.triu(upper, 1).T)


def collect_grams(grams: DataFrame, size: int) -> dict[tuple, Moments]:
    """Moments of a few groups (such as folds) on the driver; `size` counts features and target.

    More groups than GROUPS_ON_DRIVER are an error here: `fit_groups` fits any number of them on the executors.
    """
    rows = grams.limit(GROUPS_ON_DRIVER + 1).collect()
    if len(rows) > GROUPS_ON_DRIVER:
        raise ValueError("too many groups for the driver; use fit_groups")
    by = [c for c in grams.columns if c != "g"]
    return {tuple(row[c] for c in by): unpack(row["g"], size) for row in rows if row["g"][0]}


def _scaled(moments: Moments, used: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Spread of the used features and their correlations; a constant one has spread 1 and no correlation."""
    at = np.asarray(used, dtype=int) - 1
    a = moments.comoment[np.ix_(at, at)]
    size = np.abs(moments.mean[at])
    spread = np.sqrt(np.diag(a))
    spread = np.where(spread > 1e-13 * np.sqrt(moments.n) * size, spread, 0.0)
    spread = np.where(spread > 0, spread, 1.0)
    return spread, a / np.outer(spread, spread)


def solve(moments: Moments, used: Sequence[int], lam: float = 0.0, per_row: bool = False) -> np.ndarray:
    """Coefficients (intercept first) for the features at the given positions, counted from 1; `lam` spares the intercept.

    `lam` times the squared coefficients is added to the sum of squared errors. With `per_row` it is added to
    the mean of squared errors, over features of unit variance, so that its effect doesn't fade as rows are
    added. Linearly dependent features share their effect, and a warning says so.
    """
    at = np.asarray(used, dtype=int) - 1
    if not len(at):
        return np.array([moments.mean[-1]])
    spread, a = _scaled(moments, used)
    b = moments.comoment[at, -1] / spread
    # sums of squares of scaled features are 1, so a variance of 1 is a scale of sqrt(n): lam * n / n stays lam
    a = a + np.diag(np.full(len(at), lam) if per_row else lam / spread**2)
    scaled, _, rank, _ = np.linalg.lstsq(a, b, rcond=DEPENDENT)
    if rank < len(at):
        warnings.warn(f"{len(at) - rank} of {len(at)} features depend linearly on others", stacklevel=2)
    coefs = scaled / spread
    return np.concatenate([[moments.mean[-1] - moments.mean[at] @ coefs], coefs])


def squared_error(moments: Moments, used: Sequence[int], beta: np.ndarray) -> float:
    """Sum of squared errors of a fit on the rows behind `moments`, without looking at them again."""
    at = [*(i - 1 for i in used), len(moments.mean) - 1]
    weights = np.append(-beta[1:], 1.0)
    bias = moments.mean[at] @ weights - beta[0]
    spread = float(weights @ moments.comoment[np.ix_(at, at)] @ weights)
    return max(0.0, spread) + moments.n * float(bias) ** 2  # a perfect fit may miss 0 by a rounding


def unpack_many(flat: Iterable[Sequence[float]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, means and co-moments of many groups at once, stacked; a missing group has no rows."""
    length = 1 + size + size * (size + 1) // 2
    stacked = np.array([np.zeros(length) if g is None else np.asarray(g, dtype=float) for g in flat]).reshape(-1, length)
    upper = np.zeros((len(stacked), size, size))
    i, j = np.triu_indices(size)
    upper[:, i, j] = upper[:, j, i] = stacked[:, 1 + size :]
    return stacked[:, 0], stacked[:, 1 : 1 + size], upper


def solve_many(n: np.ndarray, mean: np.ndarray, comoment: np.ndarray, used: Sequence[int]) -> np.ndarray:
    """`solve` without penalty for many groups at once: a row of coefficients per group, intercept first."""
    at = np.asarray(used, dtype=int) - 1
    if not len(at):
        return mean[:, -1:].copy()
    a = comoment[:, at[:, None], at]
    spread = np.sqrt(np.diagonal(a, axis1=1, axis2=2))
    spread = np.where(spread > 1e-13 * np.sqrt(n)[:, None] * np.abs(mean[:, at]), spread, 0.0)
    spread = np.where(spread > 0, spread, 1.0)
    a = a / (spread[:, :, None] * spread[:, None, :])
    b = comoment[:, at, -1] / spread
    coefs = np.einsum("gij,gj->gi", np.linalg.pinv(a, rcond=DEPENDENT, hermitian=True), b) / spread
    return np.concatenate([(mean[:, -1] - np.einsum("gi,gi->g", mean[:, at], coefs))[:, None], coefs], axis=1)


def squared_errors(n: np.ndarray, mean: np.ndarray, comoment: np.ndarray, used: Sequence[int], beta: np.ndarray) -> np.ndarray:
    """`squared_error` for many groups at once."""
    at = np.array([*(i - 1 for i in used), mean.shape[1] - 1])
    weights = np.concatenate([-beta[:, 1:], np.ones((len(n), 1))], axis=1)
    bias = np.einsum("gi,gi->g", mean[:, at], weights) - beta[:, 0]
    spread = np.einsum("gi,gij,gj->g", weights, comoment[:, at[:, None], at], weights)
    return np.maximum(0.0, spread) + n * bias**2


def fit_groups(df: DataFrame, x: Sequence[str], y: str, by: Iterable[str]) -> DataFrame:
    """(by…, n, intercept, coefs, mse) of a least-squares fit per group, for any number of groups.

    The moments of a group are one row, and rows are solved together where they lie; a group without
    a complete row has no fit and is left out.
    """
    by, used = names(by), list(range(1, len(x) + 1))

    def fit(flat: pd.Series) -> pd.DataFrame:
        n, mean, comoment = unpack_many(flat, len(x) + 1)
        beta = solve_many(n, mean, comoment, used)
        error = squared_errors(n, mean, comoment, used, beta) / np.maximum(n, 1)
        return pd.DataFrame({"n": n.astype("int64"), "intercept": beta[:, 0], "coefs": beta[:, 1:].tolist(), "mse": error})

    solved = F.pandas_udf(fit, "struct<n bigint, intercept double, coefs array<double>, mse double>").asNondeterministic()
    return gram(df, x, y, by, "__g").select(*by, solved("__g").alias("__fit")).select(*by, "__fit.*")


@dataclass(frozen=True)
class LinearModel:
    features: tuple[str, ...]
    intercept: float
    coefs: tuple[float, ...]

    def expr(self) -> Column:
        result = F.lit(self.intercept)
        for name, coef in zip(self.features, self.coefs):
            result = result + F.col(name) * F.lit(coef)
        return result


def fit_matrix(matrix: Moments, x: Sequence[str], used: Sequence[int] | None = None, lam: float = 0.0) -> LinearModel:
    used = list(range(1, len(x) + 1)) if used is None else list(used)
    beta = solve(matrix, used, lam)
    return LinearModel(tuple(x[i - 1] for i in used), float(beta[0]), tuple(float(b) for b in beta[1:]))


def fit_ols(df: DataFrame, x: Sequence[str], y: str) -> LinearModel:
    return fit_ridge(df, x, y, 0.0)


def fit_ridge(df: DataFrame, x: Sequence[str], y: str, lam: float) -> LinearModel:
    """Least squares with `lam` times the squared coefficients added; scale the features first."""
    matrices = collect_grams(gram(df, x, y), len(x) + 1)
    if not matrices:
        raise ValueError("no row has all values")
    return fit_matrix(matrices[()], x, lam=lam)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c = 1e-300, 1.0
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return h


def t_test_p(t: float, freedom: float) -> float:
    """Two-sided p-value of a t statistic."""
    if not math.isfinite(t):
        return 0.0
    a, b, x = freedom / 2.0, 0.5, freedom / (freedom + t * t)
    if x >= 1.0:
        return 1.0
    if x <= 0.0:
        return 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def p_values(moments: Moments, used: Sequence[int]) -> np.ndarray:
    """p-value of each used feature in their joint fit."""
    freedom = moments.n - len(used) - 1
    if freedom <= 0:
        return np.ones(len(used))
    beta = solve(moments, used)
    variance = squared_error(moments, used, beta) / freedom
    spread, a = _scaled(moments, used)
    error = np.sqrt(np.maximum(variance * np.diag(np.linalg.pinv(a, rcond=DEPENDENT)), 0.0)) / spread
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(error > 0, beta[1:] / error, np.inf)
    return np.array([t_test_p(v, freedom) for v in t])


@dataclass(frozen=True)
class Stepwise:
    """Add the most significant feature below `enter`, then drop those that rose above `remove`."""

    enter: float = 0.1
    remove: float = 0.3


class Tableau:
    """Correlations of features and target, swept on the features of a fit (Goodnight's sweep operator).

    A sweep enters a feature or takes it out again. At any time the tableau holds the fit of the entered features: coefficients
    in the target's column, the residual sum of squares in its corner, and for the others what they could add.
    """

    def __init__(self, moments: Moments):
        size = len(moments.mean)
        spread, corr = _scaled(moments, range(1, size + 1))
        self.n, self.table = moments.n, corr
        self.entered: list[int] = []

    def sweep(self, i: int) -> None:
        """Enter feature `i` (from 1), or take it out if it is in."""
        k, back = i - 1, i in self.entered
        t, pivot = self.table, self.table[i - 1, i - 1]
        new = t - np.outer(t[:, k], t[k]) / pivot
        sign = -1.0 if back else 1.0
        new[k], new[:, k], new[k, k] = sign * t[k] / pivot, sign * t[:, k] / pivot, -1.0 / pivot
        self.table = new
        self.entered = [j for j in self.entered if j != i] if back else [*self.entered, i]

    def to_enter(self) -> dict[int, float]:
        """Squared t statistic that each feature outside would have if it entered alone; dependent ones can't."""
        t, freedom, out = self.table, self.n - len(self.entered) - 2, {}
        for k in range(len(t) - 1):
            if k + 1 not in self.entered and t[k, k] > DEPENDENT and freedom > 0:
                gain = t[k, -1] ** 2 / t[k, k]
                rest = max(t[-1, -1] - gain, 0.0)
                out[k + 1] = gain * freedom / rest if rest > 0 else math.inf
        return out

    def to_leave(self) -> dict[int, float]:
        """Squared t statistic of each entered feature."""
        t, freedom = self.table, self.n - len(self.entered) - 1
        rest = max(t[-1, -1], 0.0)
        return {i: t[i - 1, -1] ** 2 * freedom / (-t[i - 1, i - 1] * rest) if rest > 0 else math.inf for i in self.entered}

    def p(self, squared_t: float, more: int = 0) -> float:
        freedom = self.n - len(self.entered) - more - 1
        return t_test_p(math.sqrt(squared_t), freedom) if freedom > 0 else 1.0


def stepwise(matrix: Moments, rule: Stepwise = Stepwise()) -> list[int]:
    """Positions (from 1) of the features selected in both directions by p-value, one sweep per feature that enters or leaves."""
    tableau, seen = Tableau(matrix), set()
    while tuple(tableau.entered) not in seen:
        seen.add(tuple(tableau.entered))
        found = tableau.to_enter()
        best = max(found, key=found.get, default=None)
        if best is not None and tableau.p(found[best], 1) < rule.enter:
            tableau.sweep(best)
        while tableau.entered:
            held = tableau.to_leave()
            worst = min(held, key=held.get)
            if tableau.p(held[worst]) <= rule.remove:
                break
            tableau.sweep(worst)
    return tableau.entered


def assign_folds(
    df: DataFrame,
    key: str,
    k: int,
    seed: int = 42,
    stratify: str | None = None,
    method: str = "balanced",
    out: str = "fold",
    **limits,
) -> DataFrame:
    """Fold number 0..k-1 from a seeded hash of the key, the same in every run and partitioning.

    `balanced` deals the rows out in hash order (after ordering by `stratify` if given), so fold sizes
    differ by one at most. `hash` takes the hash itself, which needs no ordering and no shuffle and is
    even to within chance.
    """
    shuffled = df.withColumn("__shuffled", F.xxhash64(F.lit(seed), F.col(key)))
    if method == "hash":
        return shuffled.withColumn(out, F.pmod(F.col("__shuffled"), F.lit(k)).cast("int")).drop("__shuffled")
    order = [stratify, "__shuffled", key] if stratify else ["__shuffled", key]
    dealt = with_ordered(shuffled, order[0], {"__pos": Position(offset=-1)}, tiebreak=order[1:], **limits)
    return dealt.withColumn(out, F.pmod(F.col("__pos"), F.lit(k)).cast("int")).drop("__pos", "__shuffled")


@dataclass(frozen=True)
class CrossValidation:
    models: list[LinearModel]
    fold_mse: list[float]
    mse: float = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "mse", float(np.mean(self.fold_mse)) if self.fold_mse else math.nan)

    def table(self, spark) -> DataFrame:
        """One row per fold: its error and its coefficients by name."""
        rows = [
            (i, m, model.intercept, dict(zip(model.features, model.coefs)))
            for i, (m, model) in enumerate(zip(self.fold_mse, self.models))
        ]
        return spark.createDataFrame(rows, "fold int, mse double, intercept double, coefs map<string,double>")


def cross_validate_grams(
    folds: dict[int, Moments], x: Sequence[str], used: Sequence[int] | None = None, lam: float = 0.0, rule: Stepwise | None = None
) -> CrossValidation:
    """Fit on all folds but one and score on that one, for each fold, from their moments alone. `lam` is per row, see `solve`."""
    models, errors = [], []
    for fold in sorted(folds):
        train = merged([Moments(0.0, folds[fold].mean, folds[fold].comoment), *(m for f, m in sorted(folds.items()) if f != fold)])
        chosen = list(used) if used is not None else list(range(1, len(x) + 1))
        if rule is not None:
            chosen = stepwise(train, rule)
        beta = solve(train, chosen, lam, per_row=True)
        models.append(LinearModel(tuple(x[i - 1] for i in chosen), float(beta[0]), tuple(map(float, beta[1:]))))
        errors.append(squared_error(folds[fold], chosen, beta) / folds[fold].n)
    return CrossValidation(models, errors)


def cross_validate(
    df: DataFrame,
    x: Sequence[str],
    y: str,
    key: str,
    k: int = 5,
    seed: int = 42,
    lam: float = 0.0,
    rule: Stepwise | None = None,
    stratify: str | None = None,
    method: str = "balanced",
    **limits,
) -> CrossValidation:
    """k-fold fit and score with one aggregate over the data, grouped by fold."""
    complete = df.select(key, *x, y).na.drop(subset=[*x, y])
    folded = assign_folds(complete, key, k, seed, stratify, method, **limits)
    grams = collect_grams(gram(folded, x, y, ["fold"]), len(x) + 1)
    return cross_validate_grams({fold: m for (fold,), m in grams.items()}, x, lam=lam, rule=rule)


def predict(df: DataFrame, model: LinearModel, out: str = "pred") -> DataFrame:
    return df.withColumn(out, model.expr())


def predict_ensemble(df: DataFrame, models: Sequence[LinearModel], out: str = "pred") -> DataFrame:
    """Mean of the models' predictions, as one expression."""
    total = models[0].expr()
    for model in models[1:]:
        total = total + model.expr()
    return df.withColumn(out, total / F.lit(float(len(models))))
