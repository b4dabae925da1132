"""Aggregates, scaling and error measures. All are map-side combinable, so a hot key costs no more."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochline.functions.columns import names, numeric_columns
from epochline.session import sized


def mean_all(df: DataFrame, by: Iterable[str], exclude: Iterable[str] = ()) -> DataFrame:
    """Mean of every numeric column per group."""
    by = names(by)
    cols = numeric_columns(df, [*by, *names(exclude)])
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in cols])


def latest_by_priority(df: DataFrame, key: Iterable[str], priority: str, values: Iterable[str]) -> DataFrame:
    """Per key the values of the row with the highest priority."""
    keys, values = names(key), names(values)
    best = F.max(F.struct(F.col(priority), *values)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("__best")[v].alias(v) for v in values])


def weighted_mean(df: DataFrame, value: str, weight: Column, by: Iterable[str] = (), out: str = "weighted_mean"):
    """Mean with weights; rows without a value do not count."""
    known = F.col(value).isNotNull()
    total = F.sum(F.when(known, F.col(value) * weight))
    return df.groupBy(*names(by)).agg((total / F.sum(F.when(known, weight))).alias(out))


def latitude_weight(lat: Column) -> Column:
    """Share of the sphere's surface that a grid cell at this latitude stands for."""
    return F.cos(F.radians(lat))


def trend(df: DataFrame, x: str | Column, y: str | Column, by: Iterable[str] = ()) -> DataFrame:
    """Least-squares line per group: slope, intercept, r2 and the number of complete rows."""
    x, y = (F.col(v) if isinstance(v, str) else v for v in (x, y))
    complete = x.isNotNull() & y.isNotNull()
    return df.groupBy(*names(by)).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.sum(complete.cast("bigint")).alias("n"),
    )


def mse(df: DataFrame, y: str, pred: str, by: Iterable[str] = (), out: str = "mse") -> DataFrame:
    """Mean squared error over the rows that have both values."""
    return df.groupBy(*names(by)).agg(F.avg(F.pow(F.col(y) - F.col(pred), 2)).alias(out))


def extent(df: DataFrame, col: str, by: Iterable[str] = ()) -> DataFrame:
    return df.groupBy(*names(by)).agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.count(col).alias("n"))


def standard_scale(
    df: DataFrame, cols: Iterable[str] | None = None, exclude: Iterable[str] = (), fit: DataFrame | None = None
) -> DataFrame:
    """Mean 0 and population standard deviation 1; a constant column becomes 0.

    The statistics come from `fit` (by default `df` itself): one aggregate, one row, and then constants
    in the projection, so the scaled frame needs no join.
    """
    cols = names(cols) if cols is not None else numeric_columns(df, exclude)
    if not cols:
        return df
    stats = (fit if fit is not None else df).agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)],
    ).first()
    scaled = {}
    for i, c in enumerate(cols):
        mean, spread = stats[f"m{i}"], stats[f"s{i}"]
        scaled[c] = F.lit(None).cast("double") if mean is None else (F.col(c) - F.lit(mean)) / F.lit(spread or 1.0)
    return df.withColumns(scaled)


def minmax_scale(df: DataFrame, cols: Iterable[str], by: Iterable[str] = ()) -> DataFrame:
    """Rescale to 0..1, over the whole frame or per group; a constant column becomes 0.5."""
    cols, by = names(cols), names(by)
    ends = [f(c).cast("double").alias(f"__{n}{i}") for i, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max))]

    def rescaled(value, lo, hi):
        return F.when(value.isNotNull(), F.coalesce((value - lo) / F.nullif(hi - lo, F.lit(0.0)), F.lit(0.5)))

    if not by:
        row = df.agg(*ends).first()
        bounds = {c: tuple(F.lit(row[f"__{n}{i}"]).cast("double") for n in ("lo", "hi")) for i, c in enumerate(cols)}
        return df.withColumns({c: rescaled(F.col(c), *bounds[c]) for c in cols})
    stats = sized(df.groupBy(*by).agg(*ends)).withColumnsRenamed({c: f"__by_{c}" for c in by})
    on = [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by]
    joined = df.join(stats, on, "left")
    scaled = {c: rescaled(F.col(c), F.col(f"__lo{i}"), F.col(f"__hi{i}")) for i, c in enumerate(cols)}
    return joined.withColumns(scaled).select(*df.columns)


def to_long(df: DataFrame, ids: Iterable[str], values: Iterable[str], variable: str = "variable", value: str = "value"):
    """One row per id and value column."""
    return df.unpivot(names(ids), names(values), variable, value)
