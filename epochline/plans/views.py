"""The three analytical views over the star schema."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochline.functions.bins import floor_bin
from epochline.functions.columns import add_squares, drop_matching, matching, numeric_columns, round_all
from epochline.operators.series import add_deltas, add_lags, interpolate_where, rolling_mean
from epochline.operators.star import star_join
from epochline.operators.stats import mean_all, standard_scale
from epochline.plans.config import FlowConfig
from epochline.session import settle

KEY, TARGET = "year_bin", "anomaly"


def joined_base(fact: DataFrame, dims: Mapping[str, DataFrame], config: FlowConfig = FlowConfig()) -> DataFrame:
    """Mean anomaly per time, every time of the time dimension, and all measures of the other dimensions.

    The facts are aggregated before any join, so only this step works at fact size. The result is as small
    as the bins and feeds every view, so it is written out once.
    """
    rounded = {name: round_all(df, config.places, exclude=[KEY]) for name, df in dims.items()}
    by_time = fact.groupBy("time_id").agg(F.avg(TARGET).alias(TARGET))
    timed = by_time.join(rounded.pop("dim_time"), "time_id", "right")
    return settle(star_join(timed, rounded, "time_id", drop_key=True), "base")


def raw_view(base: DataFrame, config: FlowConfig = FlowConfig()) -> DataFrame:
    """All measures at the resolution of the bins, scaled except for the configured columns."""
    return round_all(standard_scale(base, exclude=config.unscaled), config.places, exclude=[KEY])


def resampled_view(base: DataFrame, config: FlowConfig = FlowConfig()) -> DataFrame:
    """Fixed-width bins with smoothed, differenced, scaled, lagged and squared columns."""
    binned = mean_all(base.withColumn(KEY, floor_bin(F.col(KEY), config.width)), [KEY])
    binned = settle(binned, "resampled")
    ends = binned.agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(F.pmod(KEY, F.lit(config.coarse)) != 0, F.col(KEY))).alias("fine")
    ).first()
    bound = {"max_rows": ends["n"]}

    smoothed = [c for c in config.smoothed if c in binned.columns]
    rows = rolling_mean(binned, KEY, smoothed, **bound) if smoothed else binned
    if ends["fine"] is not None:
        rows = rows.where(F.col(KEY) >= ends["fine"] - config.width)
    measures = [c for c in rows.columns if c != KEY]
    rows = settle(add_deltas(rows, KEY, measures, pad="first", **bound), "differenced")

    scaled = standard_scale(rows, exclude=[KEY, TARGET], fit=_padded(rows, measures, config.pad_copies))
    lagged = add_lags(scaled, KEY, [c for c in config.lagged if c in measures], config.lags, pad="first", **bound)
    squares = [c for c in lagged.columns if c not in (KEY, TARGET) and "lagged" not in c]
    wide = add_squares(lagged, squares)
    gappy = _with_gaps(rows, config)
    incomplete = [c for c in wide.columns if c.removesuffix("_squared").split("_lagged_")[0] in gappy]
    filled = interpolate_where(wide, KEY, incomplete, F.col(KEY) < config.present, **bound) if incomplete else wide
    return settle(round_all(filled, config.places, exclude=[KEY]), "view")


def _with_gaps(rows: DataFrame, config: FlowConfig) -> set[str]:
    """The columns with a missing value before the present; a column made from any other has none either."""
    cols = [c for c in rows.columns if c != KEY]
    past = rows.where(F.col(KEY) < config.present)
    missing = past.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols]).first()
    return {c for c in cols if missing[c]}


def _padded(rows: DataFrame, measures: list[str], copies: int) -> DataFrame:
    """The rows plus copies of the first one, which is what the scaler has to see for equal results.

    The very first copy has no row before it and therefore no differences.
    """
    if copies <= 0:
        return rows
    first = rows.orderBy(KEY).limit(1).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    blanked = first.withColumns({f"delta_{c}": F.when(F.col("__copy") > 1, F.col(f"delta_{c}")) for c in measures})
    return rows.unionByName(blanked.drop("__copy"))


def training_view(resampled: DataFrame, config: FlowConfig = FlowConfig(), fill: float | None = None) -> DataFrame:
    """The columns and years that models are trained on. `fill` replaces a missing target if given."""
    view = drop_matching(resampled, contains=config.dropped).where(F.col(KEY) >= config.train_from)
    return view if fill is None else view.withColumn(TARGET, F.coalesce(TARGET, F.lit(fill)))


def long_term_view(resampled: DataFrame) -> DataFrame:
    """The resampled view without derived columns."""
    derived = matching(resampled.columns, contains=["lagged"], prefixes=["delta_"], suffixes=["_squared"])
    return resampled.drop(*derived)


def feature_columns(training: DataFrame) -> list[str]:
    return numeric_columns(training, [KEY, TARGET])
