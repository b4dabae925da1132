"""Plot-ready tables. Each is a frame that a chart can be drawn from without further work."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochline.functions.columns import null_after, title_label
from epochline.operators.lookup import label_bands, label_intervals
from epochline.operators.series import chunk_mean, latest_value
from epochline.operators.stats import minmax_scale, to_long, trend
from epochline.plans.config import FlowConfig
from epochline.plans.views import KEY, TARGET
from epochline.session import sized

# The year ranges that the series charts show.
WINDOWS = {
    "long_term": (-800_000, None),
    "eruption": (-700_000, -600_000),
    "since_ice_age": (-12_000, None),
    "modern": (1_850, 2_025),
}

# The glaciations that are marked in the charts.
GLACIATIONS = (
    (-75_000, -11_000, "Wisconsin"),
    (-191_000, -130_000, "Illinoian"),
    (-300_000, -250_000, "Pre-Illinoian"),
    (-385_000, -345_000, "Pre-Illinoian"),
    (-475_000, -430_000, "Pre-Illinoian"),
    (-560_000, -530_000, "Pre-Illinoian"),
    (-650_000, -620_000, "Pre-Illinoian"),
)

# The events that are marked in the charts.
EVENTS = (
    (-700_000, "Quaternary Glaciation Intensifies"),
    (-629_000, "Most Recent Yellowstone Eruption"),
    (-110_000, "Last Ice Age Starts"),
    (-10_000, "Agricultural Revolution"),
    (-8_000, "Ice Age Ends"),
    (1_760, "Industrial Revolution"),
)

# The range of the raw view that all its reports are drawn from, and the windows that show the long-term view.
RAW_RANGE = (-700_000, 2_025)
LONG_TERM_WINDOWS = ("long_term", "eruption")

SEGMENT_YEAR = 1_750
INDUSTRIAL_YEAR = 1_850
ICE_AGE_END = -12_000


def glaciation_spans(spark) -> DataFrame:
    return spark.createDataFrame(list(GLACIATIONS), "lo bigint, hi bigint, label string")


def event_markers(spark) -> DataFrame:
    return spark.createDataFrame(list(EVENTS), "year bigint, label string")


def report_base(raw: DataFrame, between: tuple[float, float] = RAW_RANGE, key: str = KEY) -> DataFrame:
    """The rows of the raw view that reports show. Scales and trends are of these rows alone."""
    return raw.where(F.col(key).between(*between))


def series_window(view: DataFrame, window: str | tuple, cols: Iterable[str] = (TARGET, "co2_ppm"), key: str = KEY):
    """R1: a series within a named or given year range."""
    low, high = WINDOWS[window] if isinstance(window, str) else window
    rows = view
    if low is not None:
        rows = rows.where(F.col(key) >= low)
    if high is not None:
        rows = rows.where(F.col(key) <= high)
    return rows.select(key, *[c for c in cols if c in view.columns])


def anomaly_by_co2(raw: DataFrame, x: str = "co2_ppm", y: str = TARGET, key: str = KEY, split_year: float = SEGMENT_YEAR):
    """R2: points with their period, and one trend line per period."""
    period = F.when(F.col(key) < split_year, F.lit(f"Before {split_year}")).otherwise(F.lit(f"{split_year}-Present"))
    points = raw.select(key, x, y, period.alias("period"))
    return points, trend(points, x, y, ["period"])


def glacial_cycles(
    raw: DataFrame,
    cols: Iterable[str] = (TARGET, "co2_ppm", "eccentricity", "global_insolation"),
    until: float = INDUSTRIAL_YEAR,
    since: float | None = -650_000,
    chunk: int = 1,
    spans: DataFrame | None = None,
    key: str = KEY,
    **limits,
) -> DataFrame:
    """R3: pre-industrial series scaled to 0..1, one row per year and variable, with the glaciation it falls in."""
    long = to_long(_scaled_history(raw, cols, until, chunk, key, **limits), [key], cols)
    if since is not None:
        long = long.where(F.col(key) >= since)
    return label_intervals(long, spans if spans is not None else glaciation_spans(raw.sparkSession), key, label="label")


def _scaled_history(raw, cols, until, chunk, key, **limits) -> DataFrame:
    past = raw.where(F.col(key) <= until).select(key, *cols)
    return chunk_mean(minmax_scale(past, cols), key, chunk, [key, *cols], **limits).drop("group_number")


def scatter_pairs(
    raw: DataFrame,
    predictors: Iterable[str] = ("eccentricity", "global_insolation"),
    y: str = TARGET,
    until: float = INDUSTRIAL_YEAR,
    since: float = ICE_AGE_END,
    key: str = KEY,
) -> DataFrame:
    """R4: scaled predictor against scaled target, flagged when after the last ice age."""
    predictors = list(predictors)
    past = raw.where(F.col(key) <= until).select(key, y, *predictors)
    long = to_long(minmax_scale(past, [y, *predictors]), [key, y], predictors, "predictor", "x")
    return long.select(key, "predictor", "x", F.col(y).alias("y"), (F.col(key) >= since).alias("post_ice_age"))


def modulation_overlay(view: DataFrame, cols: Iterable[str] = ("solar_modulation", TARGET), spans: DataFrame | None = None, key: str = KEY):
    """R5: solar modulation and anomaly on one scale, with the glaciation they fall in."""
    scaled = minmax_scale(view.select(key, *cols), cols)
    return label_intervals(scaled, spans if spans is not None else glaciation_spans(view.sparkSession), key, label="label")


def prediction_bands(key: Column, config: FlowConfig, pure_forecast: bool = False) -> Column:
    """Train, test or forecast; pure forecasters have no test window."""
    if pure_forecast:
        return F.when(key > config.present, "Forecast").otherwise("Train")
    return label_bands(
        key, [(config.test_start, config.test_end, "Test"), (None, config.present, "Train")], default="Forecast"
    )


def prediction_report(
    predictions: Mapping[str, DataFrame],
    config: FlowConfig = FlowConfig(),
    key: str = KEY,
    y: str = TARGET,
    pred: str = "pred_anomaly",
    actual: DataFrame | None = None,
    scores: DataFrame | None = None,
) -> DataFrame:
    """R6: actual and predicted values of all models in one frame with their bands.

    Actual values are blank in the future; predictions of pure forecasters are blank in the past, where
    they only repeat the actual value. `actual` adds a panel, "Default", of a view without predictions. `scores` (model, mse) adds the
    validation error of each model as a column; panels that have none, as pure forecasters, keep it blank.
    """
    report = None
    panels = dict(predictions)
    if actual is not None:
        panels["default"] = actual.select(key, y, F.lit(None).cast("double").alias(pred))
    for model, df in panels.items():
        pure = "arima" in model or model.startswith("ar")
        shown = F.when(F.col(key) > config.present, F.col(pred)) if pure else F.col(pred)
        rows = null_after(df.where(F.col(key) <= config.forecast_end), key, config.present, [y]).select(
            title_label(F.lit(model)).alias("model"),
            key,
            F.col(y),
            shown.alias(pred),
            prediction_bands(F.col(key), config, pure).alias("band"),
            *([] if scores is None else [F.lit(None if pure else model).cast("string").alias("__scored")]),
        )
        report = rows if report is None else report.unionByName(rows)
    if scores is None:
        return report
    board = sized(scores.select(F.col("model").alias("__scored"), F.col("mse")))
    return report.join(board, "__scored", "left").drop("__scored")


def latest_label(view: DataFrame, y: str = TARGET, key: str = KEY) -> DataFrame:
    """R1: the newest known value and its label on the chart of recent years, one row."""
    newest = latest_value(view.where(F.col(y).isNotNull()).select(F.col(key), F.col(y), F.col(key).alias("__at")), "__at", [key, y])
    text = F.concat(F.col(key).cast("bigint").cast("string"), F.lit(": Anomaly of "), F.when(F.col(y) >= 0, "+").otherwise(""), F.format_string("%.2f°C", F.col(y)))
    return newest.where(F.col(key).isNotNull()).select(key, y, text.alias("label"))


def fitness_by_generation(history: DataFrame) -> DataFrame:
    """R7: best fitness of each generation, without the final re-evaluation."""
    from epochline.models.search import progress

    return progress(history)


# The predictors whose relation to the target is charted.
PREDICTORS = (
    "year_bin",
    "co2_ppm",
    "co2_radiative_forcing",
    "eccentricity",
    "perihelion",
    "obliquity",
    "insolation",
    "global_insolation",
    "be_ppm",
    "VADM",
    "solar_modulation",
)


def predictor_trends(view: DataFrame, predictors: Iterable[str] = PREDICTORS, y: str = TARGET, roots: Iterable[str] = ("global_insolation",)):
    """R8: one least-squares line per predictor. Predictors in `roots` enter by their square root."""
    roots, present = set(roots), [c for c in predictors if c in view.columns]
    values = view.select(
        F.col(y).alias("__y"),
        *[
            (F.when(F.col(c) >= 0, F.sqrt(c)) if c in roots else F.col(c)).cast("double").alias(c)
            for c in present
        ],
    )
    return trend(to_long(values, ["__y"], present, "predictor", "x"), "x", "__y", ["predictor"])
