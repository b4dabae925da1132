"""Operators on ordered series: lags, differences, smoothing, gap filling, ids, splits."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochline.functions.columns import missing_to_null, names, null_after, numeric_columns
from epochline.operators.ordered import Delta, Fill, Interpolate, Lag, Position, Rolling, Size, with_ordered
from epochline.session import settle, sized

#: Keys that one row of a spine's making stands for.
SPINE_RUN = 65_536


def add_lags(
    df: DataFrame,
    key: str,
    cols: Iterable[str],
    lags: Iterable[int],
    series: Iterable[str] | None = None,
    pad: str = "null",
    **limits,
) -> DataFrame:
    """`{col}_lagged_{k}` columns. `pad="first"` acts as if copies of the first row preceded it."""
    exprs = {f"{c}_lagged_{k}": Lag(c, k=k, pad=pad) for c in names(cols) for k in lags}
    return with_ordered(df, key, exprs, series, **limits)


def add_deltas(
    df: DataFrame, key: str, cols: Iterable[str], series: Iterable[str] | None = None, pad: str = "null", **limits
) -> DataFrame:
    """`delta_{col}` columns: difference to the row before."""
    return with_ordered(df, key, {f"delta_{c}": Delta(c, k=1, pad=pad) for c in names(cols)}, series, **limits)


def rolling_mean(
    df: DataFrame,
    key: str,
    cols: Iterable[str],
    before: int = 1,
    after: int = 1,
    min_count: int | None = None,
    series: Iterable[str] | None = None,
    **limits,
) -> DataFrame:
    """Replace each column by its mean over neighbouring rows; by default all of them must be known."""
    exprs = {c: Rolling(c, before=before, after=after, min_count=min_count) for c in names(cols)}
    return with_ordered(df, key, exprs, series, **limits)


def interpolate(
    df: DataFrame,
    key: str,
    cols: Iterable[str],
    series: Iterable[str] | None = None,
    axis: str = "row",
    edges: str = "null",
    **limits,
) -> DataFrame:
    exprs = {c: Interpolate(c, axis=axis, edges=edges) for c in names(cols)}
    return with_ordered(df, key, exprs, series, **limits)


def interpolate_where(
    df: DataFrame, key: str, cols: Iterable[str], cond: Column, series: Iterable[str] | None = None, **limits
) -> DataFrame:
    """Interpolate among the rows that meet `cond`; the others keep their values."""
    cols = names(cols)
    flagged = df.withColumn("__chosen", F.coalesce(cond, F.lit(False)))
    exprs = {f"__new_{c}": Interpolate(c) for c in cols}
    filled = with_ordered(flagged, key, exprs, [*names(series), "__chosen"], **limits)
    chosen = {c: F.when(F.col("__chosen"), F.col(f"__new_{c}")).otherwise(F.col(c)) for c in cols}
    return filled.withColumns(chosen).select(*df.columns)


def fill_both(df: DataFrame, key: str, cols: Iterable[str], series: Iterable[str] | None = None, **limits) -> DataFrame:
    """Take the next known value, or the previous one at the end of the series."""
    return with_ordered(df, key, {c: Fill(c) for c in names(cols)}, series, **limits)


def stride_fill(
    df: DataFrame, key: str, col: str, stride: int, series: Iterable[str] | None = None, **limits
) -> DataFrame:
    """Fill a gap from the row `stride` keys later, or 2, 3, … strides if that is missing too."""
    lane = df.withColumn("__lane", F.pmod(F.col(key), F.lit(stride)))
    filled = with_ordered(lane, key, {col: Fill(col, direction="backward")}, [*names(series), "__lane"], **limits)
    return filled.select(*df.columns)


def dense_id(df: DataFrame, order_by: Sequence[str], name: str, offset: int = 0, **limits) -> DataFrame:
    """Consecutive ids in a given order; rows that tie in all order columns may swap ids."""
    first, *rest = names(order_by)
    return with_ordered(df, first, {name: Position(offset=offset)}, tiebreak=rest, **limits)


def number_rows(df: DataFrame, name: str, offset: int = 0, consecutive: bool = True) -> DataFrame:
    """Ids for all rows, equal ones too, without an order and without moving a row.

    The rows are written once with their place in their task, so an id never changes afterwards. Ids that aren't
    consecutive are that place; consecutive ones, from `offset + 1` on, add the rows of the tasks before.
    """
    laid = settle(df.withColumn("__place", F.monotonically_increasing_id()), "numbered")
    if not consecutive:
        return laid.select(*[c for c in df.columns if c != name], (F.col("__place") + offset + 1).alias(name))
    part, nth = F.shiftright("__place", 33), F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = laid.groupBy(part.alias("__part")).agg((F.max(nth) + 1).alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task that wrote
    bases = sized(counts.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base")))
    joined = laid.withColumn("__part", part).join(bases, "__part")
    return joined.select(*[c for c in df.columns if c != name], (F.col("__base") + nth + offset + 1).alias(name))


def chunk_mean(
    df: DataFrame, key: str, n: int, cols: Iterable[str] | None = None, series: Iterable[str] | None = None, **limits
) -> DataFrame:
    """Mean of every `n` rows; rows are numbered from 1, so the first chunk has `n - 1` of them."""
    series = names(series)
    cols = names(cols) if cols is not None else numeric_columns(df, series)
    numbered = with_ordered(df, key, {"__pos": Position()}, series, **limits)
    chunked = numbered.withColumn("group_number", F.floor(F.col("__pos") / F.lit(n)).cast("bigint"))
    return chunked.groupBy(*series, "group_number").agg(*[F.avg(c).alias(c) for c in cols])


def chrono_split(
    df: DataFrame, key: str, frac: float = 0.9, series: Iterable[str] | None = None, tiebreak: Iterable[str] = (), **limits
) -> DataFrame:
    """Label the first `frac` of the rows `train` and the rest `test`."""
    exprs = {"__pos": Position(), "__rows": Size()}
    numbered = with_ordered(df, key, exprs, series, tiebreak, **limits)
    in_train = F.col("__pos") <= F.floor(F.col("__rows") * F.lit(frac))
    return numbered.withColumn("split", F.when(in_train, "train").otherwise("test")).drop("__pos", "__rows")


def latest_value(
    df: DataFrame, key: str, cols: Iterable[str], series: Iterable[str] | None = None, first: bool = False
) -> DataFrame:
    """Values of the row with the greatest (or least) key per series.

    One aggregate per column, all led by the same key: unlike a struct of the whole row, numbers can be
    aggregated in place by hash.
    """
    pick = F.min_by if first else F.max_by
    return df.groupBy(*names(series)).agg(*[pick(c, key).alias(c) for c in names(cols)])


def make_spine(*dfs: DataFrame, key: str) -> DataFrame:
    """The distinct keys of several frames."""
    keys = [df.select(F.col(key).cast("bigint").alias(key)) for df in dfs]
    spine = keys[0]
    for other in keys[1:]:
        spine = spine.union(other)
    return spine.where(F.col(key).isNotNull()).distinct()


def regular_spine(df: DataFrame, key: str, step: int, series: Iterable[str] | None = None) -> DataFrame:
    """All keys from the first to the last of each series, `step` apart.

    A long axis is dealt out in two rounds of runs before its keys are made, so no row or task holds more than
    SPINE_RUN of them at a time.
    """
    series = names(series)
    spark = df.sparkSession
    ends = df.groupBy(*series).agg(F.min(key).cast("bigint").alias("__lo"), F.max(key).cast("bigint").alias("__hi")).where(F.col("__lo").isNotNull())
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = ends
    for length in (SPINE_RUN**2, SPINE_RUN):
        first = F.col("__lo") + F.col("__run") * (length * step)
        last = F.least(F.col("__hi"), first + (length - 1) * step)
        count = F.floor((F.col("__hi") - F.col("__lo")) / (length * step))
        runs = runs.withColumn("__run", F.explode(F.sequence(F.lit(0).cast("bigint"), count)))
        runs = runs.select(*series, first.alias("__lo"), last.alias("__hi")).repartition(wide, *series, "__lo")
    keys = F.explode(F.sequence(F.col("__lo"), F.col("__hi"), F.lit(step).cast("bigint")))
    return runs.select(*series, keys.alias(key))


def bin_and_fill(
    df: DataFrame,
    key: str,
    bin_expr: Column,
    spine: DataFrame | None,
    cols: Iterable[str],
    series: Iterable[str] | None = None,
    horizon: float | None = None,
    horizon_cols: Iterable[str] = (),
    axis: str = "row",
    out: str = "year_bin",
    **limits,
) -> DataFrame:
    """Mean per bin, every spine bin present, gaps interpolated, edges filled, nothing past the horizon.

    Spine rows join the raw rows before the aggregation as rows without values, which averages ignore;
    one shuffle does both the mean and the outer join, and the spine may repeat its bins. The bins are
    written out before the ordered step, so that the raw rows are read once.
    """
    series, cols = names(series), names(cols)
    clean = missing_to_null(df, cols)
    rows = clean.select(*series, bin_expr.alias(out), *[F.col(c).cast("double").alias(c) for c in cols])
    if spine is not None:
        empty = [F.lit(None).cast("double").alias(c) for c in cols]
        rows = rows.unionByName(spine.select(*series, F.col(out).cast("bigint").alias(out), *empty))
    binned = rows.groupBy(*series, out).agg(*[F.avg(c).alias(c) for c in cols])
    if "max_rows" not in limits:
        binned = settle(binned, "bins")
    filled = interpolate(binned, out, cols, series, axis=axis, edges="fill", **limits)
    return filled if horizon is None else null_after(filled, out, horizon, horizon_cols)
