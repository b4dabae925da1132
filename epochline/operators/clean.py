"""Row filters, outlier bounds, data-quality checks and the repair of shifted rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochline.functions.columns import names
from epochline.session import settle, sized

ACCURACY = 10_000
#: Size of a group's sketch, and how far a rank that it tells may be off before the group is counted whole (three times its error).
SKETCH, SLACK = 2048, 0.0042


def split_valid(df: DataFrame, rule: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the rule, and the rest (an unknown outcome counts as not met)."""
    met = F.coalesce(rule, F.lit(False))
    return df.where(met), df.where(~met)


def sample_rule(columns: Mapping[str, str] | None = None) -> Column:
    """Whether a nested measurement record is usable.

    It must be in degrees Celsius, not be marked as unfit for global analysis, have no "DELETE" note,
    and start with a known age and value.
    """
    name = {
        "units": "paleoData_units",
        "use": "paleoData_useInGlobalTemperatureAnalysis",
        "notes": "paleoData_QCnotes",
        "age": "age",
        "values": "paleoData_values",
        **(columns or {}),
    }

    def known(array):
        head = F.get(F.col(array), F.lit(0)).cast("double")
        return head.isNotNull() & ~F.isnan(head)

    return (
        F.col(name["units"]).eqNullSafe("degC")
        & ~F.col(name["use"]).eqNullSafe("FALSE")
        & ~F.coalesce(F.col(name["notes"]).contains("DELETE"), F.lit(False))
        & known(name["age"])
        & known(name["values"])
    )


def group_quantiles(df: DataFrame, by: Iterable[str], col: str, qs: Sequence[float], method: str = "linear") -> DataFrame:
    """(by…, n, quantiles) with the exact quantiles of a column per group, one value per entry of `qs`, null without values.

    A first scan makes a mergeable sketch per group, which says between which two values each wanted rank lies. A second
    counts the rows below and, value by value, those between; the counts tell whether the rank is there. Equal values are counted
    where they lie, and what lies between is a set share of a group. Groups that the sketch misjudged, which are next to
    none, are counted whole. The result is a table.
    """
    by = names(by)
    values = df.select(*by, F.col(col).cast("double").alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    sketch = F.kll_sketch_agg_double("__v", F.lit(SKETCH))
    sketched = values.groupBy(*by).agg(sketch.alias("__s"), F.count(F.lit(1)).alias("n"), F.min("__v").alias("__least"), F.max("__v").alias("__most"))
    parts = []
    for i, q in enumerate(qs):
        at = (F.col("n") - 1) * F.lit(float(q))
        low = F.floor(at + 0.5 if method == "nearest" else at)
        share = F.lit(0.0) if method == "nearest" else at - low
        lo, hi = (_around(q, sign) for sign in (-1, 1))
        parts.append(F.struct(F.lit(i).alias("i"), low.alias("low"), share.alias("share"), lo.alias("lo"), hi.alias("hi")))
    bounds = settle(sketched.select(*by, "n", "__least", "__most", F.array(*parts).alias("parts")), "bounds")
    found = settle(_ranked(values, bounds, by), "quantiles")
    missed = found.where(~F.col("sure")).select(*by)
    if not missed.isEmpty():
        whole = F.transform("parts", lambda p: F.struct(p.i.alias("i"), p.low.alias("low"), p.share.alias("share"), F.col("__least").alias("lo"), F.col("__most").alias("hi")))
        again = _beside(bounds, missed.distinct(), by, "left_semi").withColumn("parts", whole)
        kept = found.where("sure") if not by else _beside(found, missed.distinct(), by, "left_anti")
        found = kept.unionByName(_ranked(values, again, by)) if by else _ranked(values, again, by)
    ordered = F.sort_array(F.collect_list(F.struct("i", "value")))
    return settle(found.groupBy(*by, "n").agg(ordered.alias("__q")).select(*by, "n", F.col("__q.value").alias("quantiles")), "quantiles")


def _around(q: float, sign: int) -> Column:
    """A value that the wanted ranks are not below (or above), by the sketch: as near as the rows of the group allow."""
    found = F.col("__least" if sign < 0 else "__most")
    for rows in (20, 200, 2000):  # a rank is up to two rows away from its share of them
        rank = min(1.0, max(0.0, q + sign * (SLACK + 2 / rows)))
        found = F.when(F.col("n") > rows, F.kll_sketch_get_quantile_double("__s", F.lit(rank))).otherwise(found)
    return found


def _beside(df: DataFrame, few: DataFrame, by: list[str], how: str) -> DataFrame:
    """Join on the group; without groups, `few` has one row and holds for all."""
    keys = by or ["__all"]
    left, right = (d if by else d.withColumn("__all", F.lit(0)) for d in (df, few))
    other = right.select(*[F.col(c).alias(f"__of_{c}") for c in keys], *[F.col(c) for c in right.columns if c not in keys])
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    out = left.join(other if by else F.broadcast(other), same, how)
    return out.drop(*[f"__of_{c}" for c in keys], *([] if by else ["__all"]))


def _ranked(values: DataFrame, bounds: DataFrame, by: list[str]) -> DataFrame:
    """(by…, n, i, value, sure): the quantiles, and whether the counts show that they are right."""
    own = values.select(*by, "__v")
    rows = _beside(own, bounds.select(*by, "n", "parts"), by, "inner").withColumn("p", F.explode("parts")).where(F.col("__v") <= F.col("p.hi"))
    inside = F.when(F.col("__v") >= F.col("p.lo"), F.col("__v"))  # null stands for all that are below
    counts = rows.groupBy(*by, "n", "p.i", "p.low", "p.share", inside.alias("v")).agg(F.count(F.lit(1)).alias("times"))
    upto = Window.partitionBy(*by, "i").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("upto", F.sum("times").over(upto))
    below = F.coalesce(F.max(F.when(F.col("v").isNull(), F.col("times"))), F.lit(0))
    first, second = (F.min(F.when((F.col("upto") > F.col("low") + k) & F.col("v").isNotNull(), F.col("v"))) for k in (0, 1))
    picked = counts.groupBy(*by, "n", "i", "low", "share").agg(first.alias("x"), second.alias("y"), below.alias("below"))
    value = F.when(F.col("share") > 0, F.col("x") * (1 - F.col("share")) + F.col("y") * F.col("share")).otherwise(F.col("x"))
    sure = (F.col("below") <= F.col("low")) & F.col("x").isNotNull() & ((F.col("share") == 0) | F.col("y").isNotNull())
    return picked.select(*by, "n", "i", value.alias("value"), sure.alias("sure"))


def quantiles(df: DataFrame, col: str, qs: Sequence[float], method: str = "linear") -> list[float | None]:
    """Quantiles of a column, as numbers.

    `linear` and `nearest` are exact at any size; `approx` trades exactness for one single pass.
    """
    if method == "approx":
        values = df.select(F.col(col).cast("double").alias(col)).where(F.col(col).isNotNull() & ~F.isnan(col))
        return list(values.agg(F.percentile_approx(col, list(qs), ACCURACY).alias("q")).first()["q"] or [None] * len(qs))
    row = group_quantiles(df, [], col, qs, method).first()
    return list(row["quantiles"]) if row else [None] * len(qs)


def iqr_bounds(df: DataFrame, col: str, k: float = 1.5, method: str = "linear") -> tuple[float | None, float | None]:
    """Lower and upper outlier bound: the quartiles widened by `k` times their distance."""
    q1, q3 = quantiles(df, col, [0.25, 0.75], method)
    if q1 is None:
        return None, None
    return q1 - k * (q3 - q1), q3 + k * (q3 - q1)


def iqr_filter(df: DataFrame, col: str, k: float = 1.5, method: str = "linear", by: Iterable[str] = ()) -> DataFrame:
    """Rows within the outlier bounds, of all rows or of their group.

    Without groups the bounds are constants, so the filter reaches the file scan.
    """
    by = names(by)
    if by:
        found = group_quantiles(df, by, col, [0.25, 0.75], method)
        q1, q3 = F.col("quantiles")[0], F.col("quantiles")[1]
        bounds = found.select(*by, (q1 - k * (q3 - q1)).alias("__low"), (q3 + k * (q3 - q1)).alias("__high"))
        return _beside(df, bounds, by, "inner").where(F.col(col).between(F.col("__low"), F.col("__high"))).select(*df.columns)
    low, high = iqr_bounds(df, col, k, method)
    if low is None:
        return df.where(F.lit(False))
    return df.where(F.col(col).between(low, high))


def duplicate_keys(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Keys that occur more than once, with their count; empty if the keys are unique."""
    return df.groupBy(*names(keys)).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def repair_shifted(df: DataFrame, cols: Sequence[str], shifted: Column, n_missing: int = 1) -> DataFrame:
    """Move the cells of rows that lost their leading `n_missing` cells back to the right columns.

    `shifted` tells these rows. That the last cells are empty doesn't, as good rows may end in empty cells:
    see `leading_lost`. The columns must share one type.
    """
    cols = names(cols)
    moved = {}
    for i, c in enumerate(cols):
        source = F.lit(None) if i < n_missing else F.col(cols[i - n_missing])
        moved[c] = F.when(shifted, source).otherwise(F.col(c))
    return df.withColumns(moved)


def leading_lost(cols: Sequence[str], known: str, between: tuple[float, float], n_missing: int = 1) -> Column:
    """Whether a row lost its leading cells, by a column whose range is known.

    The last cells are empty, the value in the known column is out of its range or missing, and the value
    that a shift would bring there is within.
    """
    cols = names(cols)
    empty = F.lit(True)
    for c in cols[-n_missing:]:
        empty = empty & F.col(c).isNull()
    here = F.col(known).try_cast("double")
    there = F.col(cols[cols.index(known) - n_missing]).try_cast("double")
    return empty & F.coalesce(there.between(*between), F.lit(False)) & ~F.coalesce(here.between(*between), F.lit(False))


def quarantine_extreme(
    df: DataFrame, series: Iterable[str], order: str, value: str, limit: float = 20
) -> tuple[DataFrame, DataFrame]:
    """All rows, and the rows of the series whose last value is further than `limit` from 0.

    The flagged series are found by an aggregate and matched back by a semi join.
    """
    series = names(series)
    last = df.groupBy(*series).agg(F.max_by(value, order).alias("__last"))
    flagged = sized(last.where(F.abs("__last") > limit).select(*series))
    return df, df.join(flagged, series, "left_semi")
