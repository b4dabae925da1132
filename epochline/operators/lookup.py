"""Lookups along an axis: nearest key, next value on a stride, named intervals, grid cells, re-basing."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochline.functions.columns import names
from epochline.operators.ordered import Fill, NearestKnown, with_ordered
from epochline.session import settle, sized

#: Cells of spans that are sent to every task; more of them are met by sorting.
FEW_CELLS = 10_000


def grid_lookup(df: DataFrame, grid: DataFrame, on: Iterable[str]) -> DataFrame:
    """Values of the matching grid cell, null where the grid has none."""
    return df.join(grid, names(on), "left")


def _merged(df: DataFrame, ref: DataFrame, on: list[str], key: str, t: str, value: str, lane: Column | None) -> DataFrame:
    """Probes and reference values in one frame, ready to be walked in key order."""
    place = {"__at": F.col(key).cast("double"), "__known": F.lit(None).cast("double"), "__side": F.lit(0)}
    probes = df.withColumns(place)
    points = ref.select(
        *on,
        F.col(t).cast("double").alias("__at"),
        F.col(value).cast("double").alias("__known"),
        F.lit(1).alias("__side"),
    ).where(F.col("__known").isNotNull() & ~F.isnan("__known"))
    merged = probes.unionByName(points, allowMissingColumns=True)
    return merged if lane is None else merged.withColumn("__lane", lane)


def _once_per_key(df: DataFrame, keys: list[str], find: Callable[[DataFrame], DataFrame], out: str) -> DataFrame:
    """`find` for the distinct keys, joined back to all rows.

    A key that a third of the rows share is looked up once; in the join, Spark can split its rows.
    """
    found = find(settle(df.select(*keys).distinct(), "keys"))
    named = found.select(*[F.col(c).alias(f"__key{i}") for i, c in enumerate(keys)], F.col(out).alias("__out"))
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & df[c].eqNullSafe(named[f"__key{i}"])
    return df.join(named, same, "left").select(*[df[c] for c in df.columns], named["__out"].alias(out))


def forward_lookup(
    df: DataFrame,
    ref: DataFrame,
    on: Iterable[str],
    key: str,
    t: str,
    value: str,
    step: int = 1,
    out: str | None = None,
    **limits,
) -> DataFrame:
    """Per probe the reference value at its key, or at the first of key + step, key + 2·step, … that has one.

    Probes and reference are merged and walked once in key order within (on, key modulo step). No pairs
    are formed, so a cell with many probes and many values costs their sum and not their product.
    """
    on = names(on)
    lane = F.pmod(F.col("__at"), F.lit(float(step)))

    def find(probes: DataFrame) -> DataFrame:
        merged = _merged(probes, ref, on, key, t, value, lane)
        exprs = {"__found": Fill("__known", direction="backward")}
        found = with_ordered(merged, "__at", exprs, [*on, "__lane"], ["__side"], **limits)
        return found.where(F.col("__side") == 0).select(*probes.columns, F.col("__found").alias(out or value))

    return _once_per_key(df, [*on, key], find, out or value)


def nearest_lookup(
    df: DataFrame, ref: DataFrame, key: str, t: str, on: Iterable[str] = (), out: str = "nearest", **limits
) -> DataFrame:
    """Per probe the nearest reference key, the lower one on a tie."""
    on = names(on)

    def find(probes: DataFrame) -> DataFrame:
        merged = _merged(probes, ref, on, key, t, t, None)
        exprs = {
            "__left": NearestKnown("__known", direction="forward"),
            "__right": NearestKnown("__known", direction="backward"),
        }
        both = with_ordered(merged, "__at", exprs, on, ["__side"], **limits).where(F.col("__side") == 0)
        left, right = F.col("__left.v"), F.col("__right.v")
        at = F.col("__at")
        nearer = F.when(right.isNull() | (at - left <= right - at), left).otherwise(right)
        return both.select(*probes.columns, F.coalesce(nearer, right).alias(out))

    return _once_per_key(df, [*on, key], find, out)


def dyadic_cells(first: Column, last: Column) -> Column:
    """The whole numbers from first to last as cells (level, cell) of a binary hierarchy: `cell` holds 2^level of them.

    There are at most two cells per level, so about 2 log2 of the length.
    """
    empty = F.array().cast("array<struct<level:int,cell:bigint>>")
    start = F.struct(first.cast("bigint").alias("lo"), (last.cast("bigint") + 1).alias("hi"), empty.alias("cells"))

    def climb(state: Column, level: Column) -> Column:
        lo, hi = state["lo"], state["hi"]
        odd = lambda x: x.bitwiseAND(F.lit(1).cast("bigint"))
        cell = lambda at: F.array(F.struct(level.alias("level"), at.alias("cell")))
        left = F.when((lo < hi) & (odd(lo) == 1), cell(lo)).otherwise(empty)
        lo = lo + odd(lo)
        right = F.when((lo < hi) & (odd(hi) == 1), cell(hi - 1)).otherwise(empty)
        up = F.struct(F.shiftright(lo, 1).alias("lo"), F.shiftright(hi - odd(hi), 1).alias("hi"), F.concat(state["cells"], left, right).alias("cells"))
        return F.when(state["lo"] < state["hi"], up).otherwise(state)

    return F.aggregate(F.sequence(F.lit(0), F.lit(62)), start, climb, lambda state: state["cells"])


def label_intervals(
    df: DataFrame, spans: DataFrame, key: str, lo: str = "lo", hi: str = "hi", label: str = "label", bucket: float | None = None
) -> DataFrame:
    """Label every row with the spans that cover its key (ends included); null if there is none.

    A span is split into cells of a binary hierarchy whose least cell is a bucket wide, by default as wide as the
    median span. A row meets the cells that hold its key, one per level that occurs, so this is an equi-join of any
    size, and a span costs the logarithm of its length however long it is. What rows and spans make of each other
    goes straight to the result and is never dealt out again, however much it is. Rows without a span are told by
    their distinct keys, which need to meet one span only.
    """
    spans = sized(spans.select(F.col(lo).alias("__lo"), F.col(hi).alias("__hi"), F.col(label).alias("__label")).where(F.col(lo) <= F.col(hi)))
    if bucket is None:
        long = spans.where("__hi > __lo").agg(F.percentile_approx(F.col("__hi") - F.col("__lo"), 0.5).alias("len")).first()["len"]
        bucket = float(long) if long else 1.0

    def cell(value: Column) -> Column:
        return F.floor(value / F.lit(float(bucket))).cast("bigint")

    cells = F.inline(dyadic_cells(cell(F.col("__lo")), cell(F.col("__hi")))).alias("__level", "__cell")
    pieces = sized(spans.select("*", cells))
    levels = sorted(r["__level"] for r in pieces.select("__level").distinct().collect())  # 63 at most
    few = pieces.count() <= FEW_CELLS

    def met(rows: DataFrame, at: str, how: str) -> DataFrame:
        probes = rows.where(F.col(at).isNotNull()).withColumn("__level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
        probes = probes.withColumn("__from", cell(F.col(at))).withColumn("__cell", F.expr("shiftright(__from, __level)"))
        # The planner takes a row for one, not for one a level, and would send them all through the driver.
        left, right = (probes, F.broadcast(pieces)) if few else (probes.hint("merge"), pieces)
        same = (probes["__level"] == pieces["__level"]) & (probes["__cell"] == pieces["__cell"])
        return left.join(right, same & probes[at].between(pieces["__lo"], pieces["__hi"]), how)

    labelled = met(df, key, "inner").select(*df.columns, F.col("__label").alias(label))
    keys = met(df.select(F.col(key).alias("__key")).distinct(), "__key", "left_semi").select("__key").distinct()
    alone = df.join(keys, df[key] == keys["__key"], "left_anti")
    return labelled.unionAll(alone.select(*df.columns, F.lit(None).cast(labelled.schema[label].dataType).alias(label)))


def label_bands(key: Column, bands: Iterable[tuple[float | None, float | None, str]], default: str | None = None) -> Column:
    """First of a few fixed bands that holds the key (ends included, None is open)."""
    result = F.when(F.lit(False), F.lit(None).cast("string"))
    for low, high, text in bands:
        inside = F.lit(True)
        if low is not None:
            inside = inside & (key >= low)
        if high is not None:
            inside = inside & (key <= high)
        result = result.when(inside, F.lit(text))
    return result.otherwise(F.lit(default)) if default is not None else result


def shift_future(age: Column, limit: float = -50) -> Column:
    """Shift all ages of a record so that the first is not below `limit`; positions stay as they are."""
    ahead = F.greatest(F.lit(0.0), F.lit(float(limit)) - F.get(age, F.lit(0)))
    return F.transform(age, lambda x: x + ahead)


def rebased(
    age: Column, value: Column, newest_age: Column, newest_value: Column, reference: Column, climate: Column, epoch: float = 1950
) -> dict[str, Column]:
    """`year`, `anomaly` and `degC` of an observation relative to the most recent one of its series.

    The anomaly is the difference to the most recent value plus the reference anomaly there; the
    temperature is the climate plus the anomaly.
    """
    anomaly = value - newest_value + reference
    newest_year = F.lit(epoch) - newest_age.cast("bigint")
    return {
        "year": F.bround(newest_year - (age - newest_age)).cast("bigint"),
        "anomaly": anomaly,
        "degC": climate + anomaly,
    }


def rebase(
    df: DataFrame, series: Iterable[str], key: str, value: str, reference: str, climate: str, epoch: float = 1950
) -> DataFrame:
    """Re-base series that come as one row per observation; `key` is an age, the least is the most recent.

    The most recent row comes from an aggregate per series that is joined back, so no series has to fit
    into a task. Adds `year`, `anomaly` and `degC`.
    """
    series = names(series)
    known = df.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    newest = known.groupBy(*series).agg(F.min(key).alias("__age"), F.min_by(value, key).alias("__value"))
    joined = known.join(sized(newest), series)
    columns = rebased(
        F.col(key), F.col(value), F.col("__age"), F.col("__value"), F.col(reference), F.col(climate), epoch
    )
    return joined.select(*df.columns, *[c.alias(n) for n, c in columns.items()])
