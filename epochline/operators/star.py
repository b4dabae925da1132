"""Star schema: split a wide frame, join it back, extend a dimension, merge sources."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochline.functions.columns import names
from epochline.operators.stats import latest_by_priority
from epochline.session import sized


def star_split(df: DataFrame, tables: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
    """One frame of distinct rows per table."""
    return {name: df.select(*cols).distinct() for name, cols in tables.items()}


def star_join(
    fact: DataFrame, dims: Mapping[str, DataFrame], key: str, how: str = "left", drop_key: bool = False, measure: bool = False
) -> DataFrame:
    """Join every dimension on the same key.

    Nothing is forced into a broadcast: Spark broadcasts the dimensions whose known size allows it and
    sorts the others; the fact side is then partitioned by the key once for all of them. Set `measure`
    for a large fact with computed dimensions, so that their sizes are known before the fact moves.
    """
    joined = fact
    for dim in dims.values():
        joined = joined.join(sized(dim) if measure else dim, key, how)
    return joined.drop(key) if drop_key else joined


def extend_dimension(dim: DataFrame, keys: DataFrame, key: str, repeat: Iterable[str] = ()) -> DataFrame:
    """Add the keys that the dimension lacks. Columns named in `repeat` take the key's value, all others are null there."""
    fresh = keys.select(F.col(key)).distinct().join(dim.select(key), key, "left_anti")
    same = {key, *names(repeat)}
    rows = fresh.select(
        *[(F.col(key) if f.name in same else F.lit(None)).cast(f.dataType).alias(f.name) for f in dim.schema.fields]
    )
    return dim.distinct().unionByName(rows)


def merge_sources(sources: Sequence[tuple[DataFrame, int]], key: Iterable[str], values: Iterable[str]) -> DataFrame:
    """Rows of several sources, per key those of the source with the highest priority."""
    keys, values = names(key), names(values)
    merged = None
    for df, priority in sources:
        rows = df.select(*keys, *values, F.lit(priority).alias("__priority"))
        merged = rows if merged is None else merged.unionByName(rows)
    return latest_by_priority(merged, keys, "__priority", values)


def range_split(df: DataFrame, key: str, test: tuple[float, float], present: float, forecast_end: float | None = None):
    """Label rows `forecast` (after the present), `test` (in the window, ends included) or `train`."""
    rows = df if forecast_end is None else df.where(F.col(key) <= forecast_end)
    label = (
        F.when(F.col(key) > present, "forecast").when(F.col(key).between(*test), "test").otherwise("train")
    )
    return rows.withColumn("split", label)


def anti_split(df: DataFrame, test: DataFrame, key: Iterable[str]) -> DataFrame:
    """The rows whose key is not in `test`."""
    keys = names(key)
    return df.join(test.select(*keys), keys, "left_anti")
