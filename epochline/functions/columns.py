"""Expressions and projections that touch many columns at once. None of them runs a job."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def names(value: str | Iterable[str] | None) -> list[str]:
    """A column list from a name, several names or nothing."""
    if value is None:
        return []
    return [value] if isinstance(value, str) else list(value)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(names(exclude))
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def across(df: DataFrame, apply: Callable[[Column], Column], exclude: Iterable[str] = ()) -> DataFrame:
    """Replace every numeric column but the excluded ones by `apply(column)`, in one projection."""
    return df.withColumns({c: apply(F.col(c)) for c in numeric_columns(df, exclude)})


def round_all(df: DataFrame, places: int, exclude: Iterable[str] = (), mode: str = "half_up") -> DataFrame:
    rounding = {"half_up": F.round, "half_even": F.bround}[mode]
    skip = set(names(exclude))
    floats = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)) and f.name not in skip
    ]
    return df.withColumns({c: rounding(F.col(c), places) for c in floats})


def matching(
    columns: Iterable[str],
    contains: Iterable[str] = (),
    prefixes: Iterable[str] = (),
    suffixes: Iterable[str] = (),
) -> list[str]:
    parts, starts, ends = names(contains), tuple(names(prefixes)), tuple(names(suffixes))
    return [c for c in columns if any(p in c for p in parts) or c.startswith(starts) or c.endswith(ends)]


def drop_matching(
    df: DataFrame,
    contains: Iterable[str] = (),
    prefixes: Iterable[str] = (),
    suffixes: Iterable[str] = (),
    keep: Iterable[str] = (),
) -> DataFrame:
    """Drop the columns whose name fits any pattern, unless listed in `keep`."""
    kept = set(names(keep))
    return df.drop(*[c for c in matching(df.columns, contains, prefixes, suffixes) if c not in kept])


def select_mask(df: DataFrame, columns: Sequence[str], mask: Sequence[int], keep: Iterable[str] = ()) -> DataFrame:
    """Keep the columns whose mask entry is set."""
    return df.select(*names(keep), *[c for c, used in zip(columns, mask) if used])


def cast_like(df: DataFrame, other: DataFrame) -> DataFrame:
    """Cast the columns shared with `other` to the types they have there."""
    types = {f.name: f.dataType for f in other.schema.fields}
    return df.withColumns({c: F.col(c).cast(types[c]) for c in df.columns if c in types})


def missing_to_null(df: DataFrame, columns: Iterable[str] | None = None, sentinel: float | None = None) -> DataFrame:
    """One encoding of "missing": NaN and the sentinel become null."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    replaced = {}
    for c in names(columns) if columns is not None else numeric_columns(df):
        value = F.col(c)
        if isinstance(kinds[c], (T.FloatType, T.DoubleType)):
            value = F.when(~F.isnan(value), value)
        if sentinel is not None:
            value = F.when(value != F.lit(sentinel), value)
        replaced[c] = value
    return df.withColumns(replaced)


def null_after(df: DataFrame, key: str, horizon: float, columns: Iterable[str]) -> DataFrame:
    """Blank the listed columns in rows whose key lies beyond the horizon."""
    kept = F.col(key) <= F.lit(horizon)
    return df.withColumns({c: F.when(kept, F.col(c)) for c in names(columns) if c in df.columns})


def add_squares(df: DataFrame, columns: Iterable[str], suffix: str = "_squared") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": F.col(c) * F.col(c) for c in names(columns)})


def lookup_first(
    df: DataFrame, sources: Sequence[tuple[Column, bool]], mapping: Mapping[str, int], out: str
) -> DataFrame:
    """First hit of several text sources in a small constant mapping.

    `sources` pairs each column with whether it is lower-cased before the lookup.
    """
    table = F.create_map(*[F.lit(item) for pair in mapping.items() for item in pair])
    hits = [F.try_element_at(table, F.lower(c) if lowered else c) for c, lowered in sources]
    return df.withColumn(out, F.coalesce(*hits))


def config_key(columns: Iterable[str]) -> Column:
    """`name_value_name_value_…`, equal exactly for equal settings."""
    parts = [F.concat_ws("_", F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in names(columns)]
    return F.concat_ws("_", *parts)


def title_label(column: Column) -> Column:
    """`some_model` as `Some Model`."""
    return F.initcap(F.replace(column, F.lit("_"), F.lit(" ")))
