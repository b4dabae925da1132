"""Dense grids as long tables: index arithmetic, decimation, climatology, yearly means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grid_to_long(df: DataFrame, idx: str, dims: Sequence[tuple[str, int | None, int]]) -> DataFrame:
    """Turn a flat row-major index into one column per dimension.

    `dims` lists (name, size, offset) from the slowest to the fastest; the size of the first is not needed.
    """
    rest = F.col(idx).cast("bigint")
    columns = {}
    for name, size, offset in reversed(list(dims)[1:]):
        columns[name] = (F.pmod(rest, F.lit(size)) + F.lit(offset)).cast("bigint")
        rest = F.floor(rest / F.lit(size)).cast("bigint")
    name, _, offset = dims[0]
    columns[name] = (rest + F.lit(offset)).cast("bigint")
    return df.withColumns({n: columns[n] for n, _, _ in dims})


def decimate(df: DataFrame, cols: Sequence[str], every: int = 2) -> DataFrame:
    """Keep the cells whose coordinates are all multiples of `every`."""
    keep = F.lit(True)
    for c in cols:
        keep = keep & (F.pmod(F.col(c), F.lit(every)) == 0)
    return df.where(keep)


def year_of_month(month: Column, start: int = 1850) -> Column:
    return (F.lit(start) + F.floor(month / F.lit(12))).cast("bigint")


def axis_mean(df: DataFrame, cell: Sequence[str], value: str, out: str | None = None) -> DataFrame:
    """Mean over all other dimensions."""
    return df.groupBy(*cell).agg(F.avg(value).alias(out or value))
