"""What the query modules share: table access, the numeric time axes, and SQL fragments for the oracle."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochline.functions.bins import YEAR_TIERS


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: str


class Registry(dict):
    """Collects the queries of a module by decorator."""

    def query(self, name: str, covers: str, sql: str | None = None):
        def add(run):
            if name in self:
                raise ValueError(f"query {name} is defined twice")
            self[name] = Query(run, sql, covers)
            return run

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, cols: Iterable[str], places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in cols})


def r(expr: str, places: int = 6) -> str:
    """The SQL twin of `rounded`; adding zero turns -0.0 into 0.0."""
    return f"(round({expr}, {places}) + 0.0)"


def days(date: str, origin: str = "1998-01-01") -> Column:
    return F.datediff(F.col(date).cast("date"), F.lit(origin).cast("date"))


def sql_days(date: str, origin: str = "1998-01-01") -> str:
    return f"date_diff('day', DATE '{origin}', {date}::DATE)"


def pseudo_year(date: str) -> Column:
    """A date as a signed year that reaches every tier of the time axis."""
    return (days(date) * 800).cast("bigint")


def sql_pseudo_year(date: str) -> str:
    return f"({sql_days(date)} * 800)::BIGINT"


def micros(ts: str = "ts") -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', {ts})")


def sql_micros(ts: str = "ts") -> str:
    return f"(epoch_us({ts}) - epoch_us(TIMESTAMP '2024-01-01'))"


def sql_tiered(x: str) -> str:
    """The tiered bin as a CASE expression."""
    parts = []
    for tier in YEAR_TIERS:
        value = f"round_even((({x})::DOUBLE + {tier.shift}) / {tier.step}, 0) * {tier.step}"
        parts.append(f"ELSE {value} END" if tier.upper is None else f"WHEN ({x}) < {tier.upper} THEN {value}")
    return f"(CASE {' '.join(parts)})::BIGINT"


def daily(spark: SparkSession, sf_dir: str, by: str = "event_type") -> DataFrame:
    """Events per series and day: mean log value `v` and number of events `n`."""
    events = table(spark, sf_dir, "events")
    keyed = events.select(F.col(by).alias("series"), days("ts", "2024-01-01").cast("bigint").alias("day"), "value")
    return keyed.groupBy("series", "day").agg(F.avg(F.ln("value")).alias("v"), F.count(F.lit(1)).cast("double").alias("n"))


def sql_daily(by: str = "event_type") -> str:
    day = sql_days("ts", "2024-01-01")
    return (
        f"SELECT {by} AS series, {day}::BIGINT AS day, avg(ln(value)) AS v, count(*)::DOUBLE AS n "
        f"FROM events GROUP BY 1, 2"
    )


def sql_interpolate(
    source: str, key: str, cols: list[str], part: list[str] = (), edges: str = "null", axis: str = "row", extra: list[str] = ()
) -> str:
    """Linear interpolation between known neighbours as nested SELECTs over `source`."""
    by = f"PARTITION BY {', '.join(part)} " if part else ""
    keep = ", ".join([*part, key, *extra])
    inner = f"SELECT *, row_number() OVER ({by}ORDER BY {key}) AS rn__ FROM ({source})"
    at = "rn__" if axis == "row" else key
    seen = []
    for c in cols:
        up = f"OVER ({by}ORDER BY {key} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        down = f"OVER ({by}ORDER BY {key} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
        where = f"CASE WHEN {c} IS NOT NULL THEN {at} END"
        seen += [
            f"last_value({c} IGNORE NULLS) {up} AS {c}_y0",
            f"last_value({where} IGNORE NULLS) {up} AS {c}_x0",
            f"first_value({c} IGNORE NULLS) {down} AS {c}_y1",
            f"first_value({where} IGNORE NULLS) {down} AS {c}_x1",
        ]
    middle = f"SELECT *, {', '.join(seen)} FROM ({inner})"
    out = []
    for c in cols:
        line = f"{c}_y0 + ({c}_y1 - {c}_y0) * ({at} - {c}_x0)::DOUBLE / nullif({c}_x1 - {c}_x0, 0)"
        tail = f", {c}_y1, {c}_y0" if edges == "fill" else ""
        out.append(f"coalesce({c}, {line}{tail}) AS {c}")
    return f"SELECT {keep}, {', '.join(out)} FROM ({middle})"
