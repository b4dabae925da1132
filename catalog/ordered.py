"""Ordered series: lags, differences, smoothing, gap filling, ids, re-basing, splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.common import (
    Registry,
    daily,
    days,
    micros,
    pseudo_year,
    r,
    rounded,
    sql_daily,
    sql_days,
    sql_interpolate,
    sql_micros,
    sql_pseudo_year,
    sql_tiered,
    table,
)
from epochline.functions.bins import tiered_bin
from epochline.operators import lookup, series
from epochline.operators.clean import quarantine_extreme
from epochline.operators.ordered import Delta, Fill, Interpolate, Lag, Position, Rolling, with_ordered

QUERIES = Registry()
query = QUERIES.query

DAILY = sql_daily()


@query(
    "lag_features",
    "W1",
    f"""SELECT series, day, {r('v', 5)} AS v, {r('lag(v, 2) OVER w', 5)} AS v_lagged_2, {r('lag(v, 5) OVER w', 5)} AS v_lagged_5,
      lag(n, 2) OVER w AS n_lagged_2, lag(n, 5) OVER w AS n_lagged_5, n FROM ({DAILY}) WINDOW w AS (PARTITION BY series ORDER BY day)""",
)
def lag_features(spark, sf_dir):
    lagged = series.add_lags(daily(spark, sf_dir), "day", ["v", "n"], [2, 5], ["series"])
    return rounded(lagged, ["v", "v_lagged_2", "v_lagged_5"], 5)


@query(
    "event_gaps",
    "W1 W2",
    f"""SELECT event_id, moment - lag(moment) OVER w AS gap, lag(value, 20) OVER w AS earlier
    FROM (SELECT *, {sql_micros()} AS moment FROM events) WINDOW w AS (PARTITION BY event_type ORDER BY moment, event_id)""",
)
def event_gaps(spark, sf_dir):
    """Lags over raw events, where one series may hold a large share of the table."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value", micros().alias("at"))
    exprs = {"gap": Delta("at", k=1), "earlier": Lag("value", k=20)}
    return with_ordered(events, "at", exprs, ["event_type"], ["event_id"]).select("event_id", "gap", "earlier")


@query(
    "delta_features",
    "W2",
    f"""SELECT series, day, {r('v - lag(v) OVER w', 5)} AS delta_v, n - lag(n) OVER w AS delta_n FROM ({DAILY})
    WINDOW w AS (PARTITION BY series ORDER BY day)""",
)
def delta_features(spark, sf_dir):
    return rounded(series.add_deltas(daily(spark, sf_dir), "day", ["v", "n"], ["series"]), ["delta_v"], 5).drop("v", "n")


@query(
    "rolling_centered",
    "W3",
    f"""SELECT series, day, {r('CASE WHEN count(v) OVER w = 3 THEN avg(v) OVER w END', 5)} AS v
    FROM (SELECT series, day, CASE WHEN n >= 3 THEN v END AS v FROM ({sql_daily('user_id')}))
    WINDOW w AS (PARTITION BY series ORDER BY day ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""",
)
def rolling_centered(spark, sf_dir):
    rows = daily(spark, sf_dir, "user_id").select("series", "day", F.when(F.col("n") >= 3, F.col("v")).alias("v"))
    return rounded(series.rolling_mean(rows, "day", ["v"], series=["series"]), ["v"], 5)


GAPPY = f"SELECT series, day, CASE WHEN n >= 3 THEN v END AS v FROM ({sql_daily('user_id')})"


def gappy(spark, sf_dir):
    return daily(spark, sf_dir, "user_id").select("series", "day", F.when(F.col("n") >= 3, F.col("v")).alias("v"))


@query("interpolate_rows", "W4", f"SELECT series, day, {r('v', 5)} AS v FROM ({sql_interpolate(GAPPY, 'day', ['v'], ['series'])})")
def interpolate_rows(spark, sf_dir):
    return rounded(series.interpolate(gappy(spark, sf_dir), "day", ["v"], ["series"]), ["v"], 5)


@query(
    "interpolate_keys",
    "W4",
    f"SELECT series, day, {r('v', 5)} AS v FROM ({sql_interpolate(GAPPY, 'day', ['v'], ['series'], axis='key')})",
)
def interpolate_keys(spark, sf_dir):
    return rounded(series.interpolate(gappy(spark, sf_dir), "day", ["v"], ["series"], axis="key"), ["v"], 5)


@query(
    "fill_both",
    "W5",
    f"""SELECT series, day, {r('''coalesce(first_value(v IGNORE NULLS) OVER (PARTITION BY series ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
      last_value(v IGNORE NULLS) OVER (PARTITION BY series ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))''', 5)} AS v
    FROM ({GAPPY})""",
)
def fill_both(spark, sf_dir):
    return rounded(series.fill_both(gappy(spark, sf_dir), "day", ["v"], ["series"]), ["v"], 5)


HOURLY = f"""SELECT event_type AS series, floor({sql_micros()} / 3600000000)::BIGINT AS hour,
  max(CASE WHEN value < 200 THEN value END) AS v FROM events GROUP BY 1, 2"""


@query(
    "stride_fill",
    "W6",
    f"""SELECT series, hour, first_value(v IGNORE NULLS) OVER (PARTITION BY series, hour % 24 ORDER BY hour
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM ({HOURLY})""",
)
def stride_fill(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("hour", F.floor(micros() / 3_600_000_000).cast("bigint"))
    hourly = events.groupBy(F.col("event_type").alias("series"), "hour").agg(
        F.max(F.when(F.col("value") < 200, F.col("value"))).alias("v")
    )
    return series.stride_fill(hourly, "hour", "v", 24, ["series"])


@query(
    "head_pad_lag",
    "W7",
    f"""SELECT series, day, coalesce(lag(n, 4) OVER w, first_value(n) OVER w) AS n_lagged_4, {r('v - coalesce(lag(v) OVER w, v)', 5)} AS delta_v
    FROM ({DAILY}) WINDOW w AS (PARTITION BY series ORDER BY day)""",
)
def head_pad_lag(spark, sf_dir):
    exprs = {"n_lagged_4": Lag("n", k=4, pad="first"), "delta_v": Delta("v", k=1, pad="first")}
    return rounded(with_ordered(daily(spark, sf_dir), "day", exprs, ["series"]), ["delta_v"], 5).drop("v", "n")


@query(
    "dense_id",
    "W8",
    """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) + 1000 AS temperature_id FROM orders""",
)
def dense_id(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return series.dense_id(orders, ["o_orderdate", "o_orderkey"], "temperature_id", offset=1000).drop("o_orderdate")


AGED = "SELECT user_id, event_id, value, (event_id * 0.5)::DOUBLE AS age FROM events"


@query(
    "rebase_first",
    "W9",
    f"""WITH e AS ({AGED}), h AS (SELECT user_id, arg_min(value, age) AS v0, min(age) AS a0 FROM e GROUP BY 1)
    SELECT event_id, round_even((1950 - trunc(a0)) - (age - a0), 0)::BIGINT AS year, {r('value - v0 + 0.5')} AS anomaly,
      {r('15 + (value - v0 + 0.5)')} AS "degC" FROM e JOIN h USING (user_id)""",
)
def rebase_first(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "user_id",
        "event_id",
        "value",
        (F.col("event_id") * 0.5).alias("age"),
        F.lit(0.5).alias("reference"),
        F.lit(15.0).alias("climate"),
    )
    based = lookup.rebase(events, ["user_id"], "age", "value", "reference", "climate")
    return rounded(based.select("event_id", "year", "anomaly", "degC"), ["anomaly", "degC"])


@query(
    "shift_future",
    "W10",
    f"""SELECT vec_id, i - 1 AS pos, {r('(embedding[i] * 1000)::DOUBLE + greatest(0, -50 - (embedding[1] * 1000)::DOUBLE)', 4)} AS age
    FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""",
)
def shift_future(spark, sf_dir):
    ages = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: (x * F.lit(1000).cast("float")).cast("double")).alias("age")
    )
    shifted = ages.withColumn("age", lookup.shift_future(F.col("age")))
    rows = shifted.select("vec_id", F.posexplode("age").alias("pos", "age"))
    return rounded(rows.withColumn("pos", F.col("pos").cast("bigint")), ["age"], 4)


@query(
    "extreme_series",
    "W11",
    """WITH l AS (SELECT user_id, arg_max(value, event_id) AS last FROM events GROUP BY 1)
    SELECT event_id, user_id, value FROM events JOIN l USING (user_id) WHERE abs(last) > 100""",
)
def extreme_series(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    _, extreme = quarantine_extreme(events, ["user_id"], "event_id", "value", limit=100)
    return extreme


@query(
    "latest_value",
    "W12",
    "SELECT user_id, arg_max(value, event_id) AS value, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1",
)
def latest_value(spark, sf_dir):
    return series.latest_value(table(spark, sf_dir, "events"), "event_id", ["value", "event_type"], ["user_id"])


@query(
    "chrono_split",
    "W13",
    """SELECT event_id, CASE WHEN rn <= floor(n * 0.9) THEN 'train' ELSE 'test' END AS split FROM
      (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events)""",
)
def chrono_split(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return series.chrono_split(events, "event_id", 0.9, ["event_type"]).drop("event_type")


YEARS = f"""SELECT {sql_tiered(sql_pseudo_year('o_orderdate'))} AS year_bin, ln(o_totalprice) AS price,
  CASE WHEN o_orderstatus = 'O' AND o_totalprice > 300000 THEN ln(o_totalprice) END AS open_price FROM orders"""
FILL_SOURCE = f"""SELECT year_bin, price, open_price FROM (
  SELECT DISTINCT {sql_tiered(sql_pseudo_year('l_shipdate'))} AS year_bin FROM lineitem UNION SELECT year_bin FROM ({YEARS}))
  LEFT JOIN (SELECT year_bin, avg(price) AS price, avg(open_price) AS open_price FROM ({YEARS}) GROUP BY 1) USING (year_bin)"""


@query(
    "bin_and_fill",
    "C1 C2 W4 W5 P26",
    f"""SELECT year_bin, {r('price')} AS price, {r('CASE WHEN year_bin <= 2025 THEN open_price END')} AS open_price
    FROM ({sql_interpolate(FILL_SOURCE, 'year_bin', ['price', 'open_price'], edges='fill')})""",
)
def bin_and_fill(spark, sf_dir):
    """Flagship: irregular measurements onto a variable-resolution axis, gaps filled, nothing past the horizon."""
    price = F.col("o_totalprice")
    is_open = (F.col("o_orderstatus") == "O") & (price > 300000)
    orders = table(spark, sf_dir, "orders").select(
        pseudo_year("o_orderdate").alias("year"), F.ln(price).alias("price"), F.when(is_open, F.ln(price)).alias("open_price")
    )
    shipped = table(spark, sf_dir, "lineitem").select(tiered_bin(pseudo_year("l_shipdate")).alias("year_bin"))
    filled = series.bin_and_fill(
        orders,
        "year",
        tiered_bin(F.col("year")),
        shipped,
        ["price", "open_price"],
        horizon=2025,
        horizon_cols=["open_price"],
    )
    return rounded(filled, ["price", "open_price"])


SPAN = f"""SELECT series, unnest(range(lo, hi + 1)) AS day FROM (SELECT series, min(day) AS lo, max(day) AS hi FROM ({sql_daily('user_id')}) GROUP BY 1)"""


@query(
    "gapfill_by_series",
    "C1 C2",
    f"""SELECT series, day, {r('v')} AS v FROM ({sql_interpolate(
        f"SELECT series, day, v FROM ({SPAN}) LEFT JOIN ({sql_daily('user_id')}) USING (series, day)", 'day', ['v'], ['series'], edges='fill')})""",
)
def gapfill_by_series(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("series"), days("ts", "2024-01-01").cast("bigint").alias("at"), F.ln("value").alias("v")
    )
    spine = series.regular_spine(events, "at", 1, ["series"]).withColumnRenamed("at", "day")
    filled = series.bin_and_fill(events, "at", F.col("at"), spine, ["v"], ["series"], out="day")
    return rounded(filled, ["v"])


@query(
    "absolute_after_fill",
    "C5",
    f"""SELECT day, {r('abs(v)')} AS "VADM" FROM ({sql_interpolate(
        f"SELECT {sql_days('ts', '2024-01-01')}::BIGINT AS day, avg(CASE WHEN event_type = 'click' THEN ln(value) - 4 END) AS v FROM events GROUP BY 1",
        'day', ['v'], edges='fill')})""",
)
def absolute_after_fill(spark, sf_dir):
    signed = F.when(F.col("event_type") == "click", F.ln("value") - 4)
    events = table(spark, sf_dir, "events").select(days("ts", "2024-01-01").cast("bigint").alias("at"), signed.alias("VADM"))
    filled = series.bin_and_fill(events, "at", F.col("at"), None, ["VADM"], out="day")
    return filled.withColumn("VADM", F.round(F.abs("VADM"), 6))


PAST = f"SELECT series, day, CASE WHEN n >= 3 THEN v END AS v FROM ({sql_daily('user_id')}) WHERE day < 20"


@query(
    "interpolate_past",
    "C11",
    f"""SELECT series, day, {r('v', 5)} AS v FROM ({sql_interpolate(PAST, 'day', ['v'], ['series'])})
    UNION ALL SELECT series, day, {r('v', 5)} FROM ({GAPPY}) WHERE day >= 20""",
)
def interpolate_past(spark, sf_dir):
    filled = series.interpolate_where(gappy(spark, sf_dir), "day", ["v"], F.col("day") < 20, ["series"])
    return rounded(filled, ["v"], 5)


@query(
    "rolling_events",
    "W3 W8",
    f"""SELECT event_id, {r('avg(value) OVER w')} AS smooth, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS pos FROM events
    WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 6 PRECEDING AND 3 FOLLOWING)""",
)
def rolling_events(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    exprs = {"smooth": Rolling("value", before=6, after=3, min_count=1), "pos": Position()}
    return rounded(with_ordered(events, "event_id", exprs, ["event_type"]), ["smooth"]).select("event_id", "smooth", "pos")


LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query(
    "fact_ids",
    "W8",
    f"""SELECT row_number() OVER (ORDER BY {', '.join(LINE_ORDER)}) AS temperature_id, {', '.join(LINE_ORDER)} FROM lineitem""",
)
def fact_ids(spark, sf_dir):
    """Consecutive ids over the largest table, which is one single series."""
    return series.dense_id(table(spark, sf_dir, "lineitem").select(*LINE_ORDER), LINE_ORDER, "temperature_id")


SQL_PRICE_CHANGES = f"""WITH l AS (SELECT *, CASE WHEN l_quantity < 30 THEN l_extendedprice END AS known FROM lineitem),
    w AS (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY {', '.join(LINE_ORDER)}, l_quantity) AS rn FROM l),
    k AS (SELECT *, last_value(known IGNORE NULLS) OVER (PARTITION BY l_linestatus ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before,
      first_value(known IGNORE NULLS) OVER (PARTITION BY l_linestatus ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after,
      lag(l_extendedprice, 3) OVER (PARTITION BY l_linestatus ORDER BY rn) AS earlier FROM w)
    SELECT {', '.join(LINE_ORDER)}, coalesce(after, before) AS filled, earlier FROM k"""


@query("price_changes", "W1 W2 W4 W5", SQL_PRICE_CHANGES)
def price_changes(spark, sf_dir, **limits):
    """Lags and fills over two series that split the largest table between them."""
    lineitem = table(spark, sf_dir, "lineitem").select(*LINE_ORDER, "l_linestatus", "l_quantity")
    known = lineitem.withColumn("known", F.when(F.col("l_quantity") < 30, F.col("l_extendedprice")))
    exprs = {"filled": Fill("known"), "earlier": Lag("l_extendedprice", k=3)}
    first, *rest = LINE_ORDER
    found = with_ordered(known, first, exprs, ["l_linestatus"], [*rest, "l_quantity"], **limits)
    return found.select(*LINE_ORDER, "filled", "earlier")


@query("price_changes_segments", "W1 W2 W5", SQL_PRICE_CHANGES)
def price_changes_segments(spark, sf_dir):
    """The same in segments of a few thousand rows, so that every value is carried over many bounds."""
    return price_changes(spark, sf_dir, group_limit=3000)


@query(
    "events_segments",
    "W1 W2 W3 W4 W7 W13",
    f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS pos, count(*) OVER (PARTITION BY event_type) AS n,
      CASE WHEN event_id % 7 < 2 THEN value END AS known FROM events),
    k AS (SELECT *, max(CASE WHEN known IS NOT NULL THEN pos END) OVER a AS p0, min(CASE WHEN known IS NOT NULL THEN pos END) OVER b AS p1,
      last_value(known IGNORE NULLS) OVER a AS y0, first_value(known IGNORE NULLS) OVER b AS y1, avg(value) OVER f AS smooth,
      value - coalesce(lag(value, 2) OVER w, first_value(value) OVER w) AS change FROM e
      WINDOW w AS (PARTITION BY event_type ORDER BY event_id), a AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING),
        b AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
        f AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 6 PRECEDING AND 3 FOLLOWING))
    SELECT event_id, pos, {r('smooth')} AS smooth, {r('change')} AS change, {r('coalesce(known, y0 + (y1 - y0) * (pos - p0) / nullif(p1 - p0, 0))')} AS line,
      CASE WHEN pos <= floor(n * 0.9) THEN 'train' ELSE 'test' END AS split FROM k""",
)
def events_segments(spark, sf_dir):
    """Positions, means, differences, lines and a split over a few long series, in segments of some hundred rows."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    events = events.withColumn("known", F.when(F.col("event_id") % 7 < 2, F.col("value")))
    exprs = {
        "smooth": Rolling("value", before=6, after=3, min_count=1),
        "pos": Position(),
        "change": Delta("value", k=2, pad="first"),
        "line": Interpolate("known"),
    }
    found = with_ordered(events, "event_id", exprs, ["event_type"], group_limit=300)
    found = series.chrono_split(found, "event_id", series=["event_type"], group_limit=300)
    return rounded(found, ["smooth", "change", "line"]).select("event_id", "pos", "smooth", "change", "line", "split")


@query(
    "numbered_duplicates",
    "W8",
    """WITH n AS (SELECT l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT flag, n, n AS dense, n AS sparse, (SELECT sum(n) FROM n)::BIGINT AS last FROM n""",
)
def numbered_duplicates(spark, sf_dir):
    """Ids of rows that are equal many times over: as many ids as rows, the dense ones without a gap."""
    flags = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"))
    numbered = series.number_rows(series.number_rows(flags, "dense"), "sparse", consecutive=False)
    counts = numbered.groupBy("flag").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("dense").alias("dense"), F.countDistinct("sparse").alias("sparse"), F.max("dense").alias("top")
    )
    return counts.select("flag", "n", "dense", "sparse", F.max("top").over(Window.partitionBy()).alias("last"))
