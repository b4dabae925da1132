"""Aggregations, scaling and data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import Registry, daily, pseudo_year, r, rounded, sql_daily, sql_pseudo_year, sql_tiered, table
from catalog.sources import GRID_DIMS, GRID_SQL, flat_grid
from epochline.functions.bins import tiered_bin
from epochline.operators import clean, series, star, stats
from epochline.operators.grid import axis_mean, grid_to_long, year_of_month

QUERIES = Registry()
query = QUERIES.query

GRID = f"SELECT idx // 64 AS month, (idx % 64) // 8 - 3 AS lat, idx % 8 - 3 AS lon, value FROM ({GRID_SQL})"


def grid(spark, sf_dir):
    return grid_to_long(flat_grid(spark, sf_dir), "idx", GRID_DIMS)


@query("group_mean", "A1", f"SELECT l_suppkey, {r('avg(ln(l_extendedprice))')} AS price FROM lineitem GROUP BY 1")
def group_mean(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg(F.ln("l_extendedprice")), 6).alias("price"))


@query(
    "group_mean_cell_year",
    "A2",
    f"SELECT lat, lon, (1850 + month // 12)::BIGINT AS year, {r('avg(value)')} AS anomaly FROM ({GRID}) GROUP BY 1, 2, 3",
)
def group_mean_cell_year(spark, sf_dir):
    rows = grid(spark, sf_dir).withColumn("year", year_of_month(F.col("month")))
    return rows.groupBy("lat", "lon", "year").agg(F.round(F.avg("value"), 6).alias("anomaly"))


@query(
    "chunk_mean",
    "A4",
    f"""SELECT series, (rn // 4)::BIGINT AS group_number, {r('avg(day)')} AS day, {r('avg(v)', 5)} AS v, {r('avg(n)')} AS n
    FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day) AS rn FROM ({sql_daily()})) GROUP BY 1, 2""",
)
def chunk_mean(spark, sf_dir):
    chunks = series.chunk_mean(daily(spark, sf_dir), "day", 4, ["day", "v", "n"], ["series"])
    return rounded(rounded(chunks, ["day", "n"]), ["v"], 5)


@query(
    "priority_merge",
    "A5 C3 U1",
    f"""WITH o AS (SELECT {sql_tiered(sql_pseudo_year('o_orderdate'))} AS year_bin, o_orderstatus, o_totalprice FROM orders),
    m AS (SELECT year_bin, max(o_totalprice) AS co2, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS p
          FROM o GROUP BY year_bin, o_orderstatus)
    SELECT year_bin, arg_max(co2, p) AS co2_ppm, {r('5.35 * ln(arg_max(co2, p) / 228)')} AS co2_radiative_forcing FROM m GROUP BY 1""",
)
def priority_merge(spark, sf_dir):
    from epochline.functions.derive import radiative_forcing

    year_bin = tiered_bin(pseudo_year("o_orderdate")).alias("year_bin")
    orders = table(spark, sf_dir, "orders")
    sources = []
    for priority, status in enumerate(("F", "O", "P")):
        rows = orders.where(F.col("o_orderstatus") == status).groupBy(year_bin)
        sources.append((rows.agg(F.max("o_totalprice").alias("co2_ppm")), priority))
    merged = star.merge_sources(sources, ["year_bin"], ["co2_ppm"])
    return merged.withColumn("co2_radiative_forcing", F.round(radiative_forcing(F.col("co2_ppm")), 6))


@query(
    "iqr_filter",
    "A6",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, q
    WHERE l_extendedprice BETWEEN q1 - 0.4 * (q3 - q1) AND q3 + 0.4 * (q3 - q1)""",
)
def iqr_filter(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return clean.iqr_filter(lineitem, "l_extendedprice", k=0.4)


@query(
    "iqr_bounds_nearest",
    "A6",
    """WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events),
    q AS (SELECT max(CASE WHEN i = floor((n - 1) * 0.25 + 0.5) THEN value END) AS q1,
                 max(CASE WHEN i = floor((n - 1) * 0.75 + 0.5) THEN value END) AS q3 FROM s)
    SELECT event_id, value FROM events, q WHERE value BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1)""",
)
def iqr_bounds_nearest(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "value")
    return clean.iqr_filter(events, "value", k=0.5, method="nearest")


@query(
    "iqr_filter_by_series",
    "A6",
    """WITH q AS (SELECT l_shipdate AS day, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1)
    SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem JOIN q ON l_shipdate = day
    WHERE l_extendedprice BETWEEN q1 - 0.4 * (q3 - q1) AND q3 + 0.4 * (q3 - q1)""",
)
def iqr_filter_by_series(spark, sf_dir):
    """Outliers of every day for itself."""
    lineitem = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    return clean.iqr_filter(lineitem, "l_extendedprice", k=0.4, by=["l_shipdate"]).drop("l_shipdate")


@query(
    "quantiles_by_flag",
    "A6",
    """SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, quantile_cont(l_quantity, 0.1) AS q10, quantile_cont(l_quantity, 0.5) AS q50,
      quantile_cont(l_extendedprice, 0.99) AS p99 FROM lineitem GROUP BY 1, 2""",
)
def quantiles_by_flag(spark, sf_dir):
    """A few large groups, one column of which repeats few values."""
    lineitem = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_quantity", "l_extendedprice")
    quantity = clean.group_quantiles(lineitem, ["flag", "status"], "l_quantity", [0.1, 0.5])
    price = clean.group_quantiles(lineitem, ["flag", "status"], "l_extendedprice", [0.99]).withColumnRenamed("quantiles", "p").drop("n")
    joined = quantity.join(price, ["flag", "status"])
    return joined.select("flag", "status", "n", F.col("quantiles")[0].alias("q10"), F.col("quantiles")[1].alias("q50"), F.col("p")[0].alias("p99"))


@query(
    "extent",
    "A7 A14",
    "SELECT o_orderstatus, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(o_totalprice) AS n FROM orders GROUP BY 1",
)
def extent(spark, sf_dir):
    return stats.extent(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderstatus"])


@query("distinct_values", "A8", "SELECT DISTINCT lang, source FROM documents")
def distinct_values(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", "source").distinct()


@query(
    "standard_scale",
    "A9 C12",
    f"""WITH s AS (SELECT avg(p_size) AS m1, stddev_pop(p_size) AS s1, avg(p_retailprice) AS m2, stddev_pop(p_retailprice) AS s2 FROM part)
    SELECT p_partkey, {r('(p_size - m1) / s1')} AS p_size, {r('(p_retailprice - m2) / s2')} AS p_retailprice, 0.0::DOUBLE AS flat FROM part, s""",
)
def standard_scale(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", F.lit(7.0).alias("flat"))
    return rounded(stats.standard_scale(part, exclude=["p_partkey"]), ["p_size", "p_retailprice"])


@query("axis_mean", "A10", f"SELECT lat, lon, {r('avg(value)')} AS climate FROM ({GRID}) GROUP BY 1, 2")
def axis_means(spark, sf_dir):
    return rounded(axis_mean(grid(spark, sf_dir), ["lat", "lon"], "value", "climate"), ["climate"])


@query(
    "weighted_mean",
    "A11",
    f"""SELECT month, {r('sum(value * cos(radians(lat * 20))) / sum(cos(radians(lat * 20)))')} AS global_mean FROM ({GRID}) GROUP BY 1""",
)
def weighted_mean(spark, sf_dir):
    weight = stats.latitude_weight(F.col("lat") * 20)
    return rounded(stats.weighted_mean(grid(spark, sf_dir), "value", weight, ["month"], "global_mean"), ["global_mean"])


@query(
    "mean_squared_error",
    "A12",
    f"""SELECT l_returnflag, {r('avg(pow(l_quantity - CASE WHEN l_tax > 0 THEN l_extendedprice / 1500 END, 2))', 5)} AS mse FROM lineitem GROUP BY 1""",
)
def mean_squared_error(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem").withColumn("pred", F.when(F.col("l_tax") > 0, F.col("l_extendedprice") / 1500))
    return rounded(stats.mse(lineitem, "l_quantity", "pred", ["l_returnflag"]), ["mse"], 5)


@query(
    "fold_means",
    "A13",
    f"""SELECT l_suppkey, {r('avg(m)', 5)} AS pred FROM
      (SELECT l_suppkey, l_linenumber, avg(ln(l_extendedprice)) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1""",
)
def fold_means(spark, sf_dir):
    by_fold = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.avg(F.ln("l_extendedprice")).alias("m"))
    return by_fold.groupBy("l_suppkey").agg(F.round(F.avg("m"), 5).alias("pred"))


@query(
    "trend_by_segment",
    "A15",
    f"""SELECT CASE WHEN year < 2025 THEN 'before' ELSE 'after' END AS segment, {r('regr_slope(o_totalprice, year)', 8)} AS slope,
      {r('regr_intercept(o_totalprice, year)', 3)} AS intercept, {r('regr_r2(o_totalprice, year)', 8)} AS r2, count(*) AS n
    FROM (SELECT o_totalprice, {sql_pseudo_year('o_orderdate')} AS year FROM orders) GROUP BY 1""",
)
def trend_by_segment(spark, sf_dir):
    year = pseudo_year("o_orderdate")
    orders = table(spark, sf_dir, "orders").select(
        "o_totalprice", year.alias("year"), F.when(year < 2025, "before").otherwise("after").alias("segment")
    )
    lines = stats.trend(orders, "year", "o_totalprice", ["segment"])
    return rounded(rounded(lines, ["slope", "r2"], 8), ["intercept"], 3)


@query(
    "minmax_scale",
    "C13",
    f"""WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
    g AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1)
    SELECT event_id, {r('(value - b.lo) / (b.hi - b.lo)')} AS value, {r('(value - g.lo) / (g.hi - g.lo)')} AS within
    FROM events JOIN g USING (event_type), b""",
)
def minmax_scale(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value", F.col("value").alias("within"))
    scaled = stats.minmax_scale(stats.minmax_scale(events, ["value"]), ["within"], ["event_type"])
    return rounded(scaled, ["value", "within"]).drop("event_type")


@query(
    "unpivot_long",
    "C15",
    """SELECT l_orderkey, l_linenumber, variable, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem)
    UNPIVOT (value FOR variable IN (l_quantity, l_discount, l_tax))""",
)
def unpivot_long(spark, sf_dir):
    return stats.to_long(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


@query("key_check", "Q1", "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def key_check(spark, sf_dir):
    return clean.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])


@query(
    "repair_shifted",
    "Q2",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'R' THEN l_tax END AS depth, l_quantity AS age, l_discount AS al,
      CASE WHEN l_returnflag <> 'A' THEN l_extendedprice END AS be FROM lineitem""",
)
def repair_shifted(spark, sf_dir):
    """The rows of one return flag lost their first cell and are moved one column to the left; good rows of another end in an empty cell."""
    lost = F.col("l_returnflag") == "R"
    cells = ["l_tax", "l_quantity", "l_discount", "priced"]
    names = ["depth", "age", "al", "be"]
    moved = [
        F.when(lost, F.col(cells[i + 1]) if i < 3 else F.lit(None)).otherwise(F.col(cells[i])).alias(names[i]) for i in range(4)
    ]
    rows = table(spark, sf_dir, "lineitem").withColumn("priced", F.when(F.col("l_returnflag") != "A", F.col("l_extendedprice")))
    broken = rows.select("l_orderkey", "l_linenumber", *moved)
    return clean.repair_shifted(broken, names, clean.leading_lost(names, "al", (0, 0.5)))
