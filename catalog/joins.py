"""Joins and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import Registry, days, micros, pseudo_year, r, rounded, sql_days, sql_micros, sql_pseudo_year, sql_tiered, table
from catalog.sources import GRID_DIMS, GRID_SQL, flat_grid
from epochline.functions.bins import floor_bin, tiered_bin
from epochline.operators import lookup, star
from epochline.operators.grid import axis_mean, grid_to_long
from epochline.operators.series import make_spine, regular_spine

QUERIES = Registry()
query = QUERIES.query

SHIPPED = """SELECT l_partkey, l_suppkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2"""


def shipped(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("qty"))


def returned(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    return rows.groupBy("l_partkey", "l_suppkey").agg(F.max("l_discount").alias("top"))


RETURNED = "SELECT l_partkey, l_suppkey, max(l_discount) AS top FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2"


@query("two_key_inner", "J1", f"SELECT l_partkey, l_suppkey, qty, top FROM ({SHIPPED}) JOIN ({RETURNED}) USING (l_partkey, l_suppkey)")
def two_key_inner(spark, sf_dir):
    return shipped(spark, sf_dir).join(returned(spark, sf_dir), ["l_partkey", "l_suppkey"])


@query("two_key_left", "J2", f"SELECT l_partkey, l_suppkey, qty, top FROM ({SHIPPED}) LEFT JOIN ({RETURNED}) USING (l_partkey, l_suppkey)")
def two_key_left(spark, sf_dir):
    return lookup.grid_lookup(shipped(spark, sf_dir), returned(spark, sf_dir), ["l_partkey", "l_suppkey"])


def _bin_measures(spark, sf_dir):
    year_bin = tiered_bin(pseudo_year("o_orderdate")).alias("year_bin")
    orders = table(spark, sf_dir, "orders")
    dims = {}
    for status, name in (("F", "co2_ppm"), ("O", "insolation"), ("P", "be_ppm")):
        rows = orders.where(F.col("o_orderstatus") == status)
        dims[name] = rows.groupBy(year_bin).agg(F.max("o_totalprice").alias(name))
    return dims


@query(
    "chained_left_joins",
    "J3",
    f"""WITH o AS (SELECT {sql_tiered(sql_pseudo_year('o_orderdate'))} AS year_bin, o_orderstatus, o_totalprice FROM orders),
    f AS (SELECT l_orderkey, l_linenumber, l_quantity, {sql_tiered(sql_pseudo_year('l_shipdate'))} AS year_bin FROM lineitem)
    SELECT f.*, a.co2_ppm, b.insolation, c.be_ppm FROM f
    LEFT JOIN (SELECT year_bin, max(o_totalprice) AS co2_ppm FROM o WHERE o_orderstatus = 'F' GROUP BY 1) a USING (year_bin)
    LEFT JOIN (SELECT year_bin, max(o_totalprice) AS insolation FROM o WHERE o_orderstatus = 'O' GROUP BY 1) b USING (year_bin)
    LEFT JOIN (SELECT year_bin, max(o_totalprice) AS be_ppm FROM o WHERE o_orderstatus = 'P' GROUP BY 1) c USING (year_bin)""",
)
def chained_left_joins(spark, sf_dir):
    fact = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", tiered_bin(pseudo_year("l_shipdate")).alias("year_bin")
    )
    return star.star_join(fact, _bin_measures(spark, sf_dir), "year_bin", measure=True)


DAY_SQL = sql_days("o_orderdate")


@query(
    "right_join_future_keys",
    "J4 C7 U2 U4",
    f"""WITH d AS (SELECT DISTINCT {DAY_SQL}::BIGINT AS time_id FROM orders),
    s AS (SELECT unnest(range(min(time_id), max(time_id) + 91)) AS time_id FROM d),
    f AS (SELECT {DAY_SQL}::BIGINT AS time_id, {r('avg(ln(o_totalprice))')} AS anomaly FROM orders GROUP BY 1)
    SELECT s.time_id, s.time_id AS year_bin, f.anomaly FROM f RIGHT JOIN s ON f.time_id = s.time_id""",
)
def right_join_future_keys(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("time_id", days("o_orderdate").cast("bigint"))
    fact = orders.groupBy("time_id").agg(F.round(F.avg(F.ln("o_totalprice")), 6).alias("anomaly"))
    dim = orders.select("time_id", F.col("time_id").alias("year_bin")).distinct()
    later = orders.select((F.col("time_id") + 90).alias("time_id"))
    spine = regular_spine(make_spine(orders, later, key="time_id"), "time_id", 1)
    return fact.join(star.extend_dimension(dim, spine, "time_id", ["year_bin"]), "time_id", "right")


@query(
    "star_join",
    "J5 A1",
    f"""SELECT f.o_custkey, f.n, {r('f.spent')} AS spent, c.c_mktsegment, x.top FROM
      (SELECT o_custkey, count(*) AS n, avg(ln(o_totalprice)) AS spent FROM orders GROUP BY 1) f
    LEFT JOIN (SELECT c_custkey AS o_custkey, c_mktsegment FROM customer) c USING (o_custkey)
    LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS top FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) x USING (o_custkey)""",
)
def star_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    fact = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.avg(F.ln("o_totalprice")).alias("spent"))
    dims = {
        "customer": table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"),
        "top": orders.where(F.col("o_orderstatus") == "F").groupBy("o_custkey").agg(F.max("o_totalprice").alias("top")),
    }
    return rounded(star.star_join(fact, dims, "o_custkey"), ["spent"])


@query(
    "star_join_nation_region",
    "J5",
    """SELECT r_name, n_name, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS finished
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
)
def star_join_nation_region(spark, sf_dir):
    places = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    counted = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("finished")
    )
    by_customer = counted.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return (
        by_customer.join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("r_name", "n_name")
        .agg(F.sum("n").alias("n"), F.sum("finished").alias("finished"))
    )


TEST_YEARS = "(year BETWEEN -500000 AND -300000 OR year > 2025)"


@query(
    "anti_split",
    "J6",
    f"""WITH o AS (SELECT o_orderkey, {sql_pseudo_year('o_orderdate')} AS year FROM orders)
    SELECT o_orderkey, year FROM o WHERE NOT EXISTS (SELECT 1 FROM o t WHERE t.o_orderkey = o.o_orderkey AND {TEST_YEARS.replace('year', 't.year')})""",
)
def anti_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", pseudo_year("o_orderdate").alias("year"))
    test = orders.where(F.col("year").between(-500000, -300000) | (F.col("year") > 2025))
    return star.anti_split(orders, test, ["o_orderkey"])


@query(
    "grid_cell_lookup",
    "J7 A10",
    f"""WITH g AS (SELECT idx // 64 AS month, (idx % 64) // 8 - 3 AS lat, idx % 8 - 3 AS lon, value FROM ({GRID_SQL})),
    c AS (SELECT lat, lon, avg(value) AS climate FROM g GROUP BY 1, 2),
    p AS (SELECT l_orderkey, l_linenumber, round_even(l_quantity / 5 - 4, 0)::BIGINT AS lat, round_even(l_tax * 100 - 4, 0)::BIGINT AS lon FROM lineitem)
    SELECT l_orderkey, l_linenumber, p.lat, p.lon, {r('climate', 5)} AS climate FROM p LEFT JOIN c USING (lat, lon)""",
)
def grid_cell_lookup(spark, sf_dir):
    grid = grid_to_long(flat_grid(spark, sf_dir), "idx", GRID_DIMS)
    climate = axis_mean(grid, ["lat", "lon"], "value", "climate")
    probes = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.bround(F.col("l_quantity") / 5 - 4).cast("bigint").alias("lat"),
        F.bround(F.col("l_tax") * 100 - 4).cast("bigint").alias("lon"),
    )
    return rounded(lookup.grid_lookup(probes, climate, ["lat", "lon"]), ["climate"], 5)


HOUR = "floor({} / 3600000000)::BIGINT".format(sql_micros())


@query(
    "forward_lookup",
    "J8",
    f"""WITH e AS (SELECT event_type, {HOUR} AS hour, value FROM events),
    ref AS (SELECT event_type, hour, max(value) AS v FROM e WHERE value < 100 GROUP BY 1, 2),
    p AS (SELECT DISTINCT event_type, hour FROM e)
    SELECT p.event_type, p.hour, arg_min(ref.v, ref.hour) AS v FROM p
    LEFT JOIN ref ON p.event_type = ref.event_type AND ref.hour >= p.hour AND (ref.hour - p.hour) % 10 = 0 GROUP BY 1, 2""",
)
def forward_lookup(spark, sf_dir):
    hour = F.floor(micros() / 3_600_000_000).cast("bigint").alias("hour")
    events = table(spark, sf_dir, "events").select("event_type", hour, "value")
    ref = events.where(F.col("value") < 100).groupBy("event_type", "hour").agg(F.max("value").alias("v"))
    probes = events.select("event_type", "hour").distinct()
    return lookup.forward_lookup(probes, ref, ["event_type"], "hour", "hour", "v", step=10)


@query(
    "forward_lookup_hot_key",
    "J8",
    f"""WITH e AS (SELECT event_type, {HOUR} AS hour, value FROM events),
    ref AS (SELECT event_type, hour, max(value) AS v FROM e WHERE value < 100 GROUP BY 1, 2),
    p AS (SELECT event_type, CASE WHEN value > 10 THEN 3 ELSE hour END AS hour, count(*) AS n FROM e GROUP BY 1, 2)
    SELECT p.event_type, p.hour, arg_min(ref.v, ref.hour) AS v, any_value(n)::BIGINT AS n FROM p
    LEFT JOIN ref ON p.event_type = ref.event_type AND ref.hour >= p.hour AND (ref.hour - p.hour) % 10 = 0 GROUP BY 1, 2""",
)
def forward_lookup_hot_key(spark, sf_dir):
    """Most events of a type ask for one hour, as records older than a grid all ask for its first year."""
    hour = F.floor(micros() / 3_600_000_000).cast("bigint").alias("hour")
    events = table(spark, sf_dir, "events").select("event_type", hour, "value")
    ref = events.where(F.col("value") < 100).groupBy("event_type", "hour").agg(F.max("value").alias("v"))
    probes = events.withColumn("hour", F.when(F.col("value") > 10, F.lit(3)).otherwise(F.col("hour")).cast("bigint")).drop("value")
    found = lookup.forward_lookup(probes, ref, ["event_type"], "hour", "hour", "v", step=10)
    return found.groupBy("event_type", "hour", "v").agg(F.count(F.lit(1)).alias("n"))


@query(
    "nearest_lookup",
    "J9",
    """WITH ref AS (SELECT DISTINCT p_retailprice AS v FROM part),
    p AS (SELECT o_orderkey, o_totalprice / 250 AS x FROM orders),
    u AS (SELECT x, v FROM (SELECT x, (SELECT max(v) FROM ref WHERE v <= x) AS v FROM p)
          UNION ALL SELECT x, v FROM (SELECT x, (SELECT min(v) FROM ref WHERE v >= x) AS v FROM p)),
    b AS (SELECT x, arg_min(v, struct_pack(d := abs(v - x), v := v)) AS nearest FROM u WHERE v IS NOT NULL GROUP BY 1)
    SELECT o_orderkey, p.x, b.nearest FROM p JOIN b USING (x)""",
)
def nearest_lookup(spark, sf_dir):
    probes = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 250).alias("x"))
    ref = table(spark, sf_dir, "part").select(F.col("p_retailprice").alias("v")).distinct()
    return lookup.nearest_lookup(probes, ref, "x", "v")


@query(
    "interval_label",
    "J10",
    f"""WITH s AS (SELECT c_mktsegment AS label, min(c_acctbal) AS lo, min(c_acctbal) + 4000 AS hi FROM customer GROUP BY 1)
    SELECT s_suppkey, s_acctbal, label FROM supplier LEFT JOIN s ON s_acctbal BETWEEN lo AND hi""",
)
def interval_label(spark, sf_dir):
    spans = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("label")).agg(F.min("c_acctbal").alias("lo"))
    spans = spans.withColumn("hi", F.col("lo") + 4000)
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return lookup.label_intervals(suppliers, spans, "s_acctbal")


@query(
    "interval_label_sessions",
    "J10",
    f"""WITH s AS (SELECT user_id AS label, min({sql_micros()}) AS lo, min({sql_micros()}) + 1800000000 AS hi FROM events GROUP BY 1),
    e AS (SELECT event_id, {sql_micros()} AS moment FROM events)
    SELECT event_id, moment, label FROM e LEFT JOIN s ON moment BETWEEN lo AND hi""",
)
def interval_label_sessions(spark, sf_dir):
    """Which users were in their first half hour when an event happened: many overlapping spans."""
    events = table(spark, sf_dir, "events").select("event_id", micros().alias("moment"), "user_id")
    spans = events.groupBy(F.col("user_id").alias("label")).agg(F.min("moment").alias("lo"))
    spans = spans.withColumn("hi", F.col("lo") + 1_800_000_000)
    return lookup.label_intervals(events.select("event_id", "moment"), spans, "moment")


@query(
    "interval_label_skewed",
    "J10",
    """WITH s AS (SELECT l_linenumber AS label, l_orderkey * 100 AS lo, l_orderkey * 100 + CASE WHEN l_orderkey % 500 = 0 THEN 400000 ELSE 9 END AS hi FROM lineitem WHERE l_linenumber = 1 OR l_orderkey % 500 = 0)
    SELECT o_orderkey, count(label) AS n, min(label) AS low, max(lo) AS latest FROM orders LEFT JOIN s ON o_orderkey * 100 + 5 BETWEEN lo AND hi GROUP BY 1""",
)
def interval_label_skewed(spark, sf_dir):
    """Many short spans and some that are forty thousand times as long, and cover thousands of keys each."""
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber = 1 or l_orderkey % 500 = 0")
    lo = F.col("l_orderkey") * 100
    hi = lo + F.when(F.col("l_orderkey") % 500 == 0, 400_000).otherwise(9)
    spans = lines.select(lo.alias("lo"), hi.alias("hi"), F.struct(F.col("l_linenumber").alias("line"), lo.alias("start")).alias("label"))
    keys = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 100 + 5).alias("at"))
    found = lookup.label_intervals(keys, spans, "at")
    return found.groupBy("o_orderkey").agg(F.count("label").alias("n"), F.min("label.line").alias("low"), F.max("label.start").alias("latest"))


@query(
    "long_spine",
    "C2",
    """WITH s AS (SELECT c_nationkey AS nation, min(c_custkey) * 37 AS lo, max(c_custkey) * 37 AS hi FROM customer GROUP BY 1),
    k AS (SELECT nation, unnest(range(lo, hi + 1, 5)) AS t FROM s) SELECT nation, count(*) AS n, min(t) AS lo, max(t) AS hi, sum(t)::DOUBLE AS total FROM k GROUP BY 1""",
)
def long_spine(spark, sf_dir):
    """Axes of many keys, made in runs on all tasks."""
    ends = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), (F.col("c_custkey") * 37).alias("t"))
    keys = regular_spine(ends, "t", 5, ["nation"])
    return keys.groupBy("nation").agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"), F.sum("t").cast("double").alias("total")
    )


@query(
    "band_label",
    "J10",
    f"""SELECT o_orderkey, CASE WHEN y BETWEEN -500000 AND -300000 THEN 'Test' WHEN y <= 2025 THEN 'Train' ELSE 'Forecast' END AS band
    FROM (SELECT o_orderkey, {sql_pseudo_year('o_orderdate')} AS y FROM orders)""",
)
def band_label(spark, sf_dir):
    bands = [(-500000, -300000, "Test"), (None, 2025, "Train")]
    band = lookup.label_bands(pseudo_year("o_orderdate"), bands, default="Forecast").alias("band")
    return table(spark, sf_dir, "orders").select("o_orderkey", band)
