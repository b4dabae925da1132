"""Sorting, top-k, ranking, set operations, splits of the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import Registry, days, pseudo_year, r, sql_days, sql_pseudo_year, sql_tiered, table
from epochline.functions.bins import tiered_bin
from epochline.operators import series, star
from epochline.plans.star_build import sediment_series
from epochline.sources.metrics import scoreboard

QUERIES = Registry()
query = QUERIES.query


@query("sorted_series", "O1", "SELECT o_orderdate, max(o_totalprice) AS top FROM orders GROUP BY 1 ORDER BY 1")
def sorted_series(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderdate").agg(F.max("o_totalprice").alias("top")).orderBy("o_orderdate")


@query("best_k", "O2", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def best_k(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return part.orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(20)


@query(
    "rank_models",
    "O3 M13 R7",
    f"""SELECT upper(m[1]) || lower(m[2:]) || ' Model' AS model, {r('mse', 4)} AS mse, rank() OVER (ORDER BY mse) AS rank FROM
      (SELECT c_mktsegment AS m, avg(c_acctbal) AS mse FROM customer GROUP BY 1)""",
)
def rank_models(spark, sf_dir):
    metrics = table(spark, sf_dir, "customer").groupBy(F.concat_ws("_", "c_mktsegment", F.lit("model")).alias("model")).agg(
        F.avg("c_acctbal").alias("mse")
    )
    return scoreboard(metrics).withColumn("mse", F.round("mse", 4))


@query(
    "union_all",
    "U1",
    """SELECT c_nationkey AS nationkey, c_acctbal AS acctbal FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier""",
)
def union_all(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal"))
    return customers.unionByName(suppliers)


@query(
    "set_difference",
    "U2",
    """SELECT DISTINCT c_custkey AS custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def set_difference(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"))
    urgent = table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    return star.anti_split(customers.distinct(), urgent.select(F.col("o_custkey").alias("custkey")), ["custkey"])


@query(
    "spine_union",
    "U3 C2",
    f"""SELECT {sql_tiered(sql_pseudo_year('o_orderdate'))} AS year_bin FROM orders
    UNION SELECT {sql_tiered(sql_pseudo_year('l_shipdate'))} FROM lineitem""",
)
def spine_union(spark, sf_dir):
    bins = [
        table(spark, sf_dir, name).select(tiered_bin(pseudo_year(date)).alias("year_bin"))
        for name, date in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"))
    ]
    return series.make_spine(*bins, key="year_bin")


@query(
    "extend_dimension",
    "C7 U4",
    f"""SELECT DISTINCT {sql_days('o_orderdate')}::BIGINT AS time_id, {sql_days('o_orderdate')}::BIGINT AS year_bin FROM orders
    UNION SELECT {sql_days('l_shipdate')}::BIGINT, {sql_days('l_shipdate')}::BIGINT FROM lineitem""",
)
def extend_dimension(spark, sf_dir):
    day = days("o_orderdate").cast("bigint")
    dim = table(spark, sf_dir, "orders").select(day.alias("time_id"), day.alias("year_bin")).distinct()
    later = table(spark, sf_dir, "lineitem").select(days("l_shipdate").cast("bigint").alias("time_id"))
    return star.extend_dimension(dim, later, "time_id", ["year_bin"])


@query(
    "star_split",
    "C6 A8",
    """SELECT 'fact' AS name, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem)
    UNION ALL SELECT 'dim_part', count(*) FROM (SELECT DISTINCT l_partkey FROM lineitem)
    UNION ALL SELECT 'dim_flag', count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)""",
)
def star_split(spark, sf_dir):
    tables = star.star_split(
        table(spark, sf_dir, "lineitem"),
        {
            "fact": ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"],
            "dim_part": ["l_partkey"],
            "dim_flag": ["l_returnflag", "l_linestatus"],
        },
    )
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(
    "multi_source_merge",
    "C4 P12 P18 U1",
    f"""SELECT {r('1950 - 1000 * age_ka', 4)} AS year, be_ppm FROM (
      SELECT o_totalprice / 700 AS age_ka, CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey::DOUBLE END AS be_ppm FROM orders
      UNION ALL SELECT c_acctbal / 20, c_custkey FROM customer)
    WHERE be_ppm IS NOT NULL AND 1950 - 1000 * age_ka >= -400000""",
)
def multi_source_merge(spark, sf_dir):
    sentinel = F.when(F.col("o_orderpriority") == "5-LOW", F.lit(999999)).otherwise(F.col("o_custkey")).alias("be_ppm")
    orders = table(spark, sf_dir, "orders").select((F.col("o_totalprice") / 700).alias("age_ka"), sentinel)
    customers = table(spark, sf_dir, "customer").select((F.col("c_acctbal") / 20).alias("age_ka"), F.col("c_custkey").alias("be_ppm"))
    merged = sediment_series([orders, customers], oldest=-400000)
    return merged.withColumn("year", F.round("year", 4))


@query(
    "range_split",
    "C14",
    f"""SELECT o_orderkey, year, CASE WHEN year > 2025 THEN 'forecast' WHEN year BETWEEN -500000 AND -300000 THEN 'test' ELSE 'train' END AS split
    FROM (SELECT o_orderkey, {sql_pseudo_year('o_orderdate')} AS year FROM orders) WHERE year <= 200000""",
)
def range_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", pseudo_year("o_orderdate").alias("year"))
    return star.range_split(orders, "year", (-500000, -300000), 2025, 200000)
