"""Projection, filters and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import Registry, daily, pseudo_year, r, rounded, sql_daily, sql_pseudo_year, sql_tiered, table
from epochline.functions import columns as C
from epochline.functions.bins import floor_bin, tiered_bin, year_before
from epochline.functions.derive import radiative_forcing, solar_modulation
from epochline.operators.clean import sample_rule, split_valid
from epochline.operators.grid import decimate
from epochline.operators.stats import mean_all
from epochline.plans.star_build import SEASON_MONTHS

QUERIES = Registry()
query = QUERIES.query


@query("select_rename_drop", "P1 P2 P3", "SELECT s_name AS supplier, s_suppkey, s_acctbal FROM supplier")
def select_rename_drop(spark, sf_dir):
    return table(spark, sf_dir, "supplier").withColumnRenamed("s_name", "supplier").drop("s_nationkey").select(
        "supplier", "s_suppkey", "s_acctbal"
    )


@query("drop_matching", "P4", "SELECT l_orderkey, l_quantity, l_discount, l_tax FROM lineitem")
def drop_matching(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    return C.drop_matching(lineitem, contains=["price"], prefixes=["l_return", "l_line", "l_ship"], suffixes=["key"], keep=["l_orderkey"])


@query("feature_mask", "P5", "SELECT l_orderkey, l_quantity, l_tax FROM lineitem")
def feature_mask(spark, sf_dir):
    features = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return C.select_mask(table(spark, sf_dir, "lineitem"), features, [1, 0, 0, 1], keep=["l_orderkey"])


@query(
    "across_columns",
    "P6",
    f"SELECT o_orderkey, {r('sqrt(o_custkey)')} AS o_custkey, {r('sqrt(o_totalprice)')} AS o_totalprice FROM orders",
)
def across_columns(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return C.across(orders, lambda c: F.round(F.sqrt(c), 6), exclude=["o_orderkey"])


@query("cast_like", "P7", "SELECT l_orderkey, l_quantity::BIGINT AS l_quantity, l_linenumber::DOUBLE AS l_linenumber FROM lineitem")
def cast_like(spark, sf_dir):
    shape = spark.createDataFrame([], "l_quantity bigint, l_linenumber double")
    return C.cast_like(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_linenumber"), shape)


@query(
    "typed_null_rows",
    "P8",
    """SELECT o_orderkey AS year_bin, o_totalprice AS co2_ppm, NULL::BIGINT AS source FROM orders
    UNION ALL SELECT 2024, 424.61::DOUBLE, NULL::BIGINT""",
)
def typed_null_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("year_bin"), F.col("o_totalprice").alias("co2_ppm"))
    extra = spark.createDataFrame([(2024, 424.61)], "year_bin bigint, co2_ppm double")
    return orders.unionByName(extra).withColumn("source", F.lit(None).cast("bigint"))


@query(
    "conditional_filter",
    "P9 P10",
    """SELECT l_orderkey, l_linenumber,
      CASE WHEN l_quantity > 40 THEN NULL WHEN l_quantity < 10 THEN 'small' ELSE 'medium' END AS size
    FROM lineitem WHERE (l_discount >= 0.02 AND l_discount <= 0.08) OR l_tax > 0.06""",
)
def conditional_filter(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem").where(F.col("l_discount").between(0.02, 0.08) | (F.col("l_tax") > 0.06))
    size = F.when(F.col("l_quantity") > 40, F.lit(None)).when(F.col("l_quantity") < 10, "small").otherwise("medium")
    return lineitem.select("l_orderkey", "l_linenumber", size.alias("size"))


@query(
    "missing_rules",
    "P11 P12 P13",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN l_quantity END AS noisy,
      CASE WHEN l_tax <> 0.05 THEN l_tax END AS marked, coalesce(CASE WHEN l_tax <> 0.05 THEN l_tax END, 0) AS filled
    FROM lineitem WHERE NOT (l_discount = 0 AND l_tax = 0.05)""",
)
def missing_rules(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity")).alias("noisy"),
        F.when(F.col("l_tax") == 0.05, F.lit(999999.0)).otherwise(F.col("l_tax")).alias("marked"),
    )
    clean = C.missing_to_null(lineitem, ["noisy", "marked"], sentinel=999999.0).na.drop("all", subset=["noisy", "marked"])
    return clean.withColumn("filled", F.coalesce("marked", F.lit(0.0)))


@query(
    "round_all",
    "P14",
    f"SELECT o_orderkey, {r('ln(o_totalprice)', 3)} AS a, {r('sqrt(o_totalprice)', 3)} AS b, o_totalprice FROM orders",
)
def round_all(spark, sf_dir):
    price = F.col("o_totalprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.ln(price).alias("a"), F.sqrt(price).alias("b"), "o_totalprice")
    return C.round_all(orders, 3, exclude=["o_totalprice"])


@query(
    "arithmetic",
    "P15",
    f"""SELECT o_orderkey, floor(y / 2000)::BIGINT AS whole, (((y % 2000) + 2000) % 2000)::BIGINT AS rest,
      {r('pow(o_totalprice / 1000, 2)')} AS squared, abs(y)::BIGINT AS magnitude, {r('5.35 * ln(o_totalprice / 228)')} AS logged
    FROM (SELECT *, {sql_pseudo_year('o_orderdate')} AS y FROM orders)""",
)
def arithmetic(spark, sf_dir):
    y, price = F.col("y"), F.col("o_totalprice")
    return table(spark, sf_dir, "orders").withColumn("y", pseudo_year("o_orderdate")).select(
        "o_orderkey",
        F.floor(y / 2000).cast("bigint").alias("whole"),
        F.pmod(y, F.lit(2000)).cast("bigint").alias("rest"),
        F.round(F.pow(price / 1000, 2), 6).alias("squared"),
        F.abs(y).alias("magnitude"),
        F.round(5.35 * F.ln(price / 228), 6).alias("logged"),
    )


@query(
    "tiered_bin",
    "P16 A14",
    f"SELECT {sql_tiered(sql_pseudo_year('o_orderdate'))} AS year_bin, count(*) AS n FROM orders GROUP BY 1",
)
def tiered(spark, sf_dir):
    year_bin = tiered_bin(pseudo_year("o_orderdate")).alias("year_bin")
    return table(spark, sf_dir, "orders").groupBy(year_bin).agg(F.count(F.lit(1)).alias("n"))


@query(
    "fixed_bin_mean_all",
    "P17 A3",
    f"""SELECT (floor(l_extendedprice / 2000) * 2000)::BIGINT AS price_bin, {r('avg(l_quantity)')} AS l_quantity,
      {r('avg(l_discount)')} AS l_discount, {r('avg(l_tax)')} AS l_tax FROM lineitem GROUP BY 1""",
)
def fixed_bin_mean_all(spark, sf_dir):
    binned = table(spark, sf_dir, "lineitem").select(
        floor_bin(F.col("l_extendedprice"), 2000).alias("price_bin"), "l_quantity", "l_discount", "l_tax"
    )
    return rounded(mean_all(binned, ["price_bin"]), ["l_quantity", "l_discount", "l_tax"])


@query(
    "age_to_year",
    "P18",
    f"SELECT o_orderkey, {r('1950 - o_totalprice')} AS year, {r('1950 - 1000 * (o_totalprice / 700)')} AS year_ka FROM orders",
)
def age_to_year(spark, sf_dir):
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.round(year_before(price), 6).alias("year"),
        F.round(year_before(price / 700, unit=1000), 6).alias("year_ka"),
    )


@query(
    "derived_forcing",
    "P19",
    f"""SELECT l_orderkey, l_linenumber, {r('5.35 * ln((CASE WHEN l_tax > 0 THEN l_extendedprice END) / 228)')} AS forcing
    FROM lineitem""",
)
def derived_forcing(spark, sf_dir):
    co2 = F.when(F.col("l_tax") > 0, F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(radiative_forcing(co2), 6).alias("forcing"))


MODULATION_RATIO = "((2.347 + m) / (1.077 + 2.274 * m))"


@query(
    "modulation",
    "P20",
    f"""SELECT l_orderkey, l_linenumber, {r(f'1 / (0.7476 + 0.2458 * {MODULATION_RATIO} / q) - 0.7476')} AS direct,
      {r(f'({MODULATION_RATIO} / q - 0.7476) / 0.2458')} AS inverted
    FROM (SELECT *, CASE WHEN l_discount > 0 THEN l_quantity END AS q, CASE WHEN l_tax > 0 THEN l_tax * 100 END AS m FROM lineitem)""",
)
def modulation(spark, sf_dir):
    q = F.when(F.col("l_discount") > 0, F.col("l_quantity"))
    m = F.when(F.col("l_tax") > 0, F.col("l_tax") * 100)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.round(solar_modulation(q, m), 6).alias("direct"),
        F.round(solar_modulation(q, m, form="inverted"), 6).alias("inverted"),
    )


@query(
    "include_rows",
    "P21",
    """SELECT doc_id, (lang = 'en' AND source <> 'src3' AND NOT contains(text, 'DELETE') AND NOT contains(text, 'lorem')
      AND n_chars >= 500) AS good FROM documents""",
)
def include_rows(spark, sf_dir):
    """Documents in the role of records: the language is the unit, the length the first age."""
    length = F.col("n_chars")
    records = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(F.col("lang") == "en", "degC").otherwise(F.col("lang")).alias("paleoData_units"),
        F.when(F.col("source") == "src3", "FALSE").alias("paleoData_useInGlobalTemperatureAnalysis"),
        F.replace("text", F.lit("lorem"), F.lit("DELETE")).alias("paleoData_QCnotes"),
        F.array(F.when(length < 500, F.lit(float("nan"))).otherwise(length.cast("double"))).alias("age"),
        F.array(length.cast("double")).alias("paleoData_values"),
    )
    good, rest = split_valid(records, sample_rule())
    return good.select("doc_id", F.lit(True).alias("good")).unionByName(rest.select("doc_id", F.lit(False).alias("good")))


SEASON_CASE = "CASE {} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SEASON_MONTHS.items()) + " END"


@query(
    "season_lookup",
    "P22",
    f"""SELECT event_id, coalesce({SEASON_CASE.format('lower(a)')}, {SEASON_CASE.format('b')}) AS month_idx FROM (
      SELECT event_id,
        CASE event_type WHEN 'click' THEN 'Summer' WHEN 'error' THEN 'Coldest Month' WHEN 'view' THEN 'annual' END AS a,
        CASE WHEN value > 300 THEN 'winter' WHEN value > 150 THEN 'Fall' ELSE 'warmest' END AS b FROM events)""",
)
def season_lookup(spark, sf_dir):
    kind, value = F.col("event_type"), F.col("value")
    events = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == "click", "Summer").when(kind == "error", "Coldest Month").when(kind == "view", "annual").alias("a"),
        F.when(value > 300, "winter").when(value > 150, "Fall").otherwise("warmest").alias("b"),
    )
    found = C.lookup_first(events, [(F.col("a"), True), (F.col("b"), False)], SEASON_MONTHS, "month_idx")
    return found.select("event_id", "month_idx")


@query(
    "coordinate_rounding",
    "P23",
    "SELECT l_orderkey, l_linenumber, round_even(l_extendedprice / 1000 - 45, 0)::BIGINT AS lat, round_even(l_quantity / 4, 0)::BIGINT AS lon FROM lineitem",
)
def coordinate_rounding(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.bround(F.col("l_extendedprice") / 1000 - 45).cast("bigint").alias("lat"),
        F.bround(F.col("l_quantity") / 4).cast("bigint").alias("lon"),
    )


@query(
    "grid_decimate",
    "P24",
    """SELECT lat, lon, count(*) AS n, sum(v) AS v FROM (
      SELECT l_linenumber::BIGINT - 3 AS lat, l_quantity::BIGINT - 25 AS lon, l_quantity AS v FROM lineitem)
    WHERE lat % 2 = 0 AND lon % 2 = 0 GROUP BY 1, 2""",
)
def grid_decimate(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select(
        (F.col("l_linenumber").cast("bigint") - 3).alias("lat"),
        (F.col("l_quantity").cast("bigint") - 25).alias("lon"),
        F.col("l_quantity").alias("v"),
    )
    return decimate(cells, ["lat", "lon"]).groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))


@query(
    "squared_features",
    "P25",
    f"""SELECT series, day, {r('v', 5)} AS v, n, {r('v * v', 4)} AS v_squared, n * n AS n_squared FROM ({sql_daily()})""",
)
def squared_features(spark, sf_dir):
    squared = C.add_squares(daily(spark, sf_dir), ["v", "n"])
    return rounded(rounded(squared, ["v"], 5), ["v_squared"], 4)


@query(
    "null_after",
    "P26",
    f"""SELECT o_orderkey, y AS year, CASE WHEN y <= 2025 THEN o_totalprice END AS anomaly, o_custkey
    FROM (SELECT *, {sql_pseudo_year('o_orderdate')} AS y FROM orders)""",
)
def null_after(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", pseudo_year("o_orderdate").alias("year"), F.col("o_totalprice").alias("anomaly"), "o_custkey"
    )
    return C.null_after(orders, "year", 2025, ["anomaly", "be_ppm"])


@query(
    "string_labels",
    "P27",
    """SELECT p_partkey, lower(p_brand) AS lowered, contains(p_name, 'ring') AS is_ring,
      upper(p_type[1]) || lower(p_type[2:]) || ' Item' AS title, p_brand || '_' || p_type AS pasted,
      printf('%s: %+.2f', p_brand, p_retailprice) AS label
    FROM part""",
)
def string_labels(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.lower("p_brand").alias("lowered"),
        F.contains("p_name", F.lit("ring")).alias("is_ring"),
        C.title_label(F.concat_ws("_", "p_type", F.lit("item"))).alias("title"),
        F.concat_ws("_", "p_brand", "p_type").alias("pasted"),
        F.format_string("%s: %+.2f", "p_brand", "p_retailprice").alias("label"),
    )


@query(
    "config_key",
    "P28",
    """SELECT key, count(*) AS n FROM (SELECT 'p_size_' || p_size || '_p_type_' || p_type AS key FROM part) GROUP BY 1""",
)
def config_key(spark, sf_dir):
    key = C.config_key(["p_size", "p_type"]).alias("key")
    return table(spark, sf_dir, "part").groupBy(key).agg(F.count(F.lit(1)).alias("n"))
