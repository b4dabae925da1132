"""Reading and writing."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.common import Registry, r, table
from epochline.functions.bins import year_of_mega_offset
from epochline.operators.grid import grid_to_long
from epochline.session import scratch_path
from epochline.sources import files, metrics, samples

QUERIES = Registry()
query = QUERIES.query

PART_SCHEMA = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


@query("csv_scan", "S1 S5", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def csv_scan(spark, sf_dir):
    path = scratch_path(spark, "csv")
    files.write_csv(table(spark, sf_dir, "part"), path)
    return files.read_csv(spark, path, PART_SCHEMA)


@query("csv_multi_scan", "S2", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def csv_multi_scan(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    paths = []
    for status in ("F", "O", "P"):
        paths.append(scratch_path(spark, f"csv-{status}"))
        files.write_csv(orders.where(F.col("o_orderstatus") == status), paths[-1])
    return files.read_csv(spark, paths, "o_orderkey bigint, o_orderstatus string, o_totalprice double")


@query("parquet_sink_scan", "S3 S4", "SELECT l_orderkey, l_returnflag, l_quantity FROM lineitem WHERE l_quantity >= 25")
def parquet_sink_scan(spark, sf_dir):
    path = scratch_path(spark, "parquet")
    lineitem = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag")
    files.write_parquet(lineitem, path, partition_by=["l_returnflag"])
    return files.read_parquet(spark, path).where(F.col("l_quantity") >= 25)


@query(
    "prediction_sink",
    "S5 P14",
    f"""SELECT o_orderkey AS year_bin, {r('ln(o_totalprice)', 5)} AS anomaly, {r('sqrt(o_totalprice)', 5)} AS pred_anomaly
    FROM orders""",
)
def prediction_sink(spark, sf_dir):
    path = scratch_path(spark, "predictions")
    price = F.col("o_totalprice")
    predictions = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("year_bin"), F.ln(price).alias("anomaly"), F.sqrt(price).alias("pred_anomaly"), "o_custkey"
    )
    files.write_predictions(predictions, path)
    return files.read_csv(spark, path, "year_bin bigint, anomaly double, pred_anomaly double")


@query("table_replace", "S6 S7 S8", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def table_replace(spark, sf_dir):
    name = f"supplier_{uuid.uuid4().hex}"
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    in_debt = F.col("s_acctbal") < 0
    files.replace_table(supplier, name, scratch_path(spark, "table"))
    files.replace_table(supplier.where(in_debt), name, scratch_path(spark, "table"))
    files.append_rows(supplier.where(~in_debt), name)
    return files.read_table(spark, name)


@query(
    "nested_records",
    "S9",
    f"""SELECT sample_id, (i - 1)::INT AS pos, (10.0 * (i - 1))::DOUBLE AS age_bp, {r('embedding[i]::DOUBLE')} AS value
    FROM (SELECT vec_id AS sample_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
    WHERE embedding[i] IS NOT NULL""",
)
def nested_records(spark, sf_dir):
    path = scratch_path(spark, "records")
    records = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"),
        F.transform("embedding", lambda _, i: (i * 10).cast("double")).alias("age"),
        F.transform("embedding", lambda x: x.cast("double")).alias("paleoData_values"),
    )
    records.write.json(path)
    schema = "sample_id bigint, age array<double>, paleoData_values array<double>"
    read = samples.read_samples(spark, path, schema=spark.createDataFrame([], schema).schema)
    rows = samples.explode_pairs(read, "age", "paleoData_values", "age_bp", "value")
    return rows.select("sample_id", "pos", "age_bp", F.round("value", 6).alias("value"))


GRID_SQL = """SELECT (vec_id * 64 + i)::BIGINT AS idx, embedding[i + 1]::DOUBLE AS value
FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS i FROM embeddings)"""


def flat_grid(spark, sf_dir):
    """Embedding entries under one flat index: vec_id is the slow axis, 8 x 8 cells the fast ones."""
    cells = F.posexplode("embedding").alias("i", "value")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", cells)
    return rows.select((F.col("vec_id") * 64 + F.col("i")).cast("bigint").alias("idx"), F.col("value").cast("double").alias("value"))


GRID_DIMS = [("month", None, 0), ("lat", 8, -3), ("lon", 8, -3)]


@query(
    "grid_to_long",
    "S10",
    f"""SELECT idx, {r('value')} AS value, idx // 64 AS month, (idx % 64) // 8 - 3 AS lat, idx % 8 - 3 AS lon FROM ({GRID_SQL})""",
)
def long_grid(spark, sf_dir):
    return grid_to_long(flat_grid(spark, sf_dir), "idx", GRID_DIMS).withColumn("value", F.round("value", 6))


@query("materialize_once", "S11", "SELECT l_returnflag, sum(l_quantity) AS qty FROM lineitem GROUP BY 1")
def materialize_once(spark, sf_dir):
    path = scratch_path(spark, "cache")

    def build():
        return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("qty"))

    def forbidden():
        raise AssertionError("the table is there already")

    files.materialize(spark, path, build)
    return files.materialize(spark, path, forbidden)


@query(
    "metric_upsert",
    "S12",
    f"""SELECT o_orderpriority AS model, {r("CASE WHEN o_orderpriority < '3' THEN max(o_totalprice) ELSE min(o_totalprice) END")} AS mse
    FROM orders GROUP BY 1""",
)
def metric_upsert(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    by_model = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("model"))
    metrics.upsert_metric(spark, path, by_model.agg(F.min("o_totalprice").alias("mse")))
    metrics.upsert_metric(spark, path, by_model.agg(F.max("o_totalprice").alias("mse")).where(F.col("model") < "3"))
    return metrics.read_metrics(spark, path).withColumn("mse", F.round("mse", 6))


@query("json_scan", "S13", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def json_scan(spark, sf_dir):
    path = scratch_path(spark, "json")
    table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").write.json(path)
    return files.read_json_rows(spark, path, "c_custkey bigint, c_mktsegment string, c_acctbal double")


@query(
    "field_series",
    "S14",
    """SELECT l_orderkey, l_linenumber, round_even((-l_extendedprice / 50) * 1000 + 3000, 0)::BIGINT AS year, l_quantity AS "VADM"
    FROM lineitem""",
)
def field_series(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    year = year_of_mega_offset(-F.col("l_extendedprice") / 50).alias("year")
    return lineitem.select("l_orderkey", "l_linenumber", year, F.col("l_quantity").alias("VADM"))
