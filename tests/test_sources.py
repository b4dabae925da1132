import json

import pytest
from epochline.session import drop_scratch, settle, shared_dir
from pyspark.sql import functions as F

from concurrent.futures import ThreadPoolExecutor

from epochline.sources import files, metrics, samples


def test_csv_round_trip_of_several_files(spark, tmp_path):
    one = tmp_path / "one.csv"
    one.write_text("﻿age,co2\n-51.03,368.02\n10,300\n", encoding="utf-8")
    two = tmp_path / "two.csv"
    two.write_text("age,co2\n20,\n", encoding="utf-8")
    df = files.read_csv(spark, [str(one), str(two)], "age double, co2 double")
    assert sorted(map(tuple, df.collect()), key=lambda r: r[0]) == [(-51.03, 368.02), (10.0, 300.0), (20.0, None)]


def test_materialize_runs_once(spark, tmp_path):
    path, calls = str(tmp_path / "cache"), []

    def build():
        calls.append(1)
        return spark.range(3)

    for recompute in (False, False, True):
        assert files.materialize(spark, path, build, recompute).count() == 3
    assert len(calls) == 2


def test_tables(spark, tmp_path):
    files.replace_table(spark.range(3), "t_ids", str(tmp_path / "a"))
    files.replace_table(spark.range(5), "t_ids", str(tmp_path / "b"))
    files.append_rows(spark.range(2), "t_ids")
    assert files.table_exists(spark, "t_ids") and files.read_table(spark, "t_ids").count() == 7
    spark.sql("DROP TABLE t_ids")
    files.create_table(spark, "t_made", {"a": "bigint", "b c": "double"})
    assert files.read_table(spark, "t_made").columns == ["a", "b c"]
    spark.sql("DROP TABLE t_made")


def test_a_failed_table_write_is_raised(spark):
    broken = spark.range(1).select(F.raise_error(F.lit("broken")).alias("x"))
    with pytest.raises(Exception, match="broken"):
        files.save_star({"t_broken": broken})


def test_metric_upsert(spark, tmp_path):
    path = str(tmp_path / "scores")
    assert metrics.read_metrics(spark, path).count() == 0
    metrics.upsert_metric(spark, path, spark.createDataFrame([("linear_model", 3.6), ("tree", 2.0)], "model string, mse double"))
    metrics.upsert_metric(spark, path, spark.createDataFrame([("tree", 1.5)], "model string, mse double"))
    assert {r.model: r.mse for r in metrics.read_metrics(spark, path).collect()} == {"linear_model": 3.6, "tree": 1.5}
    board = metrics.scoreboard(metrics.read_metrics(spark, path)).orderBy("rank").collect()
    assert [(r.model, r["rank"]) for r in board] == [("Tree", 1), ("Linear Model", 2)]


def test_metrics_of_writers_at_once(spark, tmp_path):
    path = str(tmp_path / "scores")

    def write(k):
        for n in range(3):
            metrics.upsert_metric(spark, path, spark.createDataFrame([(f"m{k}", float(n)), ("all", float(k))], "model string, mse double"))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(4)))
    board = {r.model: r.mse for r in metrics.read_metrics(spark, path).collect()}
    assert {m: v for m, v in board.items() if m != "all"} == {f"m{k}": 2.0 for k in range(4)} and board["all"] in range(4)
    assert len([v for v, _, whole in metrics._log(spark, path) if not whole]) == 12


def test_old_metrics_are_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(metrics, "FOLD", 3)
    path = str(tmp_path / "scores")
    for k in range(9):
        metrics.upsert_metric(spark, path, spark.createDataFrame([(f"m{k % 4}", float(k))], "model string, mse double"))
        assert len(metrics._log(spark, path)) <= 4
    (tmp_path / "scores" / "log" / "000000000099").touch()  # a writer that was lost after its claim
    assert {r.model: r.mse for r in metrics.read_metrics(spark, path).collect()} == {"m0": 8.0, "m1": 5.0, "m2": 6.0, "m3": 7.0}


def test_metrics_from_a_document(spark, tmp_path):
    path = tmp_path / "scoreboard.json"
    path.write_text('{"linear_model": 3.6178, "tree": 2}', encoding="utf-8")
    got = {r.model: r.mse for r in metrics.metrics_from_document(spark, str(path)).collect()}
    assert got == {"linear_model": 3.6178, "tree": 2.0}


def test_nested_records_with_text_nan(spark, tmp_path):
    record = {"age": ["nan", 10.5, 20], "paleoData_values": [1.0, 2.0, "nan"], "geo_meanLat": 1.4, "paleoData_units": "degC"}
    path = tmp_path / "records.json"
    path.write_text(json.dumps(record) + "\n", encoding="utf-8")
    row = samples.read_samples(spark, str(path)).first()
    assert row.age == [None, 10.5, 20.0] and row.paleoData_values == [1.0, 2.0, None]
    pairs = samples.explode_pairs(samples.read_samples(spark, str(path)), "age", "paleoData_values", "a", "v")
    assert [(r.pos, r.a, r.v) for r in pairs.collect()] == [(1, 10.5, 2.0)]


def test_settled_tables_can_be_dropped(spark):
    df = settle(spark.range(5))
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    assert df.count() == 5 and shared_dir(spark).split(":")[-1] in path
    assert files.path_exists(spark, path)
    drop_scratch(spark)
    assert not files.path_exists(spark, path)
