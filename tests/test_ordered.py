"""Ordered operators: golden values, and the blocked evaluation against plain windows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from epochline.operators import series as S
from epochline.operators.ordered import Delta, Fill, Interpolate, Lag, NearestKnown, Position, Rolling, Size, with_ordered
from tests.conftest import close


def frame(spark, values, keys=None):
    keys = keys or range(1, len(values) + 1)
    rows = [(int(k), None if v is None else float(v)) for k, v in zip(keys, values)]
    return spark.createDataFrame(rows, "t bigint, v double")


def values(df, col="v"):
    return [row[col] for row in df.orderBy("t").collect()]


@pytest.mark.parametrize("limit", [100, 1])
def test_interpolation(spark, limit):
    df = frame(spark, [1, None, None, 4, None], [1, 2, 3, 10, 11])
    assert values(S.interpolate(df, "t", ["v"], group_limit=limit)) == [1, 2, 3, 4, None]
    assert values(S.interpolate(df, "t", ["v"], edges="fill", group_limit=limit)) == [1, 2, 3, 4, 4]
    by_key = values(S.interpolate(df, "t", ["v"], axis="key", group_limit=limit))
    assert all(close(a, b) for a, b in zip(by_key, [1, 4 / 3, 5 / 3, 4, None]))
    head = frame(spark, [None, None, 5])
    assert values(S.interpolate(head, "t", ["v"], group_limit=limit)) == [None, None, 5]
    assert values(S.fill_both(head, "t", ["v"], group_limit=limit)) == [5, 5, 5]


@pytest.mark.parametrize("limit", [100, 1])
def test_rolling_mean(spark, limit):
    df = frame(spark, [1, 2, None, 4, 5, 6])
    assert values(S.rolling_mean(df, "t", ["v"], group_limit=limit)) == [None, None, None, None, 5, None]


@pytest.mark.parametrize("limit", [100, 1])
def test_padded_lag_and_delta(spark, limit):
    df = frame(spark, [10, 20, 30])
    assert values(S.add_lags(df, "t", ["v"], [2], pad="first", group_limit=limit), "v_lagged_2") == [10, 10, 10]
    assert values(S.add_lags(df, "t", ["v"], [2], group_limit=limit), "v_lagged_2") == [None, None, 10]
    assert values(S.add_deltas(df, "t", ["v"], group_limit=limit), "delta_v") == [None, 10, 10]
    assert values(S.add_deltas(df, "t", ["v"], pad="first", group_limit=limit), "delta_v") == [0, 10, 10]


def test_stride_fill_cascades(spark):
    months = [None if m in (0, 24) else (7 if m == 48 else m) for m in range(50)]
    got = values(S.stride_fill(frame(spark, months, range(50)), "t", "v", 24))
    assert got[0] == got[24] == got[48] == 7
    assert got[1] == 1 and got[25] == 25


def test_interpolate_where_keeps_the_rest(spark):
    df = frame(spark, [1, None, 3, None, 5])
    assert values(S.interpolate_where(df, "t", ["v"], F.col("t") <= 3)) == [1, 2, 3, None, 5]


def test_chunk_mean_first_chunk_is_short(spark):
    got = S.chunk_mean(frame(spark, [1, 2, 3, 4, 5]), "t", 2, ["v"]).orderBy("group_number").collect()
    assert [(r.group_number, r.v) for r in got] == [(0, 1.0), (1, 2.5), (2, 4.5)]


def test_chrono_split(spark):
    got = S.chrono_split(frame(spark, range(15)), "t", 0.9).orderBy("t").collect()
    assert [r.split for r in got] == ["train"] * 13 + ["test"] * 2


def test_latest_value(spark):
    df = frame(spark, [5, 6, 7])
    assert S.latest_value(df, "t", ["v"]).first().v == 7
    assert S.latest_value(df, "t", ["v"], first=True).first().v == 5


def test_dense_id_is_stable_under_repartitioning(spark):
    df = spark.range(500).select((F.col("id") % 7).alias("a"), "id")
    one = S.dense_id(df.repartition(3), ["a", "id"], "n", offset=10).orderBy("n").collect()
    two = S.dense_id(df.repartition(11), ["a", "id"], "n", offset=10, group_limit=1).orderBy("n").collect()
    assert one == two
    assert [r.n for r in one] == list(range(11, 511))


def skewed(spark):
    """One series holds most rows, and one key within it is shared by a third of them."""
    rng = random.Random(7)
    rows = []
    for name, size in (("hot", 600), ("b", 5), (None, 90), ("c", 1)):
        for i in range(size):
            t = 50 if i < size // 3 else rng.randrange(-200, 1000)
            v = None if rng.random() < 0.4 else rng.random() * 10
            rows.append((name, t, i, v, rng.random()))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "s string, t bigint, i bigint, v double, w double")


EXPRS = {
    "lag1": Lag("v", k=1),
    "lag40": Lag("w", k=40, pad="first"),
    "delta": Delta("w", k=1, pad="first"),
    "centred": Rolling("v", before=1, after=1),
    "wide": Rolling("v", before=5, after=9, min_count=4),
    "behind": Rolling("v", before=30, after=0, min_count=1),
    "fill": Fill("v"),
    "backward": Fill("v", direction="backward"),
    "forward": Fill("v", direction="forward"),
    "line": Interpolate("v"),
    "by_key": Interpolate("v", axis="key", edges="fill"),
    "near": NearestKnown("v"),
    "pos": Position(offset=7),
    "size": Size(),
}


@pytest.mark.parametrize("series", [["s"], []])
def test_blocked_equals_plain(spark, series):
    df = skewed(spark)
    plain = with_ordered(df, "t", EXPRS, series, ["i", "w"]).orderBy("s", "t", "i", "w").collect()
    blocked = with_ordered(df, "t", EXPRS, series, ["i", "w"], group_limit=1).orderBy("s", "t", "i", "w").collect()
    assert len(plain) == len(blocked) == df.count()
    for a, b in zip(plain, blocked):
        for c in a.__fields__:
            same = close(a[c], b[c]) if isinstance(a[c], float) and isinstance(b[c], float) else a[c] == b[c]
            assert same, (c, a, b)


def test_a_known_bound_saves_the_count(spark, monkeypatch):
    import epochline.operators.ordered as module

    monkeypatch.setattr(module, "group_sizes", lambda *_: pytest.fail("no count expected"))
    df = frame(spark, [1, 2, 3])
    assert values(S.add_lags(df, "t", ["v"], [1], max_rows=3), "v_lagged_1") == [None, 1, 2]


def test_bin_and_fill(spark):
    df = spark.createDataFrame(
        [(0.2, 10.0, 1.0), (0.4, 20.0, None), (5.0, 40.0, 3.0), (9.0, None, float("nan"))], "t double, co2 double, be double"
    )
    spine = spark.createDataFrame([(b,) for b in range(0, 12)], "year_bin bigint")
    filled = S.bin_and_fill(df, "t", F.bround("t").cast("bigint"), spine, ["co2", "be"], horizon=10, horizon_cols=["co2"])
    got = {r.year_bin: (r.co2, r.be) for r in filled.collect()}
    assert set(got) == set(range(12))
    assert got[0] == (15.0, 1.0) and got[5] == (40.0, 3.0)
    assert close(got[2][0], 25.0) and close(got[1][1], 1.4)
    assert got[9] == (40.0, 3.0) and got[11] == (None, 3.0)


def test_a_small_table_with_one_long_series_is_exchanged_once(spark, capsys):
    df = skewed(spark)
    with_ordered(df, "t", {"x": Lag("v")}, ["s"], ["i", "w"]).explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1


def test_segments_of_sampled_bounds(spark, monkeypatch):
    import epochline.operators.ordered as module

    monkeypatch.setattr(module, "SAMPLED", 3)
    monkeypatch.setattr(module, "SEGMENTS", 16)
    df = spark.range(5000).select(F.when(F.col("id") % 10 < 7, "long").otherwise(F.col("id").cast("string")).alias("s"), F.col("id").alias("t"), F.col("id").alias("v"))
    got = with_ordered(df, "t", {"pos": Position(), "lag": Lag("v", k=2)}, ["s"], group_limit=200).where("s = 'long'").orderBy("t").collect()
    ids = [i for i in range(5000) if i % 10 < 7]
    assert [(r.t, r.pos, r.lag) for r in got] == [(t, k + 1, ids[k - 2] if k > 1 else None) for k, t in enumerate(ids)]


def test_numbered_rows(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("v")).repartition(7)
    dense = [r.n for r in S.number_rows(df, "n", offset=10).collect()]
    assert sorted(dense) == list(range(11, 111))
    sparse = S.number_rows(df, "n", consecutive=False)
    assert sparse.select("n").distinct().count() == 100 and sorted(r.n for r in sparse.collect()) == sorted(r.n for r in sparse.collect())
    assert S.number_rows(df.limit(0), "n").count() == 0


def test_a_long_spine_is_spread(spark, monkeypatch):
    import epochline.operators.series as module

    monkeypatch.setattr(module, "SPINE_RUN", 10)
    df = spark.createDataFrame([("a", 1), ("a", 4000), ("b", 2), ("c", None), ("d", -7), ("d", 12)], "s string, t bigint")
    spine = S.regular_spine(df, "t", 3, ["s"])
    keys = sorted((r.s, r.t) for r in spine.collect())
    assert keys == sorted([("a", t) for t in range(1, 4001, 3)] + [("b", 2)] + [("d", t) for t in range(-7, 13, 3)])
    sizes = [r["count"] for r in spine.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 3 and max(sizes) < 600


def test_regular_spine_per_series(spark):
    df = spark.createDataFrame([("a", 1), ("a", 4), ("b", 2)], "s string, t bigint")
    spine = S.regular_spine(df, "t", 1, ["s"]).orderBy("s", "t").collect()
    assert [(r.s, r.t) for r in spine] == [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 2)]


def test_many_segments_are_planned_in_bounded_time(spark):
    """The search for a row's segment may not grow the plan with every halving of the bounds."""
    df = spark.range(5000).select((F.col("id") % 2).alias("s"), F.col("id").alias("t"), F.col("id").alias("v"))
    got = with_ordered(df, "t", {"pos": Position(), "lag": Lag("v", k=2)}, ["s"], group_limit=1)
    planned = time.time()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert time.time() - planned < 15 and 1 < plan.count("__block#") and plan.count("AS __block#") <= 8
    assert [(r.t, r.pos, r.lag) for r in got.orderBy("s", "t").collect()] == [
        (t, k + 1, t - 4 if k > 1 else None) for s in range(2) for k, t in enumerate(range(s, 5000, 2))
    ]
