import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochline.operators import clean, grid, lookup, star, stats
from tests.conftest import close


def column(df, col, order):
    return [row[col] for row in df.orderBy(order).collect()]


def test_standard_scale(spark):
    df = spark.createDataFrame([(1, 1.0, 4.0), (2, 2.0, 4.0), (3, 3.0, 4.0)], "k int, a double, flat double")
    scaled = stats.standard_scale(df, exclude=["k"])
    assert all(close(a, b) for a, b in zip(column(scaled, "a", "k"), [-1.224744871391589, 0, 1.224744871391589]))
    assert column(scaled, "flat", "k") == [0, 0, 0]
    partly = stats.standard_scale(df, ["a"], fit=df.where("k < 3"))
    assert column(partly, "a", "k") == [-1, 1, 3]


def test_minmax_scale(spark):
    df = spark.createDataFrame([("x", 2.0), ("x", 4.0), ("x", 6.0), ("y", 9.0), (None, 1.0)], "g string, v double")
    whole = stats.minmax_scale(df.where("g = 'x'"), ["v"])
    assert column(whole, "v", "v") == [0, 0.5, 1]
    by_group = stats.minmax_scale(df, ["v"], ["g"]).collect()
    assert sorted(r.v for r in by_group if r.g == "x") == [0, 0.5, 1]
    assert [r.v for r in by_group if r.g != "x"] == [0.5, 0.5]


@pytest.mark.parametrize("slack", [None, -0.02])
def test_quantiles_match_numpy(spark, monkeypatch, slack):
    if slack is not None:  # bounds that miss, as a sketch's may: the group is counted whole
        monkeypatch.setattr(clean, "SLACK", slack)
        monkeypatch.setattr(clean, "SKETCH", 64)
    df = spark.range(3000).select(F.when(F.rand(3) < 0.4, 5.0).otherwise(F.round(F.rand(5) * 20, 3)).alias("v")).cache()
    x = np.sort([r.v for r in df.collect()])
    qs = [0.0, 0.01, 0.25, 0.5, 0.75, 1.0]
    assert np.allclose(clean.quantiles(df, "v", qs), np.quantile(x, qs))
    nearest = [x[math.floor((len(x) - 1) * q + 0.5)] for q in qs]
    assert np.allclose(clean.quantiles(df, "v", qs, "nearest"), nearest)
    approx = clean.quantiles(df, "v", [0.5], "approx")[0]
    assert x[1400] <= approx <= x[1600]


@pytest.mark.parametrize("slack", [None, -0.02])
def test_quantiles_of_groups(spark, monkeypatch, slack):
    if slack is not None:
        monkeypatch.setattr(clean, "SLACK", slack)
        monkeypatch.setattr(clean, "SKETCH", 64)
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=2000), "b": np.repeat([1.0, 2.0], [700, 5]), "c": np.array([7.0]), None: rng.integers(0, 9, 500).astype(float)}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan")), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: (r.n, r.quantiles) for r in clean.group_quantiles(df, ["g"], "v", [0.1, 0.25, 0.75]).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g][0] == len(vs) and np.allclose(got[g][1], np.quantile(vs, [0.1, 0.25, 0.75]))


def test_iqr_filter(spark):
    df = spark.createDataFrame([(float(v),) for v in [*range(1, 21), 500]], "v double")
    assert clean.iqr_filter(df, "v").agg(F.max("v")).first()[0] == 20
    assert clean.iqr_filter(df.limit(0), "v").count() == 0


def test_repair_shifted(spark):
    df = spark.createDataFrame([(9.0, 2.23, 5.36, None), (1.0, 2.0, 3.0, 4.0), (1.0, 2.0, 3.0, None)], "a double, b double, c double, d double")
    got = [tuple(r) for r in clean.repair_shifted(df, df.columns, clean.leading_lost(df.columns, "c", (0, 3))).collect()]
    assert got == [(None, 9.0, 2.23, 5.36), (1.0, 2.0, 3.0, 4.0), (1.0, 2.0, 3.0, None)]


def test_duplicate_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert [tuple(r) for r in clean.duplicate_keys(df, "k").collect()] == [(1, 2)]


def test_sample_rule(spark):
    schema = (
        "id int, paleoData_units string, paleoData_useInGlobalTemperatureAnalysis string, paleoData_QCnotes string, "
        "age array<double>, paleoData_values array<double>"
    )
    nan = float("nan")
    rows = [
        (1, "degC", None, None, [1.0], [2.0]),
        (2, "m", None, None, [1.0], [2.0]),
        (3, "degC", "FALSE", None, [1.0], [2.0]),
        (4, "degC", "TRUE", "please DELETE", [1.0], [2.0]),
        (5, "degC", "TRUE", "fine", None, [2.0]),
        (6, "degC", None, None, [nan, 1.0], [2.0, 3.0]),
        (7, "degC", None, None, [1.0], [None]),
        (8, None, None, None, [1.0], [2.0]),
        (9, "degC", None, None, [], []),
    ]
    good, rest = clean.split_valid(spark.createDataFrame(rows, schema), clean.sample_rule())
    assert [r.id for r in good.collect()] == [1]
    assert rest.count() == 8


def test_quarantine_extreme(spark):
    df = spark.createDataFrame([("a", 1, 50.0), ("a", 2, 1.0), ("b", 1, 0.0), ("b", 2, -21.0)], "s string, t int, v double")
    kept, extreme = clean.quarantine_extreme(df, ["s"], "t", "v")
    assert kept.count() == 4 and {r.s for r in extreme.collect()} == {"b"}


def test_latest_by_priority(spark):
    ice = spark.createDataFrame([(1980, 338.0), (1900, 295.0)], "year_bin bigint, co2 double")
    modern = spark.createDataFrame([(1980, 338.91)], "year_bin bigint, co2 double")
    merged = star.merge_sources([(modern, 1), (ice, 0)], "year_bin", ["co2"])
    assert {r.year_bin: r.co2 for r in merged.collect()} == {1980: 338.91, 1900: 295.0}


def test_range_split(spark):
    years = {-600000: "train", -500000: "test", -300000: "test", -298000: "train", 2025: "train", 4000: "forecast"}
    df = spark.createDataFrame([(y,) for y in [*years, 300000]], "t bigint")
    got = {r.t: r.split for r in star.range_split(df, "t", (-500000, -300000), 2025, 200000).collect()}
    assert got == years


def test_extend_dimension(spark):
    dim = spark.createDataFrame([(1, 1), (2, 2)], "time_id bigint, year_bin bigint")
    keys = spark.createDataFrame([(2,), (5,)], "time_id bigint")
    got = {tuple(r) for r in star.extend_dimension(dim, keys, "time_id", ["year_bin"]).collect()}
    assert got == {(1, 1), (2, 2), (5, 5)}
    measured = spark.createDataFrame([(1, 280.0)], "time_id bigint, co2_ppm double")
    assert {tuple(r) for r in star.extend_dimension(measured, keys, "time_id").collect()} == {(1, 280.0), (2, None), (5, None)}


def test_forward_lookup(spark):
    ref = spark.createDataFrame(
        [("c", 1850, None), ("c", 1860, float("nan")), ("c", 1865, 9.0), ("c", 1870, 0.3), ("c", 1880, 0.4)],
        "cell string, year int, v double",
    )
    probes = spark.createDataFrame([(1, "c", 1850), (2, "c", 1890), (3, "d", 1850), (4, "c", 1870), (5, None, 1850)], "id int, cell string, y int")
    for limit in (100, 1):
        found = lookup.forward_lookup(probes, ref, ["cell"], "y", "year", "v", 10, group_limit=limit)
        assert column(found, "v", "id") == [0.3, None, None, 0.3, None]


def test_nearest_lookup_prefers_the_lower_on_a_tie(spark):
    ref = spark.createDataFrame([(1.0,), (3.0,), (10.0,)], "v double")
    probes = spark.createDataFrame([(1, 2.0), (2, 0.0), (3, 99.0), (4, 7.0), (5, 3.0)], "id int, x double")
    for limit in (100, 1):
        assert column(lookup.nearest_lookup(probes, ref, "x", "v", group_limit=limit), "nearest", "id") == [1, 1, 10, 10, 3]


def test_label_intervals_against_brute_force(spark):
    spans = [(0, 10, "a"), (5, 6, "b"), (100, 100, "c"), (-50, 200, "wide"), (300, 320, "d")]
    keys = [-60, -50, 0, 5, 6, 7, 10, 11, 100, 200, 201, 310, 400]
    frame = spark.createDataFrame([(k,) for k in keys], "t bigint")
    got = sorted((r.t, r.label or "") for r in lookup.label_intervals(
        frame, spark.createDataFrame(spans, "lo bigint, hi bigint, label string"), "t").collect())
    expected = sorted((k, name) for k in keys for name in ([n for lo, hi, n in spans if lo <= k <= hi] or [""]))
    assert got == expected


def test_a_long_span_is_few_cells(spark):
    spans = spark.createDataFrame([(i * 10.0, i * 10.0 + 9.0, f"s{i}") for i in range(40)] + [(-3.0, 1e9, "long"), (5.0, 4.0, "none")], "lo double, hi double, label string")
    cells = spark.range(1).select(F.size(lookup.dyadic_cells(F.lit(-5), F.lit(10**9))).alias("n")).first().n
    assert cells <= 2 * 31
    held = spark.range(1).select(F.inline(lookup.dyadic_cells(F.lit(-5), F.lit(77)))).collect()
    assert sorted(x for r in held for x in range(r.cell << r.level, (r.cell + 1) << r.level)) == list(range(-5, 78))
    keys = [-4.0, -3.0, 0.0, 9.5, 25.0, 399.0, 400.0, 1e9, 1e9 + 1, None, 25.0]
    got = sorted((r.t is None, r.t or 0, r.label or "") for r in lookup.label_intervals(spark.createDataFrame([(k,) for k in keys], "t double"), spans, "t").collect())
    names = [(i * 10.0, i * 10.0 + 9.0, f"s{i}") for i in range(40)] + [(-3.0, 1e9, "long")]
    want = [(k is None, k or 0, n) for k in keys for n in ([n for lo, hi, n in names if k is not None and lo <= k <= hi] or [""])]
    assert got == sorted(want)


def test_rebase_and_shift(spark):
    df = spark.createDataFrame(
        [(1, 0.0, 10.0), (1, 100.0, 12.0), (1, 200.0, 9.0)], "s int, age double, v double"
    ).withColumns({"reference": F.lit(0.5), "climate": F.lit(15.0)})
    rows = lookup.rebase(df, ["s"], "age", "v", "reference", "climate").orderBy("age").collect()
    assert [(r.year, r.anomaly, r.degC) for r in rows] == [(1950, 0.5, 15.5), (1850, 2.5, 17.5), (1750, -0.5, 14.5)]
    ages = spark.createDataFrame([([-70.0, 0.0, None, 50.0],), ([10.0, 20.0],)], "age array<double>")
    got = [r.a for r in ages.select(lookup.shift_future(F.col("age")).alias("a")).collect()]
    assert got == [[-50.0, 20.0, None, 70.0], [10.0, 20.0]]


def test_grid_index(spark):
    got = grid.grid_to_long(spark.range(24).withColumnRenamed("id", "i"), "i", [("month", None, 0), ("lat", 3, -1), ("lon", 4, 10)])
    rows = [tuple(r)[1:] for r in got.orderBy("i").collect()]
    assert rows == [(m, a - 1, o + 10) for m in range(2) for a in range(3) for o in range(4)]
    assert grid.decimate(got, ["lat", "lon"]).count() == 2 * 1 * 2


def test_weighted_mean_and_trend(spark):
    df = spark.createDataFrame([(0, 1.0), (60, 4.0), (60, None)], "lat int, v double")
    mean = stats.weighted_mean(df, "v", stats.latitude_weight(F.col("lat"))).first()[0]
    assert close(mean, (1 + 4 * 0.5) / 1.5)
    line = spark.createDataFrame([(x, 3.0 * x + 1) for x in range(5)], "x int, y double")
    row = stats.trend(line, "x", "y").first()
    assert close(row.slope, 3) and close(row.intercept, 1) and close(row.r2, 1) and row.n == 5


def test_label_intervals_sends_no_probes_to_the_driver(spark, monkeypatch):
    monkeypatch.setattr(lookup, "FEW_CELLS", 100, raising=False)
    keys = spark.range(2000).select((F.col("id") * 10).alias("t"))
    spans = spark.range(2000).select((F.col("id") * 10).alias("lo"), (F.col("id") * 10 + F.when(F.col("id") % 100 == 0, 5000).otherwise(9)).alias("hi"), F.col("id").alias("label"))
    found = lookup.label_intervals(keys, spans, "t")
    rows = found.collect()
    assert len(rows) == sum(s <= k <= s + (500 if s % 100 == 0 else 0) for s in range(2000) for k in range(s, min(s + 501, 2000)))
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert "Generate explode" in plan and not any("BroadcastHashJoin [level" in line for line in plan.splitlines())


def test_label_intervals_deals_out_no_pairs_of_rows_and_spans(spark, monkeypatch):
    keys = spark.createDataFrame([(i, None if i % 50 == 0 else float(i // 2 * 2), i) for i in range(300)], "id long, t double, level int")
    spans = spark.createDataFrame([(float(i), i + 150.0, i) for i in range(0, 200, 2)], "lo double, hi double, name int")
    want = []
    for i in range(300):
        held = [] if i % 50 == 0 else [s for s in range(0, 200, 2) if s <= i // 2 * 2 <= s + 150]
        want += [(i, s) for s in held or [-1]]
    for few in (10_000, 10):
        monkeypatch.setattr(lookup, "FEW_CELLS", few)
        found = lookup.label_intervals(keys, spans, "t", label="name")
        assert found.columns == ["id", "t", "level", "name"]
        assert sorted((r.id, -1 if r.name is None else r.name) for r in found.collect()) == want
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0].splitlines()
        depth = [len(line) - len(line.lstrip(" :+-*()0123456789")) for line in plan]
        at = next(i for i, line in enumerate(plan) if "Join [__level" in line and "Inner" in line or "Join [level" in line and "Inner" in line)
        above, least = [], depth[at]
        for i in range(at - 1, -1, -1):
            if depth[i] < least:
                least = depth[i]
                above.append(plan[i])
        assert above and not any("Exchange" in line or "ShuffleQueryStage" in line for line in above), above
        assert few > 10 or not any("BroadcastHashJoin [__level" in line for line in plan)
