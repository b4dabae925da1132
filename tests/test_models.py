import itertools
import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from epochline.models import arima, forecast, gradient, linear, search, trees
from tests.conftest import close


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    y = 2.0 + 3.0 * x[:, 0] - 1.5 * x[:, 2] + rng.normal(scale=0.3, size=300)
    rows = [(i, *map(float, x[i]), float(y[i])) for i in range(300)]
    df = spark.createDataFrame(rows, "k bigint, a double, b double, c double, d double, y double").cache()
    return df, x, y


X = ["a", "b", "c", "d"]


def test_ols_equals_the_library_fit(spark, data):
    df, _, _ = data
    ours = linear.fit_ols(df, X, "y")
    model = LinearRegression(featuresCol="f", labelCol="y", solver="normal").fit(VectorAssembler(inputCols=X, outputCol="f").transform(df))
    assert np.allclose(ours.coefs, model.coefficients.toArray(), atol=1e-8) and close(ours.intercept, model.intercept, 1e-8)
    matrix = linear.collect_grams(linear.gram(df, X, "y"), 5)[()]
    assert np.allclose(linear.p_values(matrix, [1, 2, 3, 4]), model.summary.pValues[:4], atol=1e-8)


def test_ridge_closed_form(data):
    df, x, y = data
    ours = linear.fit_ridge(df, X, "y", 7.0)
    centred = x - x.mean(axis=0)
    expected = np.linalg.solve(centred.T @ centred + 7 * np.eye(4), centred.T @ (y - y.mean()))
    assert np.allclose(ours.coefs, expected)


def test_t_distribution():
    assert close(linear.t_test_p(2.0, 10), 0.07338803477074, 1e-9)
    assert close(linear.t_test_p(0.0, 5), 1.0)
    assert close(linear.t_test_p(1.0, 1), 0.5, 1e-9)
    assert linear.t_test_p(math.inf, 5) == 0.0


def test_stepwise_finds_the_real_features(data):
    df, _, _ = data
    matrix = linear.collect_grams(linear.gram(df, X, "y"), 5)[()]
    assert sorted(linear.stepwise(matrix, linear.Stepwise(0.001, 0.01))) == [1, 3]


def test_incomplete_rows_do_not_count(spark, data):
    df, _, _ = data
    holes = df.unionByName(df.limit(5).withColumns({"k": F.col("k") + 1000, "b": F.lit(None).cast("double"), "y": F.lit(1e6)}))
    assert np.allclose(linear.fit_ols(holes, X, "y").coefs, linear.fit_ols(df, X, "y").coefs)


def test_folds_are_balanced_and_reproducible(data):
    df, _, _ = data
    one = {r.k: r.fold for r in linear.assign_folds(df, "k", 7).collect()}
    two = {r.k: r.fold for r in linear.assign_folds(df.repartition(5), "k", 7, group_limit=1).collect()}
    sizes = np.bincount(list(one.values()))
    assert one == two and sizes.max() - sizes.min() <= 1
    assert {r.k: r.fold for r in linear.assign_folds(df, "k", 7, seed=43).collect()} != one
    strata = linear.assign_folds(df, "k", 5, stratify="y").orderBy("y").collect()
    assert all({r.fold for r in strata[i : i + 5]} == set(range(5)) for i in range(0, 300, 5))
    hashed = linear.assign_folds(df, "k", 3, method="hash").select("fold").distinct().count()
    assert hashed == 3


def test_cross_validation_against_brute_force(data):
    df, x, y = data
    folds = {r.k: r.fold for r in linear.assign_folds(df, "k", 4).collect()}
    fold = np.array([folds[i] for i in range(300)])
    errors = []
    for f in range(4):
        train = np.c_[np.ones((fold != f).sum()), x[fold != f]]
        beta = np.linalg.lstsq(train, y[fold != f], rcond=None)[0]
        errors.append(np.mean((y[fold == f] - np.c_[np.ones((fold == f).sum()), x[fold == f]] @ beta) ** 2))
    result = linear.cross_validate(df, X, "y", "k", k=4)
    assert np.allclose(result.fold_mse, errors) and close(result.mse, np.mean(errors))


def test_ensemble_is_the_mean_of_the_models(data):
    df, _, _ = data
    result = linear.cross_validate(df, X, "y", "k", k=3, rule=linear.Stepwise())
    row = linear.predict_ensemble(df, result.models).where("k = 5").first()
    single = [linear.predict(df, m).where("k = 5").first().pred for m in result.models]
    assert close(row.pred, np.mean(single))


def test_gbt_kfold(data):
    df, _, y = data
    predicted, errors = trees.gbt_kfold(df, X, "y", "k", k=2, maxIter=15, maxDepth=3)
    assert predicted.count() == 300 and len(errors) == 2
    assert max(errors) < np.var(y)


def test_ar_recovers_a_known_process(spark):
    rng = np.random.default_rng(3)
    rows = []
    for name, phi, c in (("slow", 0.9, 1.0), ("fast", -0.5, 2.0)):
        v = 0.0
        for t in range(400):
            v = c + phi * v + rng.normal(scale=0.01)
            rows.append((name, t * 10, v))
    df = spark.createDataFrame(rows, "s string, t bigint, v double")
    fits = {r.s: r for r in forecast.fit_ar(df, ["s"], "t", "v", (1,)).collect()}
    assert close(fits["slow"].phi[0], 0.9, 0.05) and close(fits["fast"].phi[0], -0.5, 0.05)
    for limit in (10_000, 1):
        ahead = forecast.ar_forecast(df, ["s"], "t", "v", 3, (1,), step=10, z=1.645, echo=True, group_limit=limit)
        last = {r.s: r for r in ahead.where("step = 3").collect()}
        for name, row in last.items():
            value = [v for s, _, v in rows if s == name][-1]
            for _ in range(3):
                value = fits[name].intercept + fits[name].phi[0] * value
            assert close(row.pred, value) and row.t == 4020
            phi = fits[name].phi[0]
            assert close(row.hi - row.lo, 2 * 1.645 * fits[name].sigma * np.sqrt(1 + phi**2 + phi**4))
        assert ahead.where("step = 0").count() == 800


def test_ar_order_choice_by_brute_force(spark):
    rng = np.random.default_rng(5)
    v = [0.0, 0.0]
    for _ in range(300):
        v.append(0.5 + 0.4 * v[-1] + 0.4 * v[-2] + rng.normal(scale=0.2))
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "t bigint, v double")
    fit = forecast.fit_ar(df, [], "t", "v", (0, 1, 2, 3)).first()
    v, scores = np.array(v), {}
    target, n = v[3:], len(v) - 3
    for p in (0, 1, 2, 3):
        z = np.column_stack([np.ones(n)] + [v[3 - j : len(v) - j] for j in range(1, p + 1)])
        beta = np.linalg.lstsq(z, target, rcond=None)[0]
        sse, k = ((target - z @ beta) ** 2).sum(), p + 2
        scores[p] = n * np.log(sse / n) + 2 * k + 2 * k * (k + 1) / (n - k - 1)
    assert fit.p == min(scores, key=scores.get) and close(fit.aicc, min(scores.values()), 1e-6)


def test_arx_uses_the_future_inputs(spark):
    rows, v = [], 1.0
    for t in range(60):
        x = float((t * 7) % 5)
        v = 0.5 * v + 2.0 * x + 1.0
        rows.append((t, v, x))
    df = spark.createDataFrame(rows, "t bigint, v double, x double")
    future = spark.createDataFrame([(60, 4.0), (61, 1.0)], "t bigint, x double")
    got = forecast.ar_forecast(df, [], "t", "v", 2, (1,), exog=["x"], future=future).orderBy("step").collect()
    first = 0.5 * v + 2.0 * 4.0 + 1.0
    assert close(got[0].pred, first, 1e-6) and close(got[1].pred, 0.5 * first + 2.0 + 1.0, 1e-6)


def test_backtest_by_hand(spark):
    v = [1.0, 2.0, 1.5, 3.0, 2.0, 2.5, 1.0, 2.2, 1.7, 2.9]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "s string, t bigint, v double")
    got = {r.origin: r.mse for r in forecast.backtest(df, ["s"], "t", "v", 2, (1,), origins=(0, 1)).collect()}
    for origin in (0, 1):
        known = v[: len(v) - 2 - origin]
        slope, intercept = np.polyfit(known[:-1], known[1:], 1)
        one = intercept + slope * known[-1]
        two = intercept + slope * one
        truth = v[len(known) : len(known) + 2]
        assert close(got[origin], ((truth[0] - one) ** 2 + (truth[1] - two) ** 2) / 2)


SMALL = search.SearchConfig(population=10, generations=5, k=2, retrain_k=5, seed=9)


def test_search_finds_the_best_subset(data):
    df, _, _ = data
    best, history = search.search(df, X, "y", "k", SMALL)
    grams = search.fold_grams(df, X, "y", "k", 2, 9, "balanced")
    subsets = [m for m in itertools.product((0, 1), repeat=4) if any(m)]
    brute = min(linear.cross_validate_grams(grams, X, [i + 1 for i, b in enumerate(m) if b], 0.0).mse for m in subsets)
    assert {"a", "c"} <= set(best.features(X)) and best.fitness < brute * 1.05
    rows = history.collect()
    searched = [r.key for r in rows if r.generation >= 0]
    assert len(searched) == len(set(searched)) and rows[-1].generation == -1
    assert search.progress(history).count() <= 6


def test_search_is_reproducible_and_reuses_history(data, monkeypatch):
    df, _, _ = data
    best, history = search.search(df, X, "y", "k", SMALL)
    again, longer = search.search(df, X, "y", "k", SMALL, history=history)
    assert best.key == again.key and close(best.fitness, again.fitness)
    assert longer.where("generation >= 0").count() == 0


def test_arima_finds_a_planted_model(spark):
    rng = np.random.default_rng(1)
    rows = []
    for name, phi, theta, d in (("arma", 0.7, 0.4, 0), ("walk", 0.5, 0.0, 1)):
        e = rng.normal(size=4000)
        w = np.zeros(4000)
        for t in range(1, 4000):
            w[t] = 0.2 + phi * w[t - 1] + e[t] + theta * e[t - 1]
        rows += [(name, t, float(v)) for t, v in enumerate(np.cumsum(w) if d else w)]
    df = spark.createDataFrame(rows, "s string, t int, v double")
    grid = [(p, d, q) for d in (0, 1) for p in (0, 1) for q in (0, 1)]
    fits = {r.s: r for r in arima.fit_arima(df, ["s"], "t", "v", grid, long_ar=12).collect()}
    a, w = fits["arma"], fits["walk"]
    assert (a.p, a.d, a.q) == (1, 0, 1) and abs(a.phi[0] - 0.7) < 0.05 and abs(a.theta[0] - 0.4) < 0.06 and abs(a.sigma - 1) < 0.05
    assert w.d == 1 and abs(w.ar[0] - 1.5) < 0.08 and abs(w.ar[1] + 0.5) < 0.08


def test_arima_forecast_by_hand(spark):
    rows = [(t, float(v)) for t, v in enumerate([1, 3, 2, 5, 4, 7, 7, 9, 8, 12, 11, 13])]
    df = spark.createDataFrame(rows, "t int, v double")
    v = np.array([x for _, x in rows])
    w = np.diff(v)
    x = np.column_stack([np.ones(9), w[1:-1], w[:-2]])
    beta, *_ = np.linalg.lstsq(x, w[2:], rcond=None)
    want, last, recent = [], v[-1], [w[-1], w[-2]]
    for _ in range(3):
        step = beta @ [1, *recent]
        last, recent = last + step, [step, recent[0]]
        want.append(last)
    got = arima.arima_forecast(df, [], "t", "v", 3, [(2, 1, 0)], z=2.0).orderBy("step").collect()
    assert [close(r.pred, x, 1e-6) for r, x in zip(got, want)] == [True] * 3
    sigma = np.sqrt(((w[2:] - x @ beta) ** 2).sum() / 6)
    psi = [1.0, 1 + beta[1]]
    assert close(got[0].hi - got[0].pred, 2 * sigma, 1e-6) and close(got[1].hi - got[1].pred, 2 * sigma * np.hypot(*psi), 1e-6)


def test_arima_with_differenced_inputs(spark):
    rng = np.random.default_rng(2)
    x = np.cumsum(rng.normal(size=300))
    v = np.cumsum(0.3 + 2.0 * np.diff(x, prepend=0.0))
    past = spark.createDataFrame([(t, float(v[t]), float(x[t])) for t in range(280)], "t int, v double, x double")
    future = spark.createDataFrame([(t, float(x[t])) for t in range(280, 300)], "t int, x double")
    got = arima.arima_forecast(past, [], "t", "v", 5, [(0, 1, 0)], exog=["x"], future=future).orderBy("t").collect()
    assert np.allclose([r.pred for r in got], v[280:285])


def test_sweeping_equals_refitting():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4))
    x[:, 3] = x[:, 0] + 0.1 * x[:, 3]
    y = 2 * x[:, 0] - x[:, 1] + rng.normal(size=200)
    z = np.column_stack([x, y])
    moments = linear.Moments(200.0, z.mean(axis=0), (z - z.mean(axis=0)).T @ (z - z.mean(axis=0)))
    tableau = linear.Tableau(moments)
    for i in (1, 4, 2):
        tableau.sweep(i)
    want = linear.p_values(moments, [1, 4, 2])
    held = tableau.to_leave()
    assert np.allclose([tableau.p(held[i]) for i in (1, 4, 2)], want)
    assert close(tableau.p(tableau.to_enter()[3], 1), linear.p_values(moments, [1, 4, 2, 3])[-1], 1e-7)
    tableau.sweep(4)
    held = tableau.to_leave()
    assert np.allclose([tableau.p(held[i]) for i in (1, 2)], linear.p_values(moments, [1, 2]))
    assert linear.stepwise(moments) == [1, 2]


def test_fits_of_many_groups(spark):
    df = spark.range(4000).select((F.col("id") % 500).alias("g"), F.rand(1).alias("a"), F.rand(2).alias("b")).withColumn("y", F.col("g") + F.col("a") * 3 - F.col("b"))
    got = linear.fit_groups(df, ["a", "b"], "y", ["g"]).collect()
    assert len(got) == 500
    for r in got:
        assert close(r.intercept, r.g, 1e-6) and np.allclose(r.coefs, [3, -1]) and r.n == 8 and r.mse < 1e-9


def test_descent_stops_early(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 12))
    y = x[:, 0] + rng.normal(size=60) * 2
    rows = [(i, i % 3, *map(float, x[i]), float(y[i])) for i in range(60)]
    names = [f"x{k}" for k in range(12)]
    df = spark.createDataFrame(rows, f"i int, fold int, {', '.join(f'{n} double' for n in names)}, y double")
    how = gradient.Descent(rate=0.2, steps=500, patience=10, penalty=0.01)
    basis = {n: F.col(n) for n in names}
    stopped, _ = gradient.early_stopped(df, basis, "y", "i", how=how, fold="fold")
    for s in stopped:
        assert s.last_step == min(s.best_step + 10, 500)
        train, held = np.arange(60) % 3 != s.fold, np.arange(60) % 3 == s.fold
        m, sd = x[train].mean(axis=0), x[train].std(axis=0)
        w, best = np.zeros(12), []
        for _ in range(s.last_step + 1):
            best.append(((y[held] - y[train].mean() - (x[held] - m) / sd @ w) ** 2).mean())
            z = (x[train] - m) / sd
            w = w - 0.2 * (z.T @ (z @ w - (y[train] - y[train].mean())) / train.sum() + 0.01 * w)
        assert int(np.argmin(best)) == s.best_step and close(min(best), s.mse, 1e-9)
    pred = gradient.predict_stopped(df, basis, stopped).orderBy("i").collect()
    want = np.mean([s.model.intercept + x @ np.array(s.model.coefs) for s in stopped], axis=0)
    assert np.allclose([r.pred for r in pred], want)
