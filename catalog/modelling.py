"""Regression, cross-validation, forecasting and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import Registry, daily, days, pseudo_year, r, rounded, sql_daily, table
from catalog.views import CONFIG, training
from epochline.models import arima, forecast, gradient, linear, search, trees
from epochline.plans import modeling, report

QUERIES = Registry()
query = QUERIES.query

X = ["l_quantity", "l_discount", "l_tax"]
Y = "price"


def lines(spark, sf_dir):
    """Line items with a discounted price in thousands, and a key that is stable between runs."""
    lineitem = table(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return lineitem.select(key.alias("key"), "l_linenumber", *X, (F.col("l_extendedprice") * (1 - 4 * F.col("l_discount")) / 1000).alias(Y))


def terms(spark, model: linear.LinearModel, places: int = 5):
    rows = [("intercept", model.intercept), *zip(model.features, model.coefs)]
    return rounded(spark.createDataFrame([(t, float(c)) for t, c in rows], "term string, coef double"), ["coef"], places)


TWO_VARIABLES = """WITH s AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12,
    covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y FROM ({source})),
  b AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM s)"""
LINES = "SELECT l_quantity AS x1, l_discount AS x2, l_extendedprice * (1 - 4 * l_discount) / 1000 AS y FROM lineitem"


@query(
    "ols_gram",
    "M1",
    f"""{TWO_VARIABLES.format(source=LINES)}
    SELECT 'intercept' AS term, {r('my - b1 * m1 - b2 * m2', 5)} AS coef FROM b UNION ALL SELECT 'l_quantity', {r('b1', 5)} FROM b
    UNION ALL SELECT 'l_discount', {r('b2', 5)} FROM b""",
)
def ols_gram(spark, sf_dir):
    return terms(spark, linear.fit_ols(lines(spark, sf_dir), ["l_quantity", "l_discount"], Y))


@query(
    "ridge_gram",
    "M7",
    f"""WITH s AS (SELECT avg(x1) AS mx, avg(y) AS my, covar_pop(x1, y) * count(*) AS sxy, var_pop(x1) * count(*) AS sxx FROM ({LINES})),
    b AS (SELECT *, sxy / (sxx + 50000) AS b1 FROM s)
    SELECT 'intercept' AS term, {r('my - b1 * mx', 5)} AS coef FROM b UNION ALL SELECT 'l_quantity', {r('b1', 5)} FROM b""",
)
def ridge_gram(spark, sf_dir):
    return terms(spark, linear.fit_ridge(lines(spark, sf_dir), ["l_quantity"], Y, 50000.0))


FAR = 1e9
FAR_LINES = "SELECT l_orderkey AS x, 2 * l_orderkey + l_quantity AS y, l_linenumber AS f FROM lineitem"


@query(
    "ols_far_from_zero",
    "M1",
    f"""WITH m AS (SELECT avg(x) AS mx, avg(y) AS my, regr_slope(y, x) AS b, count(*) AS n FROM ({FAR_LINES}))
    SELECT {r('b', 8)} AS slope, (SELECT {r('avg((y - my - b * (x - mx)) ** 2)', 4)} FROM ({FAR_LINES}), m) AS mse, n FROM m""",
)
def ols_far_from_zero(spark, sf_dir):
    """A feature like an epoch time: far from zero, with a small spread. SQL computes the same slope and error on the keys themselves."""
    rows = far_lines(spark, sf_dir)
    moments = linear.collect_grams(linear.gram(rows, ["x"], "y"), 2)[()]
    beta = linear.solve(moments, [1])
    found = [(float(beta[1]), linear.squared_error(moments, [1], beta) / moments.n, int(moments.n))]
    return rounded(rounded(spark.createDataFrame(found, "slope double, mse double, n bigint"), ["slope"], 8), ["mse"], 4)


def far_lines(spark, sf_dir):
    x = F.col("l_orderkey") + F.lit(FAR)
    return table(spark, sf_dir, "lineitem").select(x.alias("x"), (2 * F.col("l_orderkey") + F.col("l_quantity")).alias("y"), "l_linenumber")


@query(
    "kfold_far_from_zero",
    "M4",
    f"""WITH l AS ({FAR_LINES}), k AS (SELECT DISTINCT f FROM l),
    m AS (SELECT k.f, avg(x) AS mx, avg(y) AS my, regr_slope(y, x) AS b FROM k JOIN l ON l.f <> k.f GROUP BY 1)
    SELECT l.f AS fold, {r('any_value(b)', 8)} AS slope, {r('avg((y - my - b * (x - mx)) ** 2)', 4)} AS mse FROM l JOIN m USING (f) GROUP BY 1""",
)
def kfold_far_from_zero(spark, sf_dir):
    grams = linear.collect_grams(linear.gram(far_lines(spark, sf_dir), ["x"], "y", ["l_linenumber"]), 2)
    folds = {fold: m for (fold,), m in grams.items()}
    result = linear.cross_validate_grams(folds, ["x"])
    rows = [(f, m.coefs[0], e) for f, m, e in zip(sorted(folds), result.models, result.fold_mse)]
    return rounded(rounded(spark.createDataFrame(rows, "fold int, slope double, mse double"), ["slope"], 8), ["mse"], 4)


@query(
    "ridge_per_row",
    "M7",
    f"""WITH s AS (SELECT covar_pop(x1, y) AS sxy, var_pop(x1) AS sxx FROM ({LINES})), g(lam) AS (VALUES (0.0::DOUBLE), (0.05), (0.2))
    SELECT lam, {r('sxy / (sxx * (1 + lam))', 7)} AS slope FROM s, g""",
)
def ridge_per_row(spark, sf_dir):
    """The penalty on the mean loss over scaled features: it changes the slope alike at every number of rows."""
    moments = linear.collect_grams(linear.gram(lines(spark, sf_dir), ["l_quantity"], Y), 2)[()]
    rows = [(lam, float(linear.solve(moments, [1], lam, per_row=True)[1])) for lam in (0.0, 0.05, 0.2)]
    return rounded(spark.createDataFrame(rows, "lam double, slope double"), ["slope"], 7)


@query(
    "predict",
    "M6",
    f"""WITH c AS (SELECT regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a FROM ({LINES}))
    SELECT l_orderkey * 10 + l_linenumber AS key, {r('a + b * l_quantity', 5)} AS pred FROM lineitem, c""",
)
def predict(spark, sf_dir):
    rows = lines(spark, sf_dir)
    return rounded(linear.predict(rows, linear.fit_ols(rows, ["l_quantity"], Y)), ["pred"], 5).select("key", "pred")


STEP_X = [*X, "l_linenumber"]


def _swept(n: int) -> str:
    """CTEs of one forward step: the best feature outside, if its p-value is below 0.1, is swept into the tableau."""
    return f"""k{n} AS (SELECT arg_max(d.i, pow(y.v, 2) / d.v) AS pick FROM t{n} d JOIN t{n} y ON y.i = d.i AND y.j = 'y' JOIN t{n} e ON e.i = 'y' AND e.j = 'y' CROSS JOIN m
      WHERE d.i = d.j AND d.i <> 'y' AND d.v > 1e-11 AND pow(y.v, 2) / d.v * (m.n - {n} - 2) / (e.v - pow(y.v, 2) / d.v) > 2.7055),
    t{n + 1} AS (SELECT a.i, a.j, CASE WHEN pick IS NULL THEN a.v WHEN a.i = pick AND a.j = pick THEN -1 / d.v WHEN a.i = pick OR a.j = pick THEN a.v / d.v ELSE a.v - b.v * c.v / d.v END AS v
      FROM t{n} a CROSS JOIN k{n} LEFT JOIN t{n} d ON d.i = pick AND d.j = pick LEFT JOIN t{n} b ON b.j = pick AND b.i = a.i LEFT JOIN t{n} c ON c.i = pick AND c.j = a.j)"""


def sql_stepwise() -> str:
    """Forward steps over a tableau of correlations, in long form; no feature of these leaves again."""
    names = [*STEP_X, "y"]
    moments = ", ".join(f"avg({c}) AS mean_{c}, stddev_pop({c}) AS sd_{c}" for c in names)
    first = " UNION ALL ".join(f"SELECT '{i}' AS i, '{j}' AS j, corr({i}, {j}) AS v FROM l" for i in names for j in names)
    coefs = [f"SELECT '{c}' AS term, v * sd_y / sd_{c} AS coef, v * sd_y / sd_{c} * mean_{c} AS part FROM t4 CROSS JOIN m WHERE i = '{c}' AND j = 'y' AND (SELECT v < 0 FROM t4 WHERE i = '{c}' AND j = '{c}')" for c in STEP_X]
    return f"""WITH l AS (SELECT {", ".join(STEP_X)}, l_extendedprice * (1 - 4 * l_discount) / 1000 AS y FROM lineitem), m AS (SELECT count(*) AS n, {moments} FROM l),
    t0 AS ({first}), {", ".join(_swept(n) for n in range(4))}, c AS ({" UNION ALL ".join(coefs)})
    SELECT term, {r('coef', 5)} AS coef FROM c UNION ALL SELECT 'intercept', {r('(SELECT mean_y FROM m) - (SELECT coalesce(sum(part), 0) FROM c)', 5)}"""


@query("stepwise", "M2", sql_stepwise())
def stepwise(spark, sf_dir):
    rows = lines(spark, sf_dir)
    x = STEP_X
    matrix = linear.collect_grams(linear.gram(rows, x, Y), len(x) + 1)[()]
    return terms(spark, linear.fit_matrix(matrix, x, linear.stepwise(matrix)))


@query("fold_sizes", "M3", "SELECT f AS fold, ((SELECT count(*) FROM orders) + 9 - f) // 10 AS n FROM (SELECT unnest(range(0, 10))::INT AS f)")
def fold_sizes(spark, sf_dir):
    folded = linear.assign_folds(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 10)
    return folded.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query("stratified_folds", "M3", "SELECT rn // 5 AS stratum, sum(1)::BIGINT AS n, count(*) AS folds FROM (SELECT row_number() OVER () - 1 AS rn FROM orders) GROUP BY 1")
def stratified_folds(spark, sf_dir):
    """Every five neighbours in price order get five different folds."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    folded = linear.assign_folds(orders, "o_orderkey", 5, stratify="o_totalprice").withColumn(
        "shuffled", F.xxhash64(F.lit(42), F.col("o_orderkey"))
    )
    from epochline.operators.series import dense_id

    placed = dense_id(folded, ["o_totalprice", "shuffled", "o_orderkey"], "rn", offset=-1)
    return placed.groupBy(F.floor(F.col("rn") / 5).alias("stratum")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("fold").alias("folds")
    )


LEAVE_OUT = f"""WITH l AS (SELECT l_orderkey, l_linenumber AS f, l_quantity AS x, l_extendedprice * (1 - 4 * l_discount) / 1000 AS y FROM lineitem),
  s AS (SELECT f, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM l GROUP BY 1),
  t AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM s),
  d AS (SELECT s.*, t.n - s.n AS tn, t.sx - s.sx AS tx, t.sy - s.sy AS ty, t.sxx - s.sxx AS txx, t.sxy - s.sxy AS txy FROM s, t),
  c AS (SELECT *, (tn * txy - tx * ty) / (tn * txx - tx * tx) AS b FROM d),
  m AS (SELECT *, (ty - b * tx) / tn AS a FROM c)"""


@query(
    "kfold_given_folds",
    "M4",
    f"""{LEAVE_OUT} SELECT f AS fold, {r('a', 5)} AS intercept, {r('b', 5)} AS slope,
      {r('(syy - 2 * (a * sy + b * sxy) + a * a * n + 2 * a * b * sx + b * b * sxx) / n', 4)} AS mse FROM m""",
)
def kfold_given_folds(spark, sf_dir):
    """Leave one line number out: the folds come with the data, so that SQL can do the same."""
    grams = linear.collect_grams(linear.gram(lines(spark, sf_dir), ["l_quantity"], Y, ["l_linenumber"]), 2)
    folds = {fold: m for (fold,), m in grams.items()}
    result = linear.cross_validate_grams(folds, ["l_quantity"])
    rows = [(f, m.intercept, m.coefs[0], e) for f, m, e in zip(sorted(folds), result.models, result.fold_mse)]
    table_ = spark.createDataFrame(rows, "fold int, intercept double, slope double, mse double")
    return rounded(rounded(table_, ["intercept", "slope"], 5), ["mse"], 4)


@query(
    "ensemble_predict",
    "M5 A13",
    f"""{LEAVE_OUT} SELECT l_orderkey * 10 + f AS key, {r('(SELECT avg(a) FROM m) + x * (SELECT avg(b) FROM m)', 5)} AS pred FROM l""",
)
def ensemble_predict(spark, sf_dir):
    rows = lines(spark, sf_dir)
    grams = linear.collect_grams(linear.gram(rows, ["l_quantity"], Y, ["l_linenumber"]), 2)
    result = linear.cross_validate_grams({fold: m for (fold,), m in grams.items()}, ["l_quantity"])
    return rounded(linear.predict_ensemble(rows, result.models), ["pred"], 5).select("key", "pred")


@query("kfold_cv", "M3 M4 M7")
def kfold_cv(spark, sf_dir):
    rows = lines(spark, sf_dir)
    return linear.cross_validate(rows, X, Y, "key", k=5, lam=0.05, method="hash").table(spark)


@query("kfold_stepwise", "M2 M3 M4")
def kfold_stepwise(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", pseudo_year("o_orderdate").cast("double").alias("year")
    )
    x = ["o_custkey", "year"]
    return linear.cross_validate(
        orders, x, "o_totalprice", "o_orderkey", k=5, rule=linear.Stepwise(), stratify="o_totalprice"
    ).table(spark)


@query("gbt_kfold", "M8 M5 A12")
def gbt_kfold(spark, sf_dir):
    predicted, _ = trees.gbt_kfold(lines(spark, sf_dir), X, Y, "key", k=10, fold_method="hash", partitions=8, maxIter=5)
    return predicted.select("key", Y, F.round("pred", 6).alias("pred"))


RATE, STEPS, PATIENCE, PENALTY = 0.3, 60, 8, 0.01


@query(
    "early_stopping",
    "M8 M4 A12",
    f"""WITH RECURSIVE l AS (SELECT l_linenumber AS fold, greatest(l_quantity - 20, 0) AS x, l_extendedprice * (1 - 4 * l_discount) / 1000 + 1000 * (l_linenumber = 7)::INT * (50 - l_quantity) AS y FROM lineitem),
    h AS (SELECT fold, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS c FROM l GROUP BY 1),
    t AS (SELECT h.fold, avg(l.x) AS tx, avg(l.y) AS ty, stddev_pop(l.x) AS sd, covar_pop(l.x, l.y) / stddev_pop(l.x) AS b FROM h JOIN l ON l.fold <> h.fold GROUP BY 1),
    w AS (SELECT fold, 0 AS step, 0.0::DOUBLE AS w FROM t
      UNION ALL SELECT w.fold, step + 1, w - {RATE} * (w - b + {PENALTY} * w) FROM w JOIN t USING (fold) WHERE step < {STEPS}),
    e AS (SELECT w.fold, step, vy - 2 * w / sd * c + pow(w / sd, 2) * vx + pow(my - ty - w / sd * (mx - tx), 2) AS mse FROM w JOIN t USING (fold) JOIN h USING (fold)),
    f AS (SELECT *, coalesce(min(mse) OVER (PARTITION BY fold ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1e300) AS before FROM e),
    g AS (SELECT *, max(CASE WHEN mse < before THEN step END) OVER (PARTITION BY fold ORDER BY step ROWS UNBOUNDED PRECEDING) AS best FROM f),
    z AS (SELECT fold, coalesce(min(CASE WHEN step - best >= {PATIENCE} THEN step END), {STEPS}) AS last_step FROM g GROUP BY 1)
    SELECT fold, g.best::INT AS best_step, last_step::INT AS last_step, {r('e.mse', 4)} AS mse FROM z JOIN g USING (fold) JOIN e USING (fold) WHERE g.step = last_step AND e.step = g.best""",
)
def early_stopping(spark, sf_dir):
    """A hinge of the quantity, one line number held out at a time; one of them goes another way than the rest, and stops at once."""
    rows = lines(spark, sf_dir).withColumn(Y, F.col(Y) + F.when(F.col("l_linenumber") == 7, 1000 * (50 - F.col("l_quantity"))).otherwise(0))
    basis = {k: v for k, v in gradient.hinges({"l_quantity": [20.0]}).items() if k != "l_quantity"}
    how = gradient.Descent(RATE, PENALTY, STEPS, PATIENCE)
    stopped, _ = gradient.early_stopped(rows, basis, Y, "key", how=how, fold="l_linenumber")
    return rounded(gradient.table(spark, stopped), ["mse"], 4)


@query("stopped_predictions", "M8 M5")
def stopped_predictions(spark, sf_dir):
    """Ten folds over hinges of three features, and the mean of their models."""
    rows = lines(spark, sf_dir)
    basis = gradient.hinges(gradient.quantile_knots(rows, X, 4))
    stopped, _ = gradient.early_stopped(rows, basis, Y, "key", k=10, method="hash")
    return gradient.predict_stopped(rows, basis, stopped).select("key", F.round("pred", 5).alias("pred"))


LAGGED = f"""d AS ({sql_daily()}), l AS (SELECT series, day, v, lag(v) OVER (PARTITION BY series ORDER BY day) AS lv FROM d),
  c AS (SELECT series, regr_slope(v, lv) AS b, regr_intercept(v, lv) AS a, max(day) AS last_day, arg_max(v, day) AS last,
    sqrt(regr_syy(v, lv) * (1 - regr_r2(v, lv)) / (regr_count(v, lv) - 2)) AS sigma FROM l GROUP BY 1),
  f AS (SELECT series, 1 AS step, a + b * last AS pred FROM c
    UNION ALL SELECT f.series, step + 1, c.a + c.b * f.pred FROM f JOIN c USING (series) WHERE step < 5)"""


@query(
    "ar_forecast",
    "M9",
    f"WITH RECURSIVE {LAGGED} SELECT series, last_day + step AS day, step, {r('pred', 5)} AS pred FROM f JOIN c USING (series)",
)
def ar_forecast(spark, sf_dir):
    ahead = forecast.ar_forecast(daily(spark, sf_dir), ["series"], "day", "v", 5, p_grid=(1,))
    return rounded(ahead, ["pred"], 5).withColumn("day", F.col("day").cast("bigint"))


@query(
    "forecast_interval",
    "M15",
    f"""WITH RECURSIVE {LAGGED}, s AS (SELECT *, 1.645 * sigma * sqrt((SELECT sum(pow(b, 2 * (k - 1))) FROM range(1, step + 1) AS t(k))) AS wide FROM f JOIN c USING (series))
    SELECT series, last_day + step AS day, {r('pred - wide', 5)} AS lo, {r('pred + wide', 5)} AS hi FROM s""",
)
def forecast_interval(spark, sf_dir):
    ahead = forecast.ar_forecast(daily(spark, sf_dir), ["series"], "day", "v", 5, p_grid=(1,), z=1.645)
    return rounded(ahead, ["lo", "hi"], 5).select("series", F.col("day").cast("bigint").alias("day"), "lo", "hi")


@query(
    "arx_forecast",
    "M10",
    f"""WITH d AS ({sql_daily()}), l AS (SELECT series, day, v AS y, lag(v) OVER (PARTITION BY series ORDER BY day) AS x1, (day % 7)::DOUBLE AS x2 FROM d),
    s AS (SELECT series, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12,
      covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y FROM l WHERE x1 IS NOT NULL GROUP BY 1),
    b AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM s),
    e AS (SELECT series, max(day) AS day, arg_max(v, day) AS last FROM d GROUP BY 1),
    f1 AS (SELECT series, e.day + 1 AS day, my - b1 * m1 - b2 * m2 + b1 * last + b2 * ((e.day + 1) % 7) AS pred FROM b JOIN e USING (series)),
    f2 AS (SELECT series, f1.day + 1 AS day, my - b1 * m1 - b2 * m2 + b1 * pred + b2 * ((f1.day + 1) % 7) AS pred FROM b JOIN f1 USING (series))
    SELECT series, day, {r('pred', 5)} AS pred FROM f1 UNION ALL SELECT series, day, {r('pred', 5)} FROM f2""",
)
def arx_forecast(spark, sf_dir):
    weekday = F.pmod(F.col("day"), F.lit(7)).cast("double")
    past = daily(spark, sf_dir).withColumn("weekday", weekday)
    ends = past.groupBy("series").agg(F.max("day").alias("end"))
    future = ends.select("series", F.explode(F.sequence(F.col("end") + 1, F.col("end") + 2)).alias("day"))
    ahead = forecast.ar_forecast(
        past, ["series"], "day", "v", 2, p_grid=(1,), exog=["weekday"], future=future.withColumn("weekday", weekday)
    )
    return rounded(ahead, ["pred"], 5).select("series", F.col("day").cast("bigint").alias("day"), "pred")


@query(
    "forecast_backtest",
    "M9 A12 W13",
    f"""WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day) - count(*) OVER (PARTITION BY series) + 3 AS step FROM ({sql_daily()})),
    l AS (SELECT series, day, v, lag(v) OVER (PARTITION BY series ORDER BY day) AS lv FROM d WHERE step <= 0),
    c AS (SELECT series, regr_slope(v, lv) AS b, regr_intercept(v, lv) AS a, arg_max(v, day) AS last FROM l GROUP BY 1),
    f AS (SELECT series, 1 AS step, a + b * last AS pred FROM c
      UNION ALL SELECT f.series, step + 1, c.a + c.b * f.pred FROM f JOIN c USING (series) WHERE step < 3)
    SELECT series, {r('avg(pow(v - pred, 2))')} AS mse, 0 AS origin FROM f JOIN d USING (series, step) GROUP BY 1""",
)
def forecast_backtest(spark, sf_dir):
    return rounded(forecast.backtest(daily(spark, sf_dir), ["series"], "day", "v", 3, p_grid=(1,)), ["mse"])


@query("ar_orders", "M9")
def ar_orders(spark, sf_dir):
    """Chosen order and coefficients for every user's daily series."""
    fits = forecast.fit_ar(daily(spark, sf_dir, "user_id"), ["series"], "day", "v", p_grid=(0, 1, 2, 3))
    return fits.select("series", "p", F.round("aicc", 4).alias("aicc"), "n", "last_key")


@query(
    "ar_order_choice",
    "M9",
    f"""WITH {LAGGED.split("f AS (")[0].rstrip().rstrip(",")},
    m AS (SELECT series, count(*) AS n, var_pop(v) * count(*) AS s0, var_pop(v) * count(*) * (1 - corr(v, lv) * corr(v, lv)) AS s1 FROM l WHERE lv IS NOT NULL GROUP BY 1),
    a AS (SELECT *, n * ln(s0 / n) + 4 + 12.0 / (n - 3) AS a0, n * ln(s1 / n) + 6 + 24.0 / (n - 4) AS a1 FROM m)
    SELECT series, (CASE WHEN a1 < a0 THEN 1 ELSE 0 END)::INT AS p, {r('least(a0, a1)', 4)} AS aicc, n FROM a""",
)
def ar_order_choice(spark, sf_dir):
    fits = forecast.fit_ar(daily(spark, sf_dir), ["series"], "day", "v", p_grid=(0, 1))
    return fits.select("series", "p", F.round("aicc", 4).alias("aicc"), "n")


def sql_two_features(source: str) -> str:
    """CTEs with the least squares of y on x1 and x2 per series of a table: c (constant), b1, b2, n and sigma in `b`."""
    return f"""s AS (SELECT series, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) AS s11, var_pop(x2) AS s22, var_pop(y) AS syy,
      covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y FROM {source} WHERE x1 IS NOT NULL AND x2 IS NOT NULL GROUP BY 1),
    k AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM s),
    b AS (SELECT series, b1, b2, my - b1 * m1 - b2 * m2 AS c, sqrt(n * (syy - b1 * s1y - b2 * s2y) / (n - 3)) AS sigma FROM k)"""


@query(
    "arima_forecast",
    "M9",
    f"""WITH RECURSIVE d AS ({sql_daily()}), w AS (SELECT series, day, v, v - lag(v) OVER (PARTITION BY series ORDER BY day) AS y FROM d),
    l AS (SELECT *, lag(y) OVER (PARTITION BY series ORDER BY day) AS x1, lag(y, 2) OVER (PARTITION BY series ORDER BY day) AS x2 FROM w), {sql_two_features('l')},
    e AS (SELECT series, max(day) AS day, arg_max(v, day) AS v, arg_max(y, day) AS w1, arg_max(x1, day) AS w2 FROM l GROUP BY 1),
    f AS (SELECT series, 0 AS step, day, v, w1, w2 FROM e
      UNION ALL SELECT f.series, step + 1, day + 1, v + c + b1 * w1 + b2 * w2, c + b1 * w1 + b2 * w2, w1 FROM f JOIN b USING (series) WHERE step < 4)
    SELECT series, day, step, {r('v', 4)} AS pred FROM f WHERE step > 0""",
)
def arima_forecast(spark, sf_dir):
    ahead = arima.arima_forecast(daily(spark, sf_dir), ["series"], "day", "v", 4, orders=[(2, 1, 0)])
    return rounded(ahead, ["pred"], 4).withColumn("day", F.col("day").cast("bigint"))


@query(
    "arma_interval",
    "M9 M15",
    f"""WITH RECURSIVE d AS ({sql_daily()}), l AS (SELECT series, day, v AS y, lag(v) OVER (PARTITION BY series ORDER BY day) AS x1 FROM d),
    a AS (SELECT series, regr_slope(y, x1) AS slope, regr_intercept(y, x1) AS inter FROM l WHERE x1 IS NOT NULL GROUP BY 1),
    e AS (SELECT l.*, y - inter - slope * x1 AS e FROM l JOIN a USING (series)),
    x AS (SELECT *, lag(e) OVER (PARTITION BY series ORDER BY day) AS x2 FROM e), {sql_two_features('x')},
    z AS (SELECT series, max(day) AS day, arg_max(y, day) AS v, arg_max(e, day) AS e FROM x GROUP BY 1),
    f AS (SELECT series, 1 AS step, day + 1 AS day, c + b1 * v + b2 * e AS pred, 1.0::DOUBLE AS weight, 1.0::DOUBLE AS total FROM z JOIN b USING (series)
      UNION ALL SELECT f.series, step + 1, day + 1, c + b1 * pred, weight * CASE WHEN step = 1 THEN b1 + b2 ELSE b1 END,
        total + pow(weight * CASE WHEN step = 1 THEN b1 + b2 ELSE b1 END, 2) FROM f JOIN b USING (series) WHERE step < 4)
    SELECT series, day, {r('pred', 4)} AS pred, {r('pred - 1.645 * sigma * sqrt(total)', 4)} AS lo, {r('pred + 1.645 * sigma * sqrt(total)', 4)} AS hi FROM f JOIN b USING (series)""",
)
def arma_interval(spark, sf_dir):
    ahead = arima.arima_forecast(daily(spark, sf_dir), ["series"], "day", "v", 4, orders=[(1, 0, 1)], long_ar=1, z=1.645)
    return rounded(ahead, ["pred", "lo", "hi"], 4).select("series", F.col("day").cast("bigint").alias("day"), "pred", "lo", "hi")


@query("arima_orders", "M9")
def arima_orders(spark, sf_dir):
    """Orders of every user's daily series among those with a difference and with moving averages."""
    grid = [(p, d, q) for d in (0, 1) for p in (0, 1, 2) for q in (0, 1)]
    fits = arima.fit_arima(daily(spark, sf_dir, "user_id"), ["series"], "day", "v", grid, long_ar=4)
    return fits.select("series", "p", "d", "q", F.round("aicc", 4).alias("aicc"), "n", "last_key")


SEARCH = search.SearchConfig(fold_method="hash")


JUDGED = [((1, 0, 0), 0.05), ((0, 1, 0), 0.2), ((1, 1, 0), 0.01), ((1, 0, 1), 0.2), ((0, 1, 1), 0.0)]


def sql_candidate(mask: tuple[int, ...], lam: float) -> str:
    """A candidate's key and its mean held-out error over line numbers, by the closed form of ridge regression on one or two features."""
    used = [i + 1 for i, bit in enumerate(mask) if bit]
    if len(used) == 1:
        (i,) = used
        coefs = {i: f"c{i}y / (s{i} * s{i}) / (1 + {lam})"}
    else:
        i, j = used
        det = f"((1 + {lam}) * (1 + {lam}) - r{i}{j} * r{i}{j})"
        coefs = {a: f"((1 + {lam}) * c{a}y / s{a} - r{i}{j} * c{b}y / s{b}) / {det} / s{a}" for a, b in ((i, j), (j, i))}
    pred = "my + " + " + ".join(f"{c} * (x{i} - m{i})" for i, c in coefs.items())
    key = f"mask_{''.join(map(str, mask))}_lam_{lam}"
    return f"SELECT '{key}' AS key, avg(e) + {0.001 * len(used)} AS fitness FROM (SELECT f, avg(pow(y - ({pred}), 2)) AS e FROM l JOIN t USING (f) GROUP BY f)"


_STATS = ", ".join(
    [f"avg(l.x{i}) AS m{i}, stddev_pop(l.x{i}) AS s{i}, covar_pop(l.x{i}, l.y) AS c{i}y" for i in (1, 2, 3)] + [f"corr(l.x{i}, l.x{j}) AS r{i}{j}" for i, j in ((1, 2), (1, 3), (2, 3))]
)


@query(
    "candidate_scores",
    "M11 M12",
    f"""WITH l AS (SELECT l_linenumber AS f, l_quantity AS x1, l_discount AS x2, l_tax AS x3, l_extendedprice * (1 - 4 * l_discount) / 1000 AS y FROM lineitem),
    t AS (SELECT h.f, avg(l.y) AS my, {_STATS} FROM (SELECT DISTINCT f FROM l) h JOIN l ON l.f <> h.f GROUP BY h.f)
    SELECT key, {r('fitness', 4)} AS fitness FROM ({' UNION ALL '.join(sql_candidate(*c) for c in JUDGED)})""",
)
def candidate_scores(spark, sf_dir):
    """How the search judges candidates, with the line numbers as folds, so that SQL can do the same."""
    grams = linear.collect_grams(linear.gram(lines(spark, sf_dir), X, Y, ["l_linenumber"]), len(X) + 1)
    folds = {fold: m for (fold,), m in grams.items()}
    judged = [search.Candidate(mask, lam) for mask, lam in JUDGED]
    rows = [(c.key, search.score(c, folds, X, 0.001)) for c in judged]
    return rounded(spark.createDataFrame(rows, "key string, fitness double"), ["fitness"], 4)


@query(
    "fitness_by_generation",
    "M14 R7",
    "SELECT (o_orderkey % 23 - 2)::INT AS generation, min(o_totalprice) AS fitness FROM orders WHERE o_orderkey % 23 >= 2 GROUP BY 1",
)
def fitness_by_generation(spark, sf_dir):
    """The chart of a search, of a history with the entries that are no part of it."""
    history = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 23 - 2).cast("int").alias("generation"), F.col("o_totalprice").alias("fitness"))
    return report.fitness_by_generation(history)


@query("candidate_search", "M11 M12 O2")
def candidate_search(spark, sf_dir):
    _, history = search.search(lines(spark, sf_dir), X, Y, "key", SEARCH)
    return history


@query("search_progress", "M14 R7")
def search_progress(spark, sf_dir):
    _, history = search.search(lines(spark, sf_dir), X, Y, "key", SEARCH)
    return search.progress(history)


@query("linear_predictions", "M2 M4 M5 C14")
def linear_predictions(spark, sf_dir):
    return modeling.linear_predictions(training(spark, sf_dir), CONFIG)[0]


@query("forecast_predictions", "M9 M10")
def forecast_predictions(spark, sf_dir):
    return modeling.forecast_predictions(training(spark, sf_dir), CONFIG, exogenous=True)
