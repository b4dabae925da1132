"""Building the star schema from raw measurements that are derived from the test tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from catalog.common import Registry, days, r, rounded, sql_days, sql_interpolate, sql_tiered, table
from epochline.functions.bins import tiered_bin
from epochline.operators.series import make_spine
from epochline.plans import star_build as B

QUERIES = Registry()
query = QUERIES.query


def raw_inputs(spark, sf_dir) -> B.RawInputs:
    """Records from the embeddings, a monthly grid and climatology from the shipments, series from both."""
    lineitem, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    label = F.col("label").cast("double")
    records = table(spark, sf_dir, "embeddings").select(
        F.transform("embedding", lambda _, i: (i * 150 - 80).cast("double") + label * 40).alias("age"),
        F.transform("embedding", lambda x: x.cast("double") * 20).alias("paleoData_values"),
        (label * 2 - 6).alias("geo_meanLat"),
        (label * 4 - 10.2).alias("geo_meanLon"),
        F.when(label == 3, "kelvin").otherwise("degC").alias("paleoData_units"),
        F.lit(None).cast("string").alias("paleoData_useInGlobalTemperatureAnalysis"),
        F.lit(None).cast("string").alias("paleoData_QCnotes"),
        F.when(label == 5, "T anomalies").alias("paleoData_description"),
        F.when(label == 2, "summer").alias("paleoData_habitatSeason"),
        F.array(F.struct(F.when(label == 1, "Winter").alias("seasonality"))).alias("paleoData_interpretation"),
        "vec_id",
    )
    shipped = lineitem.select(
        "*",
        (F.pmod("l_suppkey", F.lit(10)) * 2 - 6).cast("bigint").alias("geo_meanLat"),
        (F.pmod("l_suppkey", F.lit(10)) * 4 - 10).cast("bigint").alias("geo_meanLon"),
        days("l_shipdate", "1995-01-01").alias("month"),
    )
    mean = F.avg("l_quantity")
    year, price = (days("o_orderdate", "2001-01-01") * 400).cast("double").alias("year"), F.col("o_totalprice")
    shipped_year = (days("l_shipdate", "2001-01-01") * 400).cast("double").alias("year")
    return B.RawInputs(
        samples=records,
        grid=shipped.groupBy("month", *B.CELL).agg(F.when(mean <= 35, mean / 50).alias("anomaly")),
        climatology=shipped.groupBy((F.month("l_shipdate") - 1).alias("month_idx"), *B.CELL).agg(F.sqrt(mean).alias("climate")),
        orbital=orders.select(
            year,
            F.ln(price).alias("eccentricity"),
            F.sqrt("o_custkey").alias("obliquity"),
            F.sqrt("o_orderkey").alias("perihelion"),
            F.sqrt(price).alias("insolation"),
            (price / 1000).alias("global_insolation"),
        ),
        ice_co2=orders.select(year, (180 + F.sqrt(price) / 10).alias("co2_ppm")),
        modern_co2=table(spark, sf_dir, "part")
        .groupBy((1979 + F.col("p_size")).alias("year_bin"))
        .agg(F.avg(F.sqrt("p_retailprice")).alias("co2_ppm")),
        sediment=lineitem.select(shipped_year, F.ln("l_extendedprice").alias("be_ppm")),
        field=lineitem.select(shipped_year, (F.ln("l_quantity") - 3).alias("VADM")),
    )


_ORDER_YEAR = f"{sql_days('o_orderdate', '2001-01-01')} * 400"
_SHIP_YEAR = f"{sql_days('l_shipdate', '2001-01-01')} * 400"
_CELLS = "(l_suppkey % 10) * 2 - 6 AS lat, (l_suppkey % 10) * 4 - 10 AS lon"
SAMPLE_CTES = f"""rec AS (SELECT *, row_number() OVER (ORDER BY vec_id) AS sample_id, label::DOUBLE AS l, label = 5 AS is_anomaly,
    label * 2 - 6 AS lat, label * 4 - 10 AS lon, CASE label WHEN 1 THEN 0 WHEN 2 THEN 6 END AS month_idx,
    -80 + label * 40 + greatest(0, -50 - (-80 + label * 40)) AS a0 FROM embeddings WHERE label <> 3),
  heads AS (SELECT *, 1950 - a0 AS newest_year, greatest(1950 - a0, 1850) AS at_year FROM rec),
  grid AS (SELECT {sql_days('l_shipdate', '1995-01-01')} AS month, {_CELLS}, CASE WHEN avg(l_quantity) <= 35 THEN avg(l_quantity) / 50 END AS anomaly
    FROM lineitem GROUP BY ALL),
  clim AS (SELECT month(l_shipdate) - 1 AS month_idx, {_CELLS}, sqrt(avg(l_quantity)) AS climate FROM lineitem GROUP BY ALL),
  yearly AS (SELECT lat, lon, avg(climate) AS of_year FROM clim GROUP BY 1, 2),
  probes AS (SELECT sample_id, lat, lon, at_year, m AS month_idx FROM heads, (SELECT unnest(range(0, 12)) AS m)
    WHERE NOT is_anomaly AND newest_year > 0 AND (newest_year < 1850 OR month_idx IS NULL OR month_idx = m)),
  found AS (SELECT p.sample_id, p.month_idx, arg_min(g.anomaly, g.month) AS v FROM probes p
    LEFT JOIN grid g ON g.lat = p.lat AND g.lon = p.lon AND g.month % 12 = p.month_idx AND g.anomaly IS NOT NULL
      AND 1850 + g.month // 12 >= p.at_year AND (1850 + g.month // 12 - p.at_year) % 10 = 0 GROUP BY 1, 2),
  modern AS (SELECT sample_id, avg(v) AS reference FROM found GROUP BY 1),
  based AS (SELECT h.*, CASE WHEN h.month_idx IS NULL THEN of_year ELSE clim.climate END AS climate,
      CASE WHEN is_anomaly THEN 0 ELSE reference END AS reference
    FROM heads h LEFT JOIN clim ON clim.lat = h.lat AND clim.lon = h.lon AND clim.month_idx = h.month_idx
    LEFT JOIN yearly y ON y.lat = h.lat AND y.lon = h.lon LEFT JOIN modern USING (sample_id)),
  pairs AS (SELECT *, unnest(range(0, len(embedding))) AS i FROM based WHERE climate IS NOT NULL AND reference IS NOT NULL),
  proxies AS (SELECT sample_id, (newest_year - 150 * i)::BIGINT AS year,
      embedding[i + 1]::DOUBLE * 20 - embedding[1]::DOUBLE * 20 + reference AS anomaly,
      climate + (embedding[i + 1]::DOUBLE * 20 - embedding[1]::DOUBLE * 20 + reference) AS degc, lat, lon FROM pairs)"""
GRID_CTES = """gfill AS (SELECT month, lat, lon, first_value(anomaly IGNORE NULLS) OVER (PARTITION BY lat, lon, month % 24 ORDER BY month
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS anomaly FROM grid),
  gyear AS (SELECT lat, lon, (1850 + month // 12)::BIGINT AS year, avg(anomaly) AS anomaly FROM gfill GROUP BY 1, 2, 3),
  gid AS (SELECT lat, lon, of_year, row_number() OVER (ORDER BY lat, lon) AS n FROM yearly)"""


@query(
    "sample_temperatures",
    "S9 P21 P22 P23 W9 W10 W11 J7 J8",
    f"""WITH {SAMPLE_CTES} SELECT sample_id, year, {r('degc', 5)} AS "degC", {r('anomaly', 5)} AS anomaly, lat AS "geo_meanLat", lon AS "geo_meanLon" FROM proxies""",
)
def sample_temperatures(spark, sf_dir):
    inputs = raw_inputs(spark, sf_dir)
    placed, _ = B.prepare_samples(inputs.samples, ["vec_id"])
    rows, _ = B.sample_temperatures(placed, inputs.grid, inputs.climatology)
    return rounded(rows, ["degC", "anomaly"], 5)


@query(
    "grid_temperatures",
    "S10 W6 P24 A2 A10 J1 J2 W8",
    f"""WITH {SAMPLE_CTES}, {GRID_CTES} SELECT n + 1000 AS sample_id, year, {r('of_year + anomaly', 5)} AS "degC", {r('anomaly', 5)} AS anomaly,
      lat AS "geo_meanLat", lon AS "geo_meanLon" FROM gyear JOIN gid USING (lat, lon)""",
)
def grid_temperatures(spark, sf_dir):
    inputs = raw_inputs(spark, sf_dir)
    return rounded(B.grid_temperatures(inputs.grid, inputs.climatology, 1000), ["degC", "anomaly"], 5)


def _spine(spark, sf_dir):
    rows = [
        table(spark, sf_dir, name).select(tiered_bin(days(date, "2001-01-01") * 400).alias("year_bin"))
        for name, date in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"))
    ]
    return make_spine(*rows, key="year_bin")


_SPINE = f"(SELECT {sql_tiered(_ORDER_YEAR)} AS year_bin FROM orders UNION SELECT {sql_tiered(_SHIP_YEAR)} FROM lineitem)"


def _binned(source: str, year: str, expr: str, name: str) -> str:
    inner = f"SELECT {sql_tiered(year)} AS year_bin, avg({expr}) AS {name} FROM {source} GROUP BY 1"
    return sql_interpolate(f"SELECT year_bin, {name} FROM {_SPINE} LEFT JOIN ({inner}) USING (year_bin)", "year_bin", [name], edges="fill")


@query(
    "co2_series",
    "C3 A5 P19 P8 U1",
    f"""WITH ice AS ({_binned('orders', _ORDER_YEAR, '180 + sqrt(o_totalprice) / 10', 'c')}),
    modern AS (SELECT (1979 + p_size)::BIGINT AS year_bin, avg(sqrt(p_retailprice)) AS c FROM part GROUP BY 1
      UNION ALL SELECT 2024, 424.61::DOUBLE),
    merged AS (SELECT year_bin, CASE WHEN year_bin <= 2025 THEN c END AS c FROM ice WHERE year_bin NOT IN (SELECT year_bin FROM modern)
      UNION ALL SELECT year_bin, max_by(c, struct_pack(c := c)) FROM modern GROUP BY 1)
    SELECT year_bin, {r('c')} AS co2_ppm, {r('5.35 * ln(c / 228)')} AS co2_radiative_forcing FROM merged""",
)
def co2_series(spark, sf_dir):
    inputs = raw_inputs(spark, sf_dir)
    co2 = B.co2_series(inputs.ice_co2, inputs.modern_co2, _spine(spark, sf_dir))
    return rounded(co2, ["co2_ppm", "co2_radiative_forcing"])


@query(
    "cosmic_series",
    "C1 C4 C5 P20 P26 J3",
    f"""WITH b AS (SELECT year_bin, CASE WHEN year_bin <= 2025 THEN q END AS q FROM ({_binned('lineitem', _SHIP_YEAR, 'ln(l_extendedprice)', 'q')})),
    v AS (SELECT year_bin, CASE WHEN year_bin <= 2025 THEN abs(m) END AS m FROM ({_binned('lineitem', _SHIP_YEAR, 'ln(l_quantity) - 3', 'm')}))
    SELECT year_bin, {r('q')} AS be_ppm, {r('m')} AS "VADM", {r('1 / (0.7476 + 0.2458 * ((2.347 + m) / (1.077 + 2.274 * m)) / q) - 0.7476')} AS solar_modulation
    FROM b LEFT JOIN v USING (year_bin)""",
)
def cosmic_series(spark, sf_dir):
    inputs = raw_inputs(spark, sf_dir)
    cosmic = B.cosmic_series(inputs.sediment, inputs.field, _spine(spark, sf_dir))
    return rounded(cosmic, ["be_ppm", "VADM", "solar_modulation"])


@query(
    "doubtful_temperatures",
    "W11 P21",
    f"""WITH {SAMPLE_CTES}, ends AS (SELECT *, embedding[len(embedding)]::DOUBLE * 200 - embedding[1]::DOUBLE * 200 + reference AS last FROM based),
    u AS (SELECT *, unnest(range(0, len(embedding))) AS i FROM ends),
    v AS (SELECT sample_id, (newest_year - 150 * i)::BIGINT AS year, embedding[i + 1]::DOUBLE * 200 - embedding[1]::DOUBLE * 200 + reference AS anomaly, climate, abs(last) > 20 AS extreme, lat, lon FROM u)
    SELECT sample_id, year, {r('climate + anomaly', 5)} AS "degC", {r('anomaly', 5)} AS anomaly, lat AS "geo_meanLat", lon AS "geo_meanLon",
      CASE WHEN climate + anomaly IS NULL THEN 'no baseline' ELSE 'extreme' END AS reason FROM v WHERE climate + anomaly IS NULL OR extreme""",
)
def doubtful_temperatures(spark, sf_dir):
    """What the build leaves out or doubts, with the reason, as the flow writes it beside the tables; here of wider swings."""
    left, inputs = {}, raw_inputs(spark, sf_dir)
    wider = inputs.samples.withColumn("paleoData_values", F.transform("paleoData_values", lambda x: x * 10))
    B.build_star(replace(inputs, samples=wider), ["vec_id"], left=left)
    return rounded(left["doubtful_temperatures"], ["degC", "anomaly"], 5)


@query(
    "star_build_facts",
    "C1 C6 A6 W8 U1",
    f"""WITH {SAMPLE_CTES}, {GRID_CTES},
    q AS (SELECT quantile_cont(degc, 0.25) AS q1, quantile_cont(degc, 0.75) AS q3 FROM proxies),
    rows_ AS (SELECT sample_id, year, degc, anomaly FROM proxies, q WHERE degc BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)
      UNION ALL SELECT n + (SELECT max(sample_id) FROM proxies), year, of_year + anomaly, anomaly FROM gyear JOIN gid USING (lat, lon)),
    o AS (SELECT *, row_number() OVER (ORDER BY year, sample_id, degc NULLS FIRST, anomaly NULLS FIRST) AS temperature_id FROM rows_)
    SELECT temperature_id, {sql_tiered('year')} AS time_id, sample_id, {r('degc', 5)} AS "degC", {r('anomaly', 5)} AS anomaly FROM o""",
)
def star_build_facts(spark, sf_dir):
    """Every fact of the star schema with its ids and values."""
    facts = B.build_star(raw_inputs(spark, sf_dir), ["vec_id"])["fact_temperature"]
    return rounded(facts, ["degC", "anomaly"], 5)


@query(
    "star_build_dimensions",
    "C1 C2 C3 C4 C6 C7 U3",
    f"""WITH {SAMPLE_CTES}, {GRID_CTES}, q AS (SELECT quantile_cont(degc, 0.25) AS q1, quantile_cont(degc, 0.75) AS q3 FROM proxies),
    f AS (SELECT DISTINCT {sql_tiered('year')} AS year_bin FROM (SELECT year FROM proxies, q WHERE degc BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) UNION ALL SELECT year FROM gyear)),
    g AS (SELECT {sql_tiered(_ORDER_YEAR)} AS year_bin, avg(ln(o_totalprice)) AS e, avg(sqrt(o_totalprice)) AS i FROM orders GROUP BY 1),
    w AS (SELECT year_bin, e, i FROM (SELECT year_bin FROM f UNION SELECT year_bin FROM g) LEFT JOIN g USING (year_bin))
    SELECT year_bin AS time_id, {r('e', 5)} AS eccentricity, {r('i', 5)} AS insolation, year_bin FROM ({sql_interpolate('SELECT * FROM w', 'year_bin', ['e', 'i'], edges='fill')})""",
)
def star_build_dimensions(spark, sf_dir):
    """The orbital dimension on the whole axis, joined to the times that the build knows."""
    tables = B.build_star(raw_inputs(spark, sf_dir), ["vec_id"])
    orbital = tables["dim_orbital"].select("time_id", "eccentricity", "insolation")
    return rounded(orbital.join(tables["dim_time"].select("time_id", "year_bin"), "time_id"), ["eccentricity", "insolation"], 5)


@query(
    "star_build",
    "C1 C2 C6 C7 J3 A6 W8 U1 U2 U3 U4",
    f"""WITH {SAMPLE_CTES}, {GRID_CTES},
    q AS (SELECT quantile_cont(degc, 0.25) AS q1, quantile_cont(degc, 0.75) AS q3 FROM proxies),
    rows_ AS (SELECT sample_id, year, lat, lon FROM proxies, q WHERE degc BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)
      UNION ALL SELECT n + (SELECT max(sample_id) FROM proxies), year, lat, lon FROM gyear JOIN gid USING (lat, lon)),
    fact AS (SELECT *, {sql_tiered('year')} AS time_id FROM rows_),
    orb AS (SELECT time_id FROM fact UNION SELECT {sql_tiered(_ORDER_YEAR)} FROM orders)
    SELECT 'fact_temperature' AS name, time_id, count(*) AS n FROM fact GROUP BY 2
    UNION ALL SELECT 'dim_time', time_id, 1 FROM orb UNION ALL SELECT 'dim_orbital', time_id, 1 FROM orb
    UNION ALL SELECT 'dim_atmosphere', time_id, 1 FROM (SELECT DISTINCT time_id FROM fact)
    UNION ALL SELECT 'dim_cosmic', time_id, 1 FROM (SELECT DISTINCT time_id FROM fact)
    UNION ALL SELECT 'dim_location', NULL, count(*) FROM (SELECT DISTINCT sample_id, lat, lon FROM fact)""",
)
def star_build(spark, sf_dir):
    """All six tables from raw measurements; the result is the rows per table and time."""
    tables = B.build_star(raw_inputs(spark, sf_dir), ["vec_id"])
    counted = None
    for name, df in tables.items():
        by = F.col("time_id") if "time_id" in df.columns else F.lit(None).cast("bigint")
        rows = df.groupBy(F.lit(name).alias("name"), by.alias("time_id")).agg(F.count(F.lit(1)).alias("n"))
        counted = rows if counted is None else counted.unionByName(rows)
    return counted
