"""The analytical views, on a star schema derived from the order and shipping tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import Registry, days, sql_days, sql_interpolate, sql_tiered, table
from epochline.functions.bins import tiered_bin
from epochline.functions.derive import radiative_forcing, solar_modulation
from epochline.plans import views
from epochline.plans.config import FlowConfig

QUERIES = Registry()
query = QUERIES.query

CONFIG = FlowConfig()


def _time(date):
    return tiered_bin(days(date, "2001-01-01") * 400)


def star_from_tables(spark, sf_dir):
    """Shipments are the facts; orders and shipments per time give the dimensions."""
    lineitem, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    shipped, ordered = lineitem.withColumn("time_id", _time("l_shipdate")), orders.withColumn("time_id", _time("o_orderdate"))
    fact = shipped.select("time_id", (F.sqrt("l_quantity") - 5).alias("anomaly"))
    times = shipped.select("time_id").union(ordered.select("time_id")).distinct()
    price = F.avg("o_totalprice")
    atmosphere = ordered.groupBy("time_id").agg((180 + F.sqrt(price)).alias("co2_ppm"))
    cosmic = shipped.where(F.col("time_id") <= 2025).groupBy("time_id").agg(
        F.ln(F.avg("l_extendedprice")).alias("be_ppm"), F.sqrt(F.avg("l_partkey")).alias("VADM")
    )
    return fact, {
        "dim_time": times.withColumn("year_bin", F.col("time_id")),
        "dim_atmosphere": atmosphere.withColumn("co2_radiative_forcing", radiative_forcing(F.col("co2_ppm"))),
        "dim_orbital": ordered.groupBy("time_id").agg(
            F.ln(price).alias("eccentricity"),
            F.sqrt(F.avg("o_custkey")).alias("obliquity"),
            F.ln(1 + F.avg("o_orderkey")).alias("perihelion"),
            F.sqrt(F.count(F.lit(1))).alias("insolation"),
            F.sqrt(F.max("o_totalprice")).alias("global_insolation"),
        ),
        "dim_cosmic": cosmic.withColumn("solar_modulation", solar_modulation(F.col("be_ppm"), F.col("VADM"))),
    }


def base(spark, sf_dir):
    return views.joined_base(*star_from_tables(spark, sf_dir), CONFIG)


MEASURES = [
    "anomaly",
    "co2_ppm",
    "co2_radiative_forcing",
    "eccentricity",
    "obliquity",
    "perihelion",
    "insolation",
    "global_insolation",
    "be_ppm",
    "VADM",
    "solar_modulation",
]
_YEAR = "{} * 400"
BASE_CTES = f"""f AS (SELECT {sql_tiered(sql_days('l_shipdate', '2001-01-01') + ' * 400')} AS time_id, * FROM lineitem),
o AS (SELECT {sql_tiered(sql_days('o_orderdate', '2001-01-01') + ' * 400')} AS time_id, * FROM orders),
t AS (SELECT time_id FROM f UNION SELECT time_id FROM o),
fa AS (SELECT time_id, avg(sqrt(l_quantity) - 5) AS anomaly FROM f GROUP BY 1),
at0 AS (SELECT time_id, 180 + sqrt(avg(o_totalprice)) AS c FROM o GROUP BY 1),
at1 AS (SELECT time_id, round(c, 5) AS co2_ppm, round(5.35 * ln(c / 228), 5) AS co2_radiative_forcing FROM at0),
orb AS (SELECT time_id, round(ln(avg(o_totalprice)), 5) AS eccentricity, round(sqrt(avg(o_custkey)), 5) AS obliquity,
  round(ln(1 + avg(o_orderkey)), 5) AS perihelion, round(sqrt(count(*)), 5) AS insolation,
  round(sqrt(max(o_totalprice)), 5) AS global_insolation FROM o GROUP BY 1),
co0 AS (SELECT time_id, ln(avg(l_extendedprice)) AS q, sqrt(avg(l_partkey)) AS m FROM f WHERE time_id <= 2025 GROUP BY 1),
co1 AS (SELECT time_id, round(q, 5) AS be_ppm, round(m, 5) AS "VADM",
  round(1 / (0.7476 + 0.2458 * ((2.347 + m) / (1.077 + 2.274 * m)) / q) - 0.7476, 5) AS solar_modulation FROM co0),
base AS (SELECT t.time_id AS year_bin, {', '.join(MEASURES)} FROM t LEFT JOIN fa USING (time_id) LEFT JOIN at1 USING (time_id)
  LEFT JOIN orb USING (time_id) LEFT JOIN co1 USING (time_id))"""


def _scaled(source: str, cols: list[str], keep: list[str], stats: str, places: int | None = None) -> str:
    """Scaled columns over `source` with the statistics of `stats`."""
    aggregates = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in cols)

    def line(c):
        value = f"(({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END)"
        return f"{value} AS {c}" if places is None else f"(round({value}, {places}) + 0.0) AS {c}"

    kept = [c if places is None or c == "year_bin" else f"(round({c}, {places}) + 0.0) AS {c}" for c in keep]
    return f"SELECT {', '.join(kept + [line(c) for c in cols])} FROM {source}, (SELECT {aggregates} FROM {stats})"


RAW_KEPT = ["year_bin", "anomaly", "co2_ppm"]
RAW_SQL = _scaled("base", [c for c in MEASURES if c not in RAW_KEPT], RAW_KEPT, "base", 5)


@query("raw_view", "C8 J4 J5 A1 C12 P14", f"WITH {BASE_CTES} {RAW_SQL}")
def raw_view(spark, sf_dir):
    return views.raw_view(base(spark, sf_dir), CONFIG)


LAGGED = [(c, k) for c in CONFIG.lagged for k in CONFIG.lags]
DELTAS = [f"delta_{c}" for c in MEASURES]
_W = "OVER (ORDER BY year_bin)"
_SMOOTH = "OVER (ORDER BY year_bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"
_PLAIN = [c for c in MEASURES if c != "solar_modulation"]
_WIDE = (
    ["anomaly"]
    + [c for c in MEASURES + DELTAS if c != "anomaly"]
    + [f"{c}_lagged_{k}" for c, k in LAGGED]
    + [f"{c}_squared" for c in MEASURES + DELTAS if c != "anomaly"]
)
RESAMPLED_CTES = f"""{BASE_CTES},
b0 AS (SELECT (floor(year_bin / 2000.0) * 2000)::BIGINT AS yb, {', '.join(MEASURES)} FROM base),
b AS (SELECT yb AS year_bin, {', '.join(f'avg({c}) AS {c}' for c in MEASURES)} FROM b0 GROUP BY 1),
sm AS (SELECT year_bin, {', '.join(_PLAIN)}, CASE WHEN count(solar_modulation) {_SMOOTH} = 3 THEN avg(solar_modulation) {_SMOOTH} END AS solar_modulation FROM b),
tr AS (SELECT * FROM sm WHERE year_bin >= (SELECT min(year_bin) - 2000 FROM sm WHERE year_bin % 50000 <> 0)),
de AS (SELECT *, {', '.join(f'{c} - CASE WHEN row_number() {_W} = 1 THEN {c} ELSE lag({c}) {_W} END AS delta_{c}' for c in MEASURES)} FROM tr),
pad AS (SELECT * FROM de UNION ALL SELECT year_bin, {', '.join(MEASURES)}, {', '.join(f'CASE WHEN i > 1 THEN {c} END' for c in DELTAS)}
  FROM (SELECT * FROM de ORDER BY year_bin LIMIT 1), (SELECT unnest(range(1, 51)) AS i)),
sc AS ({_scaled('de', [c for c in MEASURES + DELTAS if c != 'anomaly'], ['year_bin', 'anomaly'], 'pad')}),
la AS (SELECT *, {', '.join(f'CASE WHEN row_number() {_W} <= {k} THEN first_value({c}) {_W} ELSE lag({c}, {k}) {_W} END AS {c}_lagged_{k}' for c, k in LAGGED)} FROM sc),
wi AS (SELECT *, {', '.join(f'{c} * {c} AS {c}_squared' for c in MEASURES + DELTAS if c != 'anomaly')} FROM la),
fi AS ({sql_interpolate('SELECT * FROM wi WHERE year_bin < 2025', 'year_bin', _WIDE)}
  UNION ALL SELECT year_bin, {', '.join(_WIDE)} FROM wi WHERE year_bin >= 2025)"""


def _shown(cols: list[str]) -> str:
    return ", ".join(["year_bin"] + [f"(round({c}, 5) + 0.0) AS {c}" for c in cols])


@query("resampled_view", "C9 C11 P17 A3 W1 W2 W3 W7 P25", f"WITH {RESAMPLED_CTES} SELECT {_shown(_WIDE)} FROM fi")
def resampled_view(spark, sf_dir):
    return views.resampled_view(base(spark, sf_dir), CONFIG)


def training(spark, sf_dir, fill=None):
    return views.training_view(resampled_view(spark, sf_dir), CONFIG, fill)


_TRAINING = [c for c in _WIDE if not any(d in c for d in CONFIG.dropped) and c != "anomaly"]


@query(
    "training_view",
    "C10 P4 P10 P13",
    f"""WITH {RESAMPLED_CTES} SELECT {_shown(_TRAINING)}, coalesce(round(anomaly, 5) + 0.0, 0) AS anomaly FROM fi WHERE year_bin >= -740000""",
)
def training_view(spark, sf_dir):
    return training(spark, sf_dir, fill=0.0)


@query("long_term_view", "C9 P4", f"WITH {RESAMPLED_CTES} SELECT {_shown(MEASURES)} FROM fi")
def long_term_view(spark, sf_dir):
    return views.long_term_view(resampled_view(spark, sf_dir))
