"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the folder with the tables, BENCH_CPUS the number of local threads, BENCH_RUNS how
often each query runs (the best time counts), BENCH_QUERIES a comma-separated choice of queries.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from catalog import all_queries
from epochline.session import build_session

HEADLINE = """
tiered_bin fixed_bin_mean_all derived_forcing modulation missing_rules season_lookup squared_features
chained_left_joins star_join right_join_future_keys anti_split forward_lookup nearest_lookup interval_label_sessions
priority_merge iqr_filter iqr_bounds_nearest standard_scale minmax_scale trend_by_segment weighted_mean unpivot_long repair_shifted
lag_features event_gaps rolling_events interpolate_rows stride_fill dense_id rebase_first chrono_split
fact_ids price_changes bin_and_fill gapfill_by_series multi_source_merge star_split raw_view training_view
ols_gram kfold_cv ensemble_predict gbt_kfold ar_forecast arx_forecast candidate_search
report_glacial_cycles report_predictor_trends
""".split()


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = os.environ.get("BENCH_QUERIES")
    queries = all_queries()
    wanted = chosen.split(",") if chosen else HEADLINE
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times = {}
    for name in wanted:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            queries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(f"{name}: {best:.3f}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    result = {
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(scale.group(1)) if scale else None,
    }
    print(json.dumps(result))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
