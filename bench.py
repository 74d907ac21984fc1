"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
data and threads. Every query runs once to warm up the session, then once timed,
definition and execution together, into a sink that discards the rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

from envspark.catalog import QUERIES
from envspark.session import build_session

HEADLINE = [
    "io1_parquet_scan",
    "f22_censored_values",
    "f7_classes",
    "pf14_fill_with_mean",
    "j1_left_join",
    "j9_nearest_station",
    "j10_asof_backward",
    "j11_asof_with_fallback",
    "j13_nearest_value",
    "j15_default_station",
    "j16_cohort",
    "ag1_group_statistics",
    "ag9_profile_numbers",
    "ag12_box_statistics",
    "ag14_correlations",
    "ag15_linear_trend",
    "w1_phase_features",
    "w3_rolling_sum",
    "w4_impute_group_mean",
    "w6_top_k_with_ties",
    "rs2_long_to_wide",
    "rs6_densify",
    "in2_missing_keys",
    "ml1_stratified_split",
    "ml10_roc_curve",
    "ml12_metrics",
    "ml17_model_per_group",
    "q1_clean_samples",
    "q4_station_key",
    "q10_tide_positions",
    "q11_rain_for_samples",
    "q13_model_table",
    "q15_typed_subset",
    "q19_dirtiest_sites",
    "q20_cohort_trend",
    "q25_model_features",
]


def run(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run(spark, sf_dir, name)
        seconds[name] = round(run(spark, sf_dir, name), 3)
    spark.stop()
    print(json.dumps({"metric": "total wall time of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
