"""Headline benchmark: prints one JSON line with seconds per query.

Reads ``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and runs on
``local[BENCH_CPUS]``. Every query is materialized in full through a noop sink. ``queries``
and ``value`` are cold: the first run of a query, with the time to build its plan, and no
remembered key profiles. ``warm`` are the times of a second run.
"""

from __future__ import annotations

import json
import os
import time

from tidemark.operators import ordered
from tidemark.plans import catalog
from tidemark.session import local_session

HEADLINE = [
    "a04_market_benchmark", "a08_category_metrics", "a20_edge_decomposition", "a19_family_tests", "a15_cluster_bootstrap",
    "a27_risk_ratios", "a55_dataset_audit", "f02_depth_walk", "f05_book_features", "f10_edge_arithmetic",
    "j02_asof_quote_per_trade", "j03_quote_race", "j05_nearest_within_tolerance", "j13_gap_overlap", "j23_metadata_versions",
    "t05_book_reconstruction", "w02_rolling_features", "w04_regime_intervals", "w05_drawdown_series", "w10_walk_forward_folds",
    "w14_interval_union", "a24_pnl_concentration", "a62_hypothesis_study", "w08_rolling_correlation",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cpus)
    spark.sparkContext.setLogLevel("OFF")
    catalog.QUERIES["a01_brier"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times, warm = {}, {}
    for name in HEADLINE:
        ordered._PROFILES.clear()
        for held in (times, warm):
            t0 = time.time()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            held[name] = round(time.time() - t0, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "warm": warm, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
