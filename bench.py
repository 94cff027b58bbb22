"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from hammerline.plans import catalogue
from hammerline.session import build_session

HEADLINE = ["maker_stats", "quarter_history", "trailing_demand_median", "weighted_median_recency", "cohort_index", "point_in_time_prior", "asof_last_serve", "matched_yoy", "value_book", "calibration_rates", "backtest_summary", "token_dot_similarity", "inverted_index", "hedonic_index", "repeat_sales_index", "status_rank_dedupe"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            began = time.time()
            catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        times[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "sum of median query seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rpartition("sf")[2], "spark": spark.version, "shuffle_partitions": int(cpus)}))


if __name__ == "__main__":
    main()
