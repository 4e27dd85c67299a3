"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from headway.plans import queries as plans
from headway.session import session

HEADLINE = ["gold_daily_metrics", "gold_hourly_metrics", "gold_stop_performance", "enrich_stopped_duration", "vehicle_journeys", "stop_performance_windows", "mart_daily_performance", "mart_stop_arrivals", "ingest_reasons", "feature_vector", "psi_drift", "large_daily_metrics", "large_stop_windows"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", "bench", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g", spark__sql__shuffle__partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    plans.QUERIES["silver_dedup"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    took = {}
    for name in HEADLINE:
        began = time.time()
        plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
