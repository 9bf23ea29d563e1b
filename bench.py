"""Prints one JSON line: seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], the median of three warm runs."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from statistics import median

from pyspark.sql import SparkSession

NAMES = ("count_all", "breakdown_1", "breakdown_2", "filter_and_or", "quantize", "discrete_then_quantize", "date_hour", "json_breakdown", "null_vs_undefined", "cube_day", "cube_hour", "cube_time_pruned", "dense_histogram", "points_roundtrip")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    from tallyrill.queries import QUERIES

    with tempfile.TemporaryDirectory() as tmp:
        spark = (
            SparkSession.builder.master(f"local[{cpus}]")
            .config("spark.sql.shuffle.partitions", cpus)
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.driver.memory", "8g")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.sql.warehouse.dir", f"{tmp}/warehouse")
            .config("spark.checkpoint.dir", f"{tmp}/shared")
            .getOrCreate()
        )
        spark.sparkContext.setLogLevel("ERROR")
        took = {}
        for name in sys.argv[1:] or NAMES:
            runs = []
            for _ in range(4):
                began = time.perf_counter()
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                runs.append(time.perf_counter() - began)
            took[name] = round(median(runs[1:]), 4)
        spark.stop()
    print(json.dumps({"metric": "headline queries, total of warm medians", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
