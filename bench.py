"""Time every query of the catalog and print one JSON line.

Each query is run to the end (all rows written to the no-op sink), once to warm up and then
``BENCH_RUNS`` times; the median counts. ``BENCH_QUERIES`` limits the run to some of them and
``BENCH_PLANS`` names a file for the seconds and planned shuffles per query.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from kpiloom.plans.catalog import QUERIES  # noqa: E402


def session(cores: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def shuffles(df: DataFrame) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"\bExchange ", plan))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = os.environ.get("BENCH_QUERIES", "").split() or list(QUERIES)
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    seconds, planned = {}, {}
    for name in chosen:
        frame = QUERIES[name](spark, folder)
        planned[name] = shuffles(frame)
        run(frame)
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            run(QUERIES[name](spark, folder))
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    if os.environ.get("BENCH_PLANS"):
        with open(os.environ["BENCH_PLANS"], "w") as out:
            json.dump({"seconds": seconds, "shuffles": planned}, out)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
