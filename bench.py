"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR: tables to read (default sf0.1). BENCH_CPUS: cores (default 4).
Every query is built, planned and run afresh, once to warm up and then three
times; the median counts. Results go to Spark's no-op sink, so all rows and
columns are made.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from pageloom.catalog import QUERIES

HEADLINE = (
    "extract_all_pages",
    "extract_all_site",
    "links",
    "link_edges",
    "emails",
    "phones",
    "metadata_all",
    "assets_all",
    "forms",
    "social",
    "api_endpoints",
    "element_counts",
    "canonical_urls",
    "page_item_counts",
    "crawl_deep",
    "crawl_stats",
    "report_lines",
    "stream_extract",
)
RUNS = 3


def run(spark: SparkSession, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pageloom-bench")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        run(spark, sf_dir, name)
        times[name] = round(statistics.median(run(spark, sf_dir, name) for _ in range(RUNS)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    line = {
        "metric": "total_median_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }
    if "extract_all_pages" in times:
        line["pages_per_sec"] = round(pages / times["extract_all_pages"], 1)
    print(json.dumps(line))


if __name__ == "__main__":
    main()
