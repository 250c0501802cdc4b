"""Runs this subpackage's queries against their SQL: python -m tests.llm.compare [sf_dir] [name ...]"""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession

from pageloom.llm.oracle import ORACLE
from pageloom.llm.queries import QUERIES
from tests.compare import connect, differences


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name in sys.argv[2:] or QUERIES:
        start = time.time()
        if name in ORACLE:
            diff = differences(spark, con, sf_dir, QUERIES[name], ORACLE[name])
            print(name, "ok" if not diff else diff, f"{time.time() - start:.1f}s", flush=True)
        else:
            rows = QUERIES[name](spark, sf_dir).collect()
            print(name, len(rows), rows[:3], f"{time.time() - start:.1f}s", flush=True)


if __name__ == "__main__":
    main()
