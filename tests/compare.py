"""Runs catalog queries against their SQL: python tests/compare.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, sf_dir, query, sql):
    """Empty if both give the same columns and rows."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    if got == want:
        return []
    extra, missing = set(got) - set(want), set(want) - set(got)
    return [f"rows {len(got)} != {len(want)}", f"only spark: {sorted(extra, key=repr)[:2]}",
            f"only sql: {sorted(missing, key=repr)[:2]}"]


def main():
    from pyspark.sql import SparkSession

    from pageloom.catalog import QUERIES
    from pageloom.catalog_sql import ORACLE

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    con.execute("SET TimeZone = 'UTC'")
    failed = 0
    for name in sys.argv[2:] or QUERIES:
        start = time.time()
        try:
            diff = (
                differences(spark, con, sf_dir, QUERIES[name], ORACLE[name])
                if name in ORACLE
                else [f"no sql; {QUERIES[name](spark, sf_dir).count()} rows"]
            )
        except Exception as e:  # noqa: BLE001
            diff = [f"{type(e).__name__}: {str(e)[:700]}"]
        failed += bool(diff)
        print("ok  " if not diff else "DIFF", name, f"{time.time() - start:.1f}s", *[str(x)[:900] for x in diff], flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
