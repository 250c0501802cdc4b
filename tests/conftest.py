import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def page(spark):
    """page(html, ...) -> a one-page table on https://shop.test/dir/page."""

    def make(html, url="https://shop.test/dir/page", **more):
        names = ["page_id", "url", "html", *more]
        row = (1, url, html, *more.values())
        return spark.createDataFrame([row], ", ".join(
            f"{n} {'long' if n == 'page_id' else 'string'}" for n in names
        ))

    return make
