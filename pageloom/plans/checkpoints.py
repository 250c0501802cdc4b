"""Cutting lineage so that it survives the loss of executors."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder all executors can reach: under ``spark.checkpoint.dir``, or
    where that is unset (as in tests) a temporary one, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/pageloom-{uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    return tempfile.mkdtemp(prefix="pageloom-")


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a DataFrame into the shared folder and read it from there: columnar, with
    sizes that the optimizer can see, and with no way back to how it was made."""
    path = folder or shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, folder: str | None = None, buckets: int | None = None) -> DataFrame:
    """Write a DataFrame as a table in buckets by ``key``, in the shared folder, and read it
    from there: a join on the key doesn't shuffle it again. Buckets are as many as Spark's
    shuffle partitions unless given, so rows that come from a shuffle by the key need no other.

    The buckets are known to the returned DataFrame; ``open_bucketed`` opens the files in
    another session."""
    spark = df.sparkSession
    path = folder or shared_dir(spark)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"pageloom_{uuid4().hex}"
    df.write.format("parquet").bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    return _unnamed(spark, name)


def open_bucketed(spark: SparkSession, folder: str, key: str, buckets: int, columns: str) -> DataFrame:
    """A table that ``bucketed`` wrote into ``folder``, in this session or another one;
    ``columns`` with their types, as SQL."""
    name = f"pageloom_{uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`)"
        f" INTO {buckets} BUCKETS LOCATION '{folder}'"
    )
    return _unnamed(spark, name)


def _unnamed(spark: SparkSession, name: str) -> DataFrame:
    """A table's DataFrame; its name is only needed to tell Spark of the buckets."""
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # external: the files stay
    return table


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate results, wherever it is."""
    place, files = _filesystem(spark, folder)
    files.delete(place, True)


def _filesystem(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, files = _filesystem(spark, path)
    return files.exists(place)


def is_folder(spark: SparkSession, path: str) -> bool:
    place, files = _filesystem(spark, path)
    return files.exists(place) and files.getFileStatus(place).isDirectory()


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none if there is no such folder."""
    place, files = _filesystem(spark, folder)
    return [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []
