"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.plans.checkpoints import shared_dir


def importable(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [*known, root]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write a DataFrame into the cluster's shared folder and read it from there.

    What follows starts from the files: nothing upstream runs a second time, and
    losing an executor costs only the tasks it was running."""
    folder = shared_dir(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def plain_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; other columns of the input can't clash with ours."""
    return df.select(*[df[f"`{n}`"] for n in names])


#: a side of a join is broadcast up to this size
BROADCAST_BYTES = 8 << 20


def beside(keys: DataFrame, row_bytes: int = 32) -> DataFrame:
    """A stored table of keys as the smaller side of a join: broadcast if its rows,
    which are counted, fit into ``BROADCAST_BYTES``; else left for Spark to shuffle."""
    return F.broadcast(keys) if keys.count() * row_bytes <= BROADCAST_BYTES else keys


def hash_share(column: str) -> Column:
    """A text's place among all texts, from 0 to 1, by its hash: rows below a share are
    a sample of about that share, the same however the table is dealt out."""
    return F.xxhash64(column) / F.lit(2.0**64) + F.lit(0.5)
