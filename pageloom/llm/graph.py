"""Distributed connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.tables import stored


def _smallest(directed: DataFrame) -> DataFrame:
    """u -> the smallest of u and its neighbours; counts are combined before the shuffle."""
    return directed.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        both.join(_smallest(both), "u")
        .where("v > u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    mins = _smallest(down)
    hung = down.join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return (
        hung.unionByName(mins.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
    )


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node that has a link; component is its smallest node.

    Large and small stars in turn until nothing changes: a logarithmic number of
    rounds, each two joins on the node. A hub's links lie on the side of the join
    that adaptive execution can split. Each round is written to the shared folder;
    the driver only sees a count and a checksum. Null ends and self links make no
    component; no links give no rows."""
    edges = stored(
        links.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    state = None
    while True:
        seen = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(seen) == state or seen[0] == 0:
            break
        state = tuple(seen)
        edges = stored(_small_star(_large_star(edges)))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
