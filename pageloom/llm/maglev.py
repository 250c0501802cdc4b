"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a prime-sized table.
The shards take turns; on its turn a shard claims the first slot it prefers that
is still free. A row goes to the shard of slot ``hash(key) mod size``. Shards get
equal numbers of slots, up to one, and a shard that joins or leaves moves few rows
of the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: prime, at least a hundred slots per shard
TABLE_SIZE = 1601
SHARDS = tuple(f"shard-{k:02d}" for k in range(16))


def hash_number(text: str) -> str:
    """SQL: the first 60 bits of MD5, as a number that other engines give too."""
    return f"CAST(conv(substr(md5({text}), 1, 15), 16, 10) AS BIGINT)"


def lookup(spark: SparkSession, shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """(slot, shard), ``size`` rows: as large as its parameter, whatever the data.

    ``size`` must be a prime above the number of shards, else a shard's order
    doesn't visit every slot."""
    if len(set(shards)) != len(shards) or not 0 < len(shards) < size:
        raise ValueError("shards must be distinct, and fewer than slots")
    if any(size % p == 0 for p in range(2, int(size**0.5) + 1)):
        raise ValueError(f"{size} is no prime")
    names = spark.createDataFrame([(k, s) for k, s in enumerate(shards)], "k int, shard string")
    prefs = names.select(
        "k",
        "shard",
        F.expr(f"{hash_number("concat(shard, ':offset')")} % {size}").alias("offset"),
        F.expr(f"{hash_number("concat(shard, ':skip')")} % {size - 1} + 1").alias("skip"),
    )
    one = prefs.agg(F.sort_array(F.collect_list(F.struct("k", "shard", "offset", "skip"))).alias("s"))
    turn = f"get(s, n % {len(shards)})"
    # the step of a shard's order at which it finds its first free slot
    slots = f"transform(sequence(0, {size - 1}), j -> (t.offset + j * t.skip) % {size})"
    free = f"get(filter({slots}, x -> get(owner, CAST(x AS INT)) < 0), 0)"
    claim = (
        f"get(transform(array(get(transform(array({turn}), t -> struct(t.k AS k, {free} AS at)), 0)),"
        f" c -> transform(owner, (o, i) -> IF(i = c.at, c.k, o))), 0)"
    )
    filled = one.select(
        "s",
        F.expr(f"aggregate(sequence(0, {size - 1}), array_repeat(-1, {size}), (owner, n) -> {claim})").alias("owner"),
    )
    return filled.select("s", F.posexplode("owner").alias("slot", "k")).select(
        "slot", F.expr("get(s, k).shard").alias("shard")
    )


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """A null key counts as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % size).cast("int")


def placed(rows: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """``rows`` with the columns slot and shard (in place of any of these names).

    The table is broadcast: its size is the parameter ``size``. No shuffle, each
    row looks at one slot; equal keys share a shard, rows stay as repeated as they
    were, an empty table stays empty."""
    table = F.broadcast(lookup(rows.sparkSession, shards, size))
    return rows.drop("shard").withColumn("slot", slot_of(rows[f"`{key}`"], size)).join(table, "slot", "left")
