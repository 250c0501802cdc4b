"""Bloom filters as plain expressions: a scalar subquery that a scan can filter by.

The filter is an array of 64-bit words, made by one aggregation and handed to every task
with the plan, so the side that is filtered is neither shuffled nor joined. Whatever has
been added passes; of the rest about one in a hundred, while the filter has its ten bits
for each key. It never grows beyond ``MAX_WORDS``: with more keys than that is good for it
lets more through, so what it lets through must be looked at exactly afterwards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 10
HASHES = 4
#: 8 MB
MAX_WORDS = 1 << 20


def _places(keys: list[Column], words: int) -> list[Column]:
    h = F.xxhash64(*keys)
    first, second = F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(1))
    return [F.pmod(first + k * second, F.lit(words * 64)) for k in range(HASHES)]


def words_for(n: int) -> int:
    """Words of a filter for ``n`` keys: a power of two."""
    return min(MAX_WORDS, 1 << max(0, (n * BITS_PER_KEY - 1) // 64).bit_length())


def bloom(keys: DataFrame, columns: list[str], words: int) -> DataFrame:
    """One row: the filter of all rows of ``keys``, over the named columns."""
    places = keys.select(F.explode(F.array(*_places([F.col(c) for c in columns], words))).alias("_p"))
    one = F.expr("shiftleft(1L, CAST(_p & 63 AS INT))")
    bits = places.groupBy(F.shiftright("_p", 6).alias("_w")).agg(F.bit_or(one).alias("_b"))
    every = keys.sparkSession.range(words).withColumnRenamed("id", "_w")
    dense = every.join(bits, "_w", "left").select(F.struct("_w", F.coalesce("_b", F.lit(0)).alias("_b")).alias("x"))
    return dense.agg(F.expr("transform(sort_array(collect_list(x)), x -> x._b)").alias("words"))


def may_contain(filter_row: DataFrame, words: int, *keys: Column) -> Column:
    """Whether the filter, stored as one row, may hold the keys; NULL keys count as equal."""
    word = filter_row.select("words").scalar()
    found = [
        F.getbit(F.get(word, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1
        for p in _places(list(keys), words)
    ]
    return reduce(Column.__and__, found)
