"""Mixing sources by temperature.

A source's weight is its share of tokens to the power of an exponent between 1 (as
found) and 0 (all alike), normalised. The exponent is bisected, a fixed number of
steps in one pass, until the mix has the entropy asked for, and no source repeats
more often than allowed. Weights become whole passes over a source and one part pass.
Each pass is a permutation of the source's blocks of documents; the part pass takes
blocks in order as long as the budget lasts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pageloom.llm.maglev import hash_number
from pageloom.llm.rule_ledger import BLANKS, SPACE
from pageloom.llm.tables import plain_columns, stored

BLOCKS = 64
#: 64 parts a pass, that is six bisections at once
PARTS, PASSES = 64, 4
SEED = "mix-1"

_TRIMMED = f"trim(BOTH {BLANKS} FROM text)"
TOKENS = f"CAST(IF(coalesce({_TRIMMED}, '') = '', 0, size(split({_TRIMMED}, '{SPACE}+'))) AS BIGINT)"
#: a null source is a source of its own
KEY = "IF(source IS NULL, 'null', concat('=', CAST(source AS STRING)))"
BLOCK = f"{hash_number("coalesce(CAST(doc_id AS STRING), '')")} % {BLOCKS}"


@dataclass(frozen=True)
class Target:
    """entropy: as a part of the largest possible, 0 to 1. repeats: passes over a source
    at most. budget: tokens to draw; None is the smallest budget that shows every source
    whole."""

    entropy: float | None = None
    repeats: float | None = 4.0
    budget: int | None = None


def _exponents(totals: DataFrame, tokens: int, budget: int | None, alphas: list[float]) -> list[tuple]:
    """(exponent, entropy, largest possible entropy, most repeats) for each exponent."""
    powered = totals.select(
        (F.col("tokens") / F.lit(tokens)).alias("p"), F.explode(F.array(*map(F.lit, alphas))).alias("a")
    )
    drawn = f"{budget} / {tokens} / sum(pow(p, a))" if budget else "1 / min(pow(p, a - 1))"
    return [
        tuple(r)
        for r in powered.groupBy("a").agg(
            F.expr("ln(sum(pow(p, a))) - sum(pow(p, a) * a * ln(p)) / sum(pow(p, a))").alias("h"),
            F.expr("ln(count(*))").alias("most"),
            F.expr(f"max(pow(p, a - 1)) * {drawn}").alias("repeats"),
        ).orderBy("a").collect()
    ]


def exponent(totals: DataFrame, tokens: int, target: Target) -> float:
    """The largest exponent with the entropy, or more; more where the repeats ask for it."""

    def edge(low_side) -> float:
        """The largest exponent on the low side, between 0 and 1: entropy falls and
        repeats fall as the exponent grows."""
        low, high = 0.0, 1.0
        for _ in range(PASSES):
            step = (high - low) / PARTS
            grid = [low + k * step for k in range(PARTS + 1)]
            on = [low_side(r) for r in _exponents(totals, tokens, target.budget, grid)]
            if on[-1]:
                return high
            last = on.index(False) - 1
            if last < 0:
                return low
            low, high = grid[last], grid[last + 1]
        return low if low_side is enough else high

    enough = lambda r: r[1] >= target.entropy * r[2] - 1e-12
    too_often = lambda r: r[3] > target.repeats + 1e-12
    flat = 1.0 if target.entropy is None and target.repeats is None else 0.0
    alpha = edge(enough) if target.entropy is not None else flat
    return max(alpha, edge(too_often)) if target.repeats is not None else alpha


def plan(docs: DataFrame, target: Target = Target(), seed: str = SEED) -> DataFrame:
    """(key, block, tokens, copies): how often each block of each source is drawn.

    Documents are summed up to source and block before any shuffle; a source has
    ``BLOCKS`` blocks however large it is. The exponent is found from sums over
    sources, of which the driver sees a fixed number. A source without tokens has no
    weight and is not drawn."""
    rows = plain_columns(docs, "doc_id", "text", "source")
    blocks = stored(
        rows.select(F.expr(KEY).alias("key"), F.expr(BLOCK).alias("block"), F.expr(TOKENS).alias("tokens"))
        .groupBy("key", "block")
        .agg(F.sum("tokens").alias("tokens"))
    )
    totals = stored(blocks.groupBy("key").agg(F.sum("tokens").alias("tokens")).where("tokens > 0"))
    tokens = totals.agg(F.sum("tokens")).first()[0]
    if not tokens:
        return stored(blocks.withColumn("copies", F.lit(0).cast("long")).select("key", "block", "tokens", "copies"))
    alpha = exponent(totals, tokens, target)
    shares = totals.select("key", F.col("tokens").alias("whole"), F.expr(f"pow(tokens / {tokens}, {alpha!r}D)").alias("w"))
    sums = shares.agg(F.sum("w"), F.min(F.col("w") / F.col("whole"))).first()
    # drawn from a source: its weight times the budget
    scale = f"{target.budget / sums[0]!r}D" if target.budget else f"{1 / sums[1]!r}D"
    goals = shares.select("key", "whole", F.expr(f"CAST(round(w * {scale}) AS BIGINT)").alias("goal"))
    order = Window.partitionBy("key").orderBy(F.expr(hash_number(f"concat_ws(':', '{seed}', key, block)")), "block")
    part = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) <= F.col("goal") % F.col("whole")
    return stored(
        blocks.join(goals, "key", "left").select(
            "key", "block", "tokens",
            F.coalesce(F.expr("goal div whole") + part.cast("long"), F.lit(0)).alias("copies"),
        )
    )


def schedule(planned: DataFrame, seed: str = SEED) -> DataFrame:
    """(key, pass, position, block): the order in which a source's blocks are read.

    Every pass has a permutation of its own; the last, a part pass, keeps to the order
    that chose its blocks."""
    most = F.max("copies").over(Window.partitionBy("key"))
    drawn = planned.withColumn("most", most).select(
        "key", "block", "most", F.explode(F.expr("IF(copies > 0, sequence(0, copies - 1), array())")).alias("pass")
    )
    name = hash_number(f"concat_ws(':', '{seed}', key, block, IF(pass = most - 1, NULL, pass))")
    order = Window.partitionBy("key", "pass").orderBy(F.expr(name), "block")
    return drawn.select("key", "pass", F.row_number().over(order).alias("position"), "block")


def drawn(docs: DataFrame, target: Target = Target(), seed: str = SEED) -> DataFrame:
    """(doc_id, source, n_tokens, block, copies) for every row of ``docs``.

    Null and empty texts have no tokens but go with their block. The plan is a table
    of known size: Spark broadcasts it below its threshold and else joins by source
    and block, of which the largest source has ``BLOCKS``."""
    rows = plain_columns(docs, "doc_id", "text", "source").select(
        "doc_id", "source", F.expr(TOKENS).alias("n_tokens"), F.expr(KEY).alias("key"), F.expr(BLOCK).alias("block")
    )
    planned = plan(docs, target, seed).select("key", "block", "copies")
    return rows.join(planned, ["key", "block"], "left").select(
        "doc_id", "source", "n_tokens", F.col("block").cast("int").alias("block"), "copies"
    )


def mixed(docs: DataFrame, target: Target = Target(), seed: str = SEED) -> DataFrame:
    """``docs`` with each row as often as its block is drawn, and the same columns."""
    planned = plan(docs, target, seed).where("copies > 0").select(
        F.col("key").alias("_mix_key"), F.col("block").alias("_mix_block"), F.col("copies").alias("_mix_copies")
    )
    here = (F.expr(KEY) == planned["_mix_key"]) & (F.expr(BLOCK) == planned["_mix_block"])
    times = F.explode(F.expr("sequence(1, _mix_copies)"))
    return docs.join(planned, here).select(*[docs[f"`{c}`"] for c in docs.columns], times.alias("_mix_time")).drop("_mix_time")
