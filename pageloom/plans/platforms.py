"""Social-media links by a table of platforms, however large."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions.core import each, expr, first_by_key, struct, text_map
from pageloom.operators.items import ANCHORS, anchor_text, inline_rows
from pageloom.operators.social import NAME, TYPE
from pageloom.plans import bloom
from pageloom.plans.checkpoints import stored
from pageloom.plans.pipeline import prepare
from pageloom.schema import ORD

# A pattern is looked up by a stretch of at most this many characters of it.
KEY_CHARS = 8
# The keys of a platform table are broadcast up to this size, and else shuffled.
KEY_BYTES, ROW_BYTES = 16 << 20, 200


def pattern_keys(table: DataFrame) -> DataFrame:
    """(key, pattern, first, platform) of a table (platform, pattern, rank).

    ``key`` is a stretch of the pattern, of up to ``KEY_CHARS`` characters: of its
    stretches the one that the fewest patterns share, so what all patterns begin with is
    nobody's key. ``first`` is the lowest rank of any of the platform's patterns: that of
    platforms which match a URL the one with the lowest wins, by name where they are equal."""
    rows = table.select("platform", F.lower("pattern").alias("pattern"), "rank")
    rows = rows.where("platform IS NOT NULL AND pattern <> ''")
    ranks = rows.groupBy("platform").agg(F.min("rank").alias("first"))
    # sizes guessed from the table's file fall short of what is cut out of it: nothing is broadcast
    named = rows.select("platform", "pattern").distinct().join(ranks.hint("merge"), "platform")
    cut = f"least({KEY_CHARS}, length(pattern))"
    stretches = f"array_distinct(transform(sequence(1, length(pattern) - {cut} + 1), i -> substring(pattern, i, {cut})))"
    cuts = named.select("pattern").distinct().select("pattern", F.explode(F.expr(stretches)).alias("key"))
    shared = cuts.groupBy("key").agg(F.count("*").alias("n"))
    best = cuts.join(shared.hint("merge"), "key").groupBy("pattern").agg(F.min(F.struct("n", "key")).alias("best"))
    return named.join(best.hint("merge"), "pattern").select(F.col("best.key").alias("key"), "pattern", "first", "platform")


def social_items(pages: DataFrame, table: DataFrame) -> DataFrame:
    """What ``extract(pages, "social", platforms=...)`` gives, with platforms from a table
    (platform, pattern, rank) of any size; a frame-level extractor for a registry.

    A URL is cut into the stretches of the lengths that keys have, and those are joined with
    the keys: a pattern occurs in a URL only if its key does, and is then looked for. Keys
    are broadcast where their number, which is counted, allows, so pages move only as
    matches. Else a Bloom filter of the keys, at most 8 MB, goes to the pages, and what it
    lets through is shuffled and joined exactly. Nothing reaches the driver but the lengths."""
    keys = stored(pattern_keys(table))
    lengths = sorted(r.n for r in keys.select(F.length("key").alias("n")).distinct().collect())
    anchors = each(
        first_by_key(ANCHORS, lambda x: f"{x}.to.url"),
        lambda x: struct(pos=f"{x}.of.pos", url=f"{x}.to.url", text=anchor_text(f"{x}.of.text")),
    )
    listed = prepare(pages, [NAME]).select("page_id", F.col("url").alias("source_url"), expr(anchors).alias("_anchors"))
    urls = inline_rows(listed, "_anchors", "page_id", "source_url")
    cuts = [
        f"IF(length(_url) < {n}, array(), transform(sequence(1, length(_url) - {n} + 1), i -> substring(_url, i, {n})))"
        for n in lengths
    ]
    stretches = f"array_distinct(concat({', '.join(cuts)}))" if cuts else "array()"
    numbered = urls.withColumn("_row", F.monotonically_increasing_id()).withColumn("_url", F.lower("url"))
    cut = numbered.select("*", F.explode(F.expr(stretches).cast("array<string>")).alias("key"))
    n = keys.count()
    if n * ROW_BYTES <= KEY_BYTES:
        found = cut.join(F.broadcast(keys), "key")
    else:
        words = bloom.words_for(n)
        passing = stored(bloom.bloom(keys.select("key").distinct(), ["key"], words))
        likely = cut.where(bloom.may_contain(passing, words, F.col("key")))
        found = likely.join(keys.hint("merge"), "key")
    found = found.where("contains(_url, pattern)")
    best = found.groupBy("_row", "page_id", "source_url", "pos", "url", "text").agg(
        F.min(F.struct("first", "platform")).alias("best")
    )
    place = {n: F.col("pos") if n == "pos" else F.lit(0) for n in ORD.names}
    return best.select(
        "page_id",
        F.lit(TYPE).alias("type"),
        F.col("url").alias("value"),
        "source_url",
        expr(text_map(platform="best.platform", anchor_text="text")).alias("metadata"),
        F.struct(*[c.cast("int").alias(n) for n, c in place.items()]).alias("ord"),
    )
