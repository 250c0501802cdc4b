"""Links to social-media platforms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions.core import case, each, first_by_key, keep, let, lit, text_map
from pageloom.operators.items import ANCHORS, anchor_text, item

NAME, TYPE, TAGS = "social", "social", ("a",)

# Platforms and what their URLs contain, in order of precedence.
PLATFORMS = {
    "twitter": ("twitter.com/", "x.com/"),
    "facebook": ("facebook.com/", "fb.com/", "fb.me/"),
    "instagram": ("instagram.com/",),
    "linkedin": ("linkedin.com/",),
    "github": ("github.com/",),
    "youtube": ("youtube.com/", "youtu.be/"),
    "tiktok": ("tiktok.com/",),
    "reddit": ("reddit.com/",),
    "pinterest": ("pinterest.com/",),
    "discord": ("discord.gg/", "discord.com/"),
    "telegram": ("t.me/", "telegram.me/"),
    "mastodon": ("mastodon.social/",),
    "threads": ("threads.net/",),
    "bluesky": ("bsky.app/",),
}


# A user's table of platforms becomes part of the expression, up to this many patterns;
# a larger one is joined (``plans.platforms``).
MAX_PATTERNS = 2000


def platforms_of(table: DataFrame) -> dict[str, tuple[str, ...]]:
    """Platforms from a table (platform, pattern, rank), for the option ``platforms``.

    Lower ranks come first where several patterns match. The table is counted before it
    is read; one of more than ``MAX_PATTERNS`` rows is for ``plans.platforms.social_items``, which joins it."""
    rows = table.select("platform", F.lower("pattern").alias("pattern"), "rank")
    if rows.count() > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns: use social_items")
    out: dict[str, tuple[str, ...]] = {}
    for r in rows.where("platform IS NOT NULL AND pattern <> ''").orderBy("rank", "platform", "pattern").collect():
        out[r.platform] = (*out.get(r.platform, ()), r.pattern)
    return out


def platform_sql(url: str, platforms: dict[str, tuple[str, ...]]) -> str:
    """First platform one of whose patterns occurs in the lower-cased URL."""
    return let(
        f"lower({url})",
        lambda u: case(
            *[
                (" OR ".join(f"contains({u}, {lit(p)})" for p in patterns), lit(name))
                for name, patterns in platforms.items()
            ]
        ),
    )


def items_sql(platforms: dict[str, tuple[str, ...]] | None = None) -> str:
    table = platforms or PLATFORMS
    # few anchors are profiles: these are named again, the others are not built anew
    named = keep(ANCHORS, lambda x: f"{platform_sql(f'{x}.to.url', table)} IS NOT NULL")
    return each(
        first_by_key(named, lambda x: f"{x}.to.url"),
        lambda x: item(
            TYPE,
            f"{x}.to.url",
            text_map(
                platform=platform_sql(f"{x}.to.url", table), anchor_text=anchor_text(f"{x}.of.text")
            ),
            0,
            f"{x}.of.pos",
        ),
    )
