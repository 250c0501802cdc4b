"""Building blocks shared by the extractors, and first-wins de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions.core import case, struct
from pageloom.functions.text import truncate_sql

# Columns of a prepared page table that the extractors' expressions refer to.
HTML, BASE, DOCUMENT, TEXT = "_html", "_base", "_document", "_text"
ELEMENTS = f"{DOCUMENT}.elements"
ANCHORS = "_anchors"
# The extractor's number in its registry, bound around its items (``numbered``).
NTH = "_nth"


def item(type: str, value: str, metadata: str, phase: str | int, pos: str, sub: str = "0") -> str:
    """SQL for one finding inside its page's row."""
    place = struct(
        nth=NTH, phase=f"CAST({phase} AS INT)", pos=f"CAST({pos} AS INT)", sub=f"CAST({sub} AS INT)"
    )
    return struct(type=f"'{type}'", value=value, metadata=metadata, ord=place)


def numbered(items: str, nth: int) -> str:
    """An extractor's items with its number in their places: each is made once, whole."""
    return f"aggregate(array(), {nth}, (a_nth, x_nth) -> a_nth, {NTH} -> {items})"


def anchor_text(text: str) -> str:
    """Anchor text cut at its limit, NULL if there is none."""
    return case((f"{text} != ''", truncate_sql(text, 200)))


def inline_rows(df: DataFrame, array: str, *columns) -> DataFrame:
    """One row per struct in ``array``, next to ``columns``.

    The plain ``inline`` makes the optimizer add a filter on the array's size and
    push it to the scan, which computes the whole array a second time. The outer
    form does not; its one NULL row per empty array is dropped afterwards.
    """
    first = df.schema[array].dataType.elementType.names[0]
    return df.select(*columns, F.inline_outer(array)).where(F.col(first).isNotNull())


def keep_first(items: DataFrame, keys: list[str]) -> DataFrame:
    """First item per page, type and key, in ``ord`` order.

    For item tables that are already rows (the built-in extractors do this
    inside the page's row). The aggregate combines on the map side, so a page
    with very many duplicates sends one row per task and key.
    """
    names = items.columns
    group = [c for c in dict.fromkeys(["page_id", "type", *keys])]
    rest = [c for c in names if c not in group]
    kept = items.groupBy(*group).agg(F.min_by(F.struct(*rest), F.col("ord")).alias("_first"))
    return kept.select(*[F.col(c) if c in group else F.col(f"_first.{c}").alias(c) for c in names])
