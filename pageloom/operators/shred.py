"""The element table: one row per start tag of every page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.core import expr
from pageloom.functions.html import document_sql, elements_sql
from pageloom.operators.items import inline_rows
from pageloom.sources.pages import EFFECTIVE_HTML, as_pages

CONTAINERS = ("form", "picture", "video", "audio")


def shred_html(pages: DataFrame, tags: tuple[str, ...] | None = None) -> DataFrame:
    """page_id, pos, tag, attrs, text for every start tag (or those in ``tags``).

    ``text`` is set for anchors, headings, titles and other raw-text elements."""
    arrays = as_pages(pages).select(
        "page_id", expr(elements_sql(f"({EFFECTIVE_HTML})", tags)).alias("elements")
    )
    return inline_rows(arrays, "elements", "page_id")


def contained_elements(pages: DataFrame, container: str, tags: tuple[str, ...]) -> DataFrame:
    """The descendant selector ``container tag``: page_id, parent (ordinal of
    the container), pos, tag, attrs."""
    inside = f"{document_sql(f'({EFFECTIVE_HTML})', (), {container: tags})}.{container}"
    parents = as_pages(pages).select(
        "page_id", F.posexplode_outer(expr(inside)).alias("parent", "elements")
    )
    return inline_rows(parents, "elements", "page_id", "parent").drop("text")


def select_elements(
    elements: DataFrame,
    tag: str,
    present: str | None = None,
    equals: dict[str, str] | None = None,
    prefix: dict[str, str] | None = None,
) -> DataFrame:
    """Selector on the element table: tag, attribute present, equal, prefixed.
    Values compare case-sensitively."""
    test: Column = F.col("tag") == tag
    if present:
        test &= F.map_contains_key("attrs", present)
    for k, v in (equals or {}).items():
        test &= F.col("attrs")[k] == v
    for k, v in (prefix or {}).items():
        test &= F.col("attrs")[k].startswith(v)
    return elements.where(test)
