"""Hyperlinks of a page."""

from __future__ import annotations

from pageloom.functions.core import each, first_by_key, keep, let, lit, non_empty, struct, text_map
from pageloom.functions.text import trim_space_sql
from pageloom.functions.urls import link_type_sql, resolve_parsed_sql
from pageloom.operators.items import ANCHORS, BASE, ELEMENTS, anchor_text, item

NAME, TYPE, TAGS = "links", "link", ("a",)

# A reference starting with one of these is not a link.
SKIPPED = ("#", "javascript:", "mailto:", "tel:")


def _href(e: str) -> str:
    return f"{e}.attrs['href']"


def anchors_sql(test=lambda href: f"{href} != ''") -> str:
    """array<struct<pos, href, attrs, text>> of the anchors whose href passes."""
    found = keep(ELEMENTS, lambda e: f"{e}.tag = 'a' AND {test(_href(e))}")
    return each(
        found,
        lambda e: struct(
            pos=f"{e}.pos", href=f"{e}.attrs['href']", rel=f"{e}.attrs['rel']", text=f"{e}.text"
        ),
    )


def resolved_sql(refs: str, ref) -> str:
    """Resolve an array of references: array<struct<of, to<url, host, path>,
    base_host>> without those that are not URLs. The base is bound once."""

    def pairs(b: str) -> str:
        return each(
            refs,
            lambda r: struct(
                of=r, to=resolve_parsed_sql(b, trim_space_sql(ref(r))), base_host=f"{b}.host"
            ),
        )

    return keep(let(BASE, pairs), lambda x: f"{x}.to.url != ''")


def resolved_anchors_sql() -> str:
    """All anchors with a reference, resolved; links and social profiles share it."""
    return resolved_sql(anchors_sql(), lambda r: f"{r}.href")


def _is_link(href: str) -> str:
    starts = "|".join(SKIPPED)
    return f"NOT {href} RLIKE {lit(rf'^(?U:\s*+)(?:{starts})')}"


def _first_links() -> str:
    """The anchors that are links, first occurrence of each resolved URL."""
    return first_by_key(keep(ANCHORS, lambda x: _is_link(f"{x}.of.href")), lambda x: f"{x}.to.url")


def links_sql() -> str:
    """array<struct<pos, url, link_type, text, rel>>: the page's links, first
    occurrence of each resolved URL (fragments included)."""
    return each(
        _first_links(),
        lambda x: struct(
            pos=f"{x}.of.pos",
            url=f"{x}.to.url",
            link_type=link_type_sql(f"{x}.to.host", f"{x}.base_host"),
            text=f"{x}.of.text",
            rel=f"{x}.of.rel",
        ),
    )


def items_sql() -> str:
    return each(
        _first_links(),
        lambda x: item(
            TYPE,
            f"{x}.to.url",
            text_map(
                link_type=link_type_sql(f"{x}.to.host", f"{x}.base_host"),
                anchor_text=anchor_text(f"{x}.of.text"),
                rel=non_empty(f"{x}.of.rel"),
            ),
            0,
            f"{x}.of.pos",
        ),
    )
