"""Page metadata: title, meta tags, headings, canonical link, language, JSON-LD."""

from __future__ import annotations

from pageloom.functions.core import each, each_indexed, in_list, keep, let, non_empty, struct, text_map
from pageloom.functions.text import truncate_sql
from pageloom.operators.items import ELEMENTS, item

NAME, TYPE = "metadata", "metadata"
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
TAGS = ("title", "meta", *HEADINGS, "link", "html", "script")


def _found(own: str, tag: str, test: str = "true") -> str:
    return f"filter({own}, e -> e.tag = '{tag}' AND {test})"


def _entry(e: str, value: str, field: str, phase: int | str, pos: str | None = None) -> str:
    return item(TYPE, value, text_map(field=field), phase, pos or f"{e}.pos")


def title_sql(own: str = ELEMENTS) -> str:
    first = f"slice({_found(own, 'title')}, 1, 1)"
    return each(keep(first, lambda e: f"{e}.text != ''"), lambda e: _entry(e, f"{e}.text", "'title'", 0))


def meta_tags_sql(own: str = ELEMENTS) -> str:
    keyed = each(
        _found(own, "meta", "e.attrs['content'] != ''"),
        lambda e: struct(
            pos=f"{e}.pos",
            content=f"{e}.attrs['content']",
            key="lower(coalesce("
            + ", ".join(non_empty(f"{e}.attrs['{k}']") for k in ("name", "property", "http-equiv"))
            + "))",
        ),
    )
    return each(
        keep(keyed, lambda x: f"{x}.key IS NOT NULL"),
        lambda x: _entry(x, f"{x}.content", f"{x}.key", 1),
    )


def headings_sql(own: str = ELEMENTS) -> str:
    # level by level; pages keep document order inside a level
    levels = ", ".join(_found(own, h, "e.text != ''") for h in HEADINGS)
    return each_indexed(
        f"concat({levels})",
        lambda e, i: _entry(e, truncate_sql(f"{e}.text", 300), f"{e}.tag", 2, i),
    )


def canonical_link_sql(own: str = ELEMENTS) -> str:
    found = _found(own, "link", "e.attrs['rel'] = 'canonical' AND e.attrs['href'] != ''")
    return each(found, lambda e: _entry(e, f"{e}.attrs['href']", "'canonical'", 3))


def language_sql(own: str = ELEMENTS) -> str:
    # a second html tag only adds the attributes the first one lacks
    first = f"slice({_found(own, 'html', "e.attrs['lang'] IS NOT NULL")}, 1, 1)"
    return each(
        keep(first, lambda e: f"{e}.attrs['lang'] != ''"),
        lambda e: _entry(e, f"{e}.attrs['lang']", "'language'", 4),
    )


def json_ld_sql(own: str = ELEMENTS) -> str:
    numbered = each_indexed(
        _found(own, "script", "e.attrs['type'] = 'application/ld+json'"),
        lambda e, i: struct(pos=f"{e}.pos", text=f"{e}.text", i=i),
    )
    return each(
        keep(numbered, lambda x: f"{x}.text != ''"),
        lambda x: item(
            TYPE,
            truncate_sql(f"{x}.text", 2000),
            text_map(field="'json-ld'", index=f"CAST({x}.i AS STRING)"),
            5,
            f"{x}.pos",
        ),
    )


def items_sql() -> str:
    # the page's other elements, mostly anchors, are passed over once
    return let(keep(ELEMENTS, lambda e: in_list(f"{e}.tag", TAGS)), _all_items)


def _all_items(own: str) -> str:
    parts = (
        title_sql(own),
        meta_tags_sql(own),
        headings_sql(own),
        canonical_link_sql(own),
        language_sql(own),
        json_ld_sql(own),
    )
    return f"concat({', '.join(parts)})"
