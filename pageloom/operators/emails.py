"""E-mail addresses: mailto links first, then addresses in the page's text."""

from __future__ import annotations

from pageloom.functions.core import each, each_indexed, first_by_key, keep, lit, struct, text_map
from pageloom.functions.text import trim_space_sql
from pageloom.operators.items import TEXT, item
from pageloom.operators.links import anchors_sql

NAME, TYPE, TAGS = "emails", "email", ("a",)

# What an address looks like, and what only looks like one.
_LOCAL = r"a-zA-Z0-9._%+\-"
_DOMAIN = r"[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
DENIED_SUFFIXES = (".png", ".jpg", ".gif", ".css", ".js")
DENIED_PARTS = ("example.com", "sentry.io", "webpack")

# Runs of other characters, and runs of local-part characters that begin no
# address, are passed over whole; group 1 is the next address. So a long run
# without an @, like inlined base64, is not tried from each of its characters.
PATTERN = (
    rf"(?:[^{_LOCAL}]++|[{_LOCAL}]++(?!@{_DOMAIN}))*+(?:([{_LOCAL}]++@{_DOMAIN})|\z)"
)


def addresses_sql(text: str) -> str:
    """Addresses in a text; most texts have no @ and are not searched."""
    found = keep(f"regexp_extract_all({text}, {lit(PATTERN)}, 1)", lambda m: f"{m} != ''")
    return f"IF(contains({text}, '@'), {found}, array())"


def candidates_sql() -> str:
    mailto = anchors_sql(lambda href: f"startswith({href}, 'mailto:')")
    linked = each(
        mailto,
        lambda a: struct(
            value=f"substring_index(substr({a}.href, 8), '?', 1)",
            source="'mailto_link'",
            phase="0",
            pos=f"{a}.pos",
        ),
    )
    written = each_indexed(
        addresses_sql(TEXT),
        lambda m, i: struct(value=m, source="'page_text'", phase="1", pos=i),
    )
    both = f"concat({linked}, {written})"
    return each(
        both,
        lambda x: struct(
            value=f"lower({trim_space_sql(f'{x}.value')})",
            source=f"{x}.source",
            phase=f"{x}.phase",
            pos=f"{x}.pos",
        ),
    )


def items_sql(
    denied_suffixes: tuple[str, ...] = DENIED_SUFFIXES,
    denied_parts: tuple[str, ...] = DENIED_PARTS,
) -> str:
    def wanted(x: str) -> str:
        tests = [f"{x}.value != ''"]
        tests += [f"NOT endswith({x}.value, {lit(s)})" for s in denied_suffixes]
        tests += [f"NOT contains({x}.value, {lit(s)})" for s in denied_parts]
        return " AND ".join(tests)

    return each(
        first_by_key(keep(candidates_sql(), wanted), lambda x: f"{x}.value"),
        lambda x: item(
            TYPE, f"{x}.value", text_map(source=f"{x}.source"), f"{x}.phase", f"{x}.pos"
        ),
    )
