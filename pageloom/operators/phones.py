"""Phone numbers: tel links first, then numbers in the page's text."""

from __future__ import annotations

from pageloom.functions.core import each, each_indexed, first_by_key, keep, struct, text_map
from pageloom.functions.text import find_all_sql, normalize_phone_sql, trim_space_sql
from pageloom.operators.items import TEXT, item
from pageloom.operators.links import anchors_sql

NAME, TYPE, TAGS = "phones", "phone", ("a",)

# Every number has this; a text without it is not searched.
_NEEDED = "[0-9]{4}"

# The two written forms, tried one after the other over the whole
# text, and the least number of characters of a normalised number.
_GAP = r"[\t\n\f\r .-]?"
PATTERNS = (
    rf"(?=[+(0-9\t\n\f\r .-])\+?1?{_GAP}\(?[0-9]{{3}}\)?{_GAP}[0-9]{{3}}{_GAP}[0-9]{{4}}",
    rf"\+[0-9]{{1,3}}{_GAP}[0-9]{{4,14}}",
)
MIN_LENGTH = 7


def items_sql() -> str:
    tel = anchors_sql(lambda href: f"startswith({href}, 'tel:')")
    sources = [
        each(
            tel,
            lambda a: struct(
                value=f"substr({a}.href, 5)", source="'tel_link'", phase="0", pos=f"{a}.pos"
            ),
        )
    ]
    for phase, pattern in enumerate(PATTERNS, 1):
        sources.append(
            each_indexed(
                f"IF({TEXT} RLIKE '{_NEEDED}', {find_all_sql(TEXT, pattern)}, array())",
                lambda m, i, phase=phase: struct(
                    value=m, source="'page_text'", phase=str(phase), pos=i
                ),
            )
        )
    numbers = each(
        f"concat({', '.join(sources)})",
        lambda x: struct(
            value=trim_space_sql(f"{x}.value"),
            normalized=normalize_phone_sql(f"{x}.value"),
            source=f"{x}.source",
            phase=f"{x}.phase",
            pos=f"{x}.pos",
        ),
    )
    long_enough = keep(numbers, lambda x: f"length({x}.normalized) >= {MIN_LENGTH}")
    return each(
        first_by_key(long_enough, lambda x: f"{x}.normalized"),
        lambda x: item(
            TYPE,
            f"{x}.value",
            text_map(normalized=f"{x}.normalized", source=f"{x}.source"),
            f"{x}.phase",
            f"{x}.pos",
        ),
    )
