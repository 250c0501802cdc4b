"""Scalar text functions, all built from native column expressions.

Functions named ``*_sql`` return SQL text, the others a Column.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column

from pageloom.functions.core import case, each, expr, let, lit

# The characters with the Unicode White_Space property.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0         "
    "       　"
)

# What the HTML standard makes of the references &#128; .. &#159;: their
# windows-1252 meaning (the five unassigned codes stay as they are).
_C1 = "".join(
    bytes([b]).decode("cp1252", errors="ignore") or chr(b) for b in range(0x80, 0xA0)
)

# HTML character references: with a semicolon, and the old ones valid without.
_NAMED = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
_LEGACY = "|".join(
    sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
)
_TABLE = "\n" + "".join(f"{k}={v}\n" for k, v in sorted(_NAMED.items()) if v != "\n")
_COMMON = {"NewLine": "\n", "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\xa0"}

_NUMERIC = r"#[0-9]++;?|#[xX][0-9a-fA-F]++;?"
_PIECES = rf"&(?:{_NUMERIC}|[a-zA-Z][a-zA-Z0-9]*+;|(?:{_LEGACY}))|[^&]++|&"
# In an attribute an unterminated name followed by '=' or a letter or digit is
# plain text (think of ?a=1&copy=2).
_PIECES_IN_ATTRIBUTE = (
    rf"&(?:{_NUMERIC}|[a-zA-Z][a-zA-Z0-9]*+;|(?:{_LEGACY})(?![=a-zA-Z0-9]))|[^&]++|&"
)


def trim_space_sql(c: str) -> str:
    # texts that start and end with a visible ASCII character need no trimming
    trimmed = lambda x: f"btrim({x}, {lit(WHITE_SPACE)})"
    clean = lambda x: (
        f"substr({x}, 1, 1) BETWEEN '!' AND '~' AND substr({x}, -1, 1) BETWEEN '!' AND '~'"
    )
    return let(c, lambda x: f"IF({clean(x)}, {x}, {trimmed(x)})")


def trim_space(c: str) -> Column:
    """Strip Unicode white space from both ends."""
    return expr(trim_space_sql(c))


def _whole_characters(c: str, n: int) -> str:
    # a cut is at most three bytes away from a character boundary
    tries = ", ".join(
        f"try_validate_utf8(CAST(substring(b, 1, {n - k}) AS STRING))" for k in range(4)
    )
    return f"get(transform(array(encode({c}, 'UTF-8')), b -> coalesce({tries})), 0)"


def truncate_sql(c: str, n: int) -> str:
    return f"IF(octet_length({c}) <= {n}, {c}, concat({_whole_characters(c, n)}, '...'))"


def truncate_text(c: str, n: int) -> Column:
    """Texts longer than n bytes: at most n bytes, whole characters, then ``...``."""
    return expr(truncate_sql(c, n))


def clip_bytes(c: str, n: int) -> Column:
    """First n bytes of a text, never half a character."""
    return expr(f"IF(octet_length({c}) <= {n}, {c}, {_whole_characters(c, n)})")


def strip_tags_sql(html: str) -> str:
    return f"replace(regexp_replace({html}, '<[^>]*+', ''), '>', ' ')"


def strip_tags(html: str) -> Column:
    """Drop everything from ``<`` up to ``>``; each ``>`` becomes a space.

    Naive on purpose: entities stay, script bodies stay, an unclosed ``<``
    drops the rest. Removing ``<`` and what follows it up to (not including)
    ``>`` first leaves exactly the ``>`` characters to turn into spaces, and
    touches every character once.
    """
    return expr(strip_tags_sql(html))


def find_all_sql(c: str, pattern: str) -> str:
    return f"regexp_extract_all({c}, {lit(pattern)}, 0)"


def find_all(c: str, pattern: str) -> Column:
    """All leftmost non-overlapping matches, as an array."""
    return expr(find_all_sql(c, pattern))


def _from_code_point(cp: str) -> str:
    bad = f"({cp} IS NULL OR {cp} = 0 OR {cp} > 1114111 OR {cp} BETWEEN 55296 AND 57343)"
    utf32 = f"decode(unhex(lpad(hex({cp}), 8, '0')), 'UTF-32')"
    return case(
        (bad, lit("�")),
        (f"{cp} BETWEEN 128 AND 159", f"substr({lit(_C1)}, CAST({cp} - 127 AS INT), 1)"),
        default=utf32,
    )


ENTITY_TABLE = lit(_TABLE)


def _decode_piece(p: str, table: str) -> str:
    body = f"rtrim(';', substr({p}, 2))"
    number = case(
        (f"{p} RLIKE '^&#[xX]'", f"conv(substr({body}, 3), 16, 10)"),
        default=f"substr({body}, 2)",
    )
    # The standard table is one string, which costs a plan far less than a map of
    # thousands of literals; only rare names are looked up in it.
    rare = let(
        f"instr({table}, concat('\\n', {body}, '='))",
        lambda at: case(
            (f"{at} = 0", p),
            default=f"substring_index(substr({table}, {at} + length({body}) + 2, 4), '\\n', 1)",
        ),
    )
    named = case(*[(f"{body} = {lit(k)}", lit(v)) for k, v in _COMMON.items()], default=rare)
    return case(
        (f"NOT startswith({p}, '&') OR {p} = '&'", p),
        (f"startswith({p}, '&#')", let(f"try_cast({number} AS BIGINT)", _from_code_point)),
        default=named,
    )


def decode_entities_sql(c: str, in_attribute: bool = False, table: str = ENTITY_TABLE) -> str:
    """``table`` lets a larger expression bind the entity table once and pass it on."""
    pieces = find_all_sql(c, _PIECES_IN_ATTRIBUTE if in_attribute else _PIECES)
    return f"IF(contains({c}, '&'), array_join({each(pieces, lambda p: _decode_piece(p, table))}, ''), {c})"


def decode_entities(c: str, in_attribute: bool = False) -> Column:
    """Decode named and numeric HTML character references."""
    return expr(decode_entities_sql(c, in_attribute))


def normalize_phone_sql(c: str) -> str:
    return f"regexp_replace({c}, '[^+0-9]', '')"


def normalize_phone(c: str) -> Column:
    """Keep ``+`` and the digits 0-9."""
    return expr(normalize_phone_sql(c))


def format_duration_sql(ns: str) -> str:
    return case(
        (f"{ns} < 1000000000", f"concat({ns} DIV 1000000, 'ms')"),
        (f"{ns} < 60000000000", f"concat(format_number({ns} / 1e9D, 1), 's')"),
        default=f"concat({ns} DIV 60000000000, 'm', ({ns} DIV 1000000000) % 60, 's')",
    )


def format_duration(ns: str) -> Column:
    """``NNNms`` below a second, ``N.Ns`` below a minute, else ``XmYs``."""
    return expr(format_duration_sql(ns))
