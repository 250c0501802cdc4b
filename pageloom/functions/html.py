"""HTML shredding with regular expressions, inside a page's row.

One pass over the HTML cuts out the elements an extractor asks for, each as its
own piece of markup. Comments and the bodies of raw-text elements are skipped
as a whole, and a ``>`` or a tag name inside a quoted attribute value ends
nothing. There is no tree repair: implied end tags and misnesting are ignored.

All loops in the patterns are possessive, so Java's regex engine neither
recurses nor backtracks. A tag start without an end would be searched for to the
end of the document, again and again; there can only be such starts behind the
last ``>``, where ``<`` is made plain text beforehand (``sealed_sql``). So every
character is passed a fixed number of times, whatever the markup.
"""

from __future__ import annotations

from pageloom.functions.core import each, each_indexed, first_by_key, fresh, in_list, keep, let, lit, struct
from pageloom.functions.text import ENTITY_TABLE, decode_entities_sql, trim_space_sql

# Elements whose content is not markup.
RAW_TEXT = "script|style|textarea|title|iframe|noembed|noframes|noscript|xmp"
_RCDATA = ("textarea", "title")

EMPTY = "''"

# Stands for a '<' that starts no tag; a code point no text can use.
_PLAIN = "\uFDD0"

_END = r"(?=[\s/>])"
_ATTRS = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+"


def sealed_sql(html: str) -> str:
    """HTML in which no tag starts behind the last ``>``; comments may."""

    def seal(tail: str) -> str:
        head = f"left({html}, length({html}) - length({tail}))"
        plain = f"regexp_replace({tail}, '<(?!!--)', {lit(_PLAIN)})"
        return f"IF(contains({tail}, '<'), concat({head}, {plain}), {html})"

    return let(f"substring_index({html}, '>', -1)", seal)


def _raw_element(names: str, group: int) -> str:
    """A raw-text element up to its end tag or the end of the document.

    ``group`` is the number its name's capturing group will have."""
    return rf"({names}){_END}{_ATTRS}>.*?(?:</\{group}{_END}[^>]*+>|\z)"


def _run(stop: str, group: int) -> str:
    """Everything up to the next tag that starts with ``stop``."""
    return (
        rf"(?:[^<]++|<(?!{stop})(?:!--(?:-?>|.*?(?:--!?>|\z))"
        rf"|{_raw_element(RAW_TEXT, group)}|/?+[a-z]{_ATTRS}>|[!?/][^>]*+>|))*+"
    )


def element_pattern(names: tuple[str, ...] | None, closing: tuple[str, ...] = ()) -> tuple[str, int]:
    """Pattern and group number that yield the elements called ``names`` (all
    elements for None): raw-text elements whole, anchors and headings up to
    where they must end, any other as its start tag only; and the end tags of
    those in ``closing``."""
    wanted = set(names or ())
    raw = sorted(wanted & set(RAW_TEXT.split("|"))) if names else RAW_TEXT.split("|")
    plain = sorted(wanted - set(raw) - {"a", "h1", "h2", "h3", "h4", "h5", "h6"})
    heads = sorted(n for n in wanted if n in ("h1", "h2", "h3", "h4", "h5", "h6"))
    stop = rf"(?:{'|'.join(sorted(wanted))}){_END}" if names else "[a-z]"
    ends = rf"/(?:{'|'.join(closing)}){_END}"
    # group 1 is the raw name inside the skipped run, group 2 the element
    group = 3
    shapes = []
    if raw:
        shapes.append(_raw_element("|".join(raw), group))
        group += 1
    if not names or "a" in wanted:
        shapes.append(rf"a{_END}{_ATTRS}>{_run(rf'/?+a{_END}', group)}")
        group += 1
    if not names or heads:
        # any heading tag ends an open heading
        which = "|".join(heads) if names else "h[1-6]"
        shapes.append(rf"(?:{which}){_END}{_ATTRS}>{_run(rf'/?+h[1-6]{_END}', group)}")
        group += 1
    if not names or plain:
        which = rf"(?:{'|'.join(plain)}){_END}" if names else "[a-z]"
        shapes.append(rf"{which}{_ATTRS}>")
    consumed = rf"{_raw_element('|'.join(raw), group)}|" if raw else ""
    if closing:
        stop = rf"(?:{stop}|{ends})"
        shapes.append(rf"{ends}[^>]*+>")
        consumed += "/[^>]*+>|"
    return (
        rf"(?is){_run(stop, 1)}(?:(?=(<(?:{'|'.join(shapes)})))<(?:{consumed}[a-z]{_ATTRS}>)|<|\z)",
        2,
    )


def _pieces(html: str, pattern: tuple[str, int]) -> str:
    regex, group = pattern
    return keep(f"regexp_extract_all({html}, {lit(regex)}, {group})", lambda m: f"{m} != ''")


# Attributes follow each other from the tag name up to the closing '>'. Group 1
# is the name, group 2 the value without its quotes ('' if there is none).
_ATTR = (
    r"\G(?:^<[^\s/>]++|(?!^))[\s/]*+([^\s=/>]++)"
    r"(?:\s*+=\s*+(?:\"(?=[^\"]*+\")|'(?=[^']*+'))?+"
    r"((?<=\")[^\"]*+|(?<=')[^']*+|[^\s>]*+)[\"']?+)?+"
)


def _newlines(c: str) -> str:
    return f"replace(replace({c}, '\\r\\n', '\\n'), '\\r', '\\n')"


def attributes_sql(element: str, table: str = ENTITY_TABLE) -> str:
    """Attribute map of a start tag: names lower-cased, entities decoded, ''
    for an attribute without a value, the first of duplicates."""
    names = each(f"regexp_extract_all({element}, {lit(_ATTR)}, 1)", lambda n: f"lower({n})")

    def value(v: str) -> str:
        # '&' and '\r' are rare enough to test for before doing more
        decoded = let(_newlines(v), lambda x: decode_entities_sql(x, True, table))
        return f"IF(contains({v}, '&') OR contains({v}, '\\r'), {decoded}, {v})"

    values = each(f"regexp_extract_all({element}, {lit(_ATTR)}, 2)", value)

    def as_map(n: str, vs: str) -> str:
        pairs = each_indexed(n, lambda k, i: struct(k=k, v=f"get({vs}, {i})"))
        first = first_by_key(pairs, lambda e: f"{e}.k")
        return (
            f"IF(size({n}) < 2 OR size(array_distinct({n})) = size({n}),"
            f" map_from_arrays({n}, {vs}), map_from_entries({first}))"
        )

    return let(names, lambda n: let(values, lambda vs: as_map(n, vs)))


def _content(element: str) -> str:
    return f"regexp_extract({element}, {lit(rf'(?s)^<[^\s/>]++{_ATTRS}>(.*+)$')}, 1)"


def text_sql(tag: str, element: str, table: str = ENTITY_TABLE) -> str:
    """Text of an element: that of all descendants, entities decoded, trimmed."""
    raw_end = lit(rf"(?i)</(?:{RAW_TEXT}){_END}[^>]*+>$")
    raw = f"regexp_replace({_content(element)}, {raw_end}, '')"
    tags = lit(rf"(?is)<(?:!--(?:-?>|.*?(?:--!?>|\z))|/?+[a-z]{_ATTRS}>|[!?/][^>]*+>)")
    markup = let(
        _content(element),
        lambda c: f"IF(contains({c}, '<'), regexp_replace({c}, {tags}, ''), {c})",
    )

    def finished(c: str) -> str:
        newlines = f"IF(contains({c}, '\\r'), {_newlines(c)}, {c})"
        decoded = let(newlines, lambda t: decode_entities_sql(t, False, table))
        coded = f"NOT ({in_list(tag, RAW_TEXT.split('|'))}) OR {in_list(tag, _RCDATA)}"
        return f"IF({coded}, {decoded}, {newlines})"

    def unsealed(t: str) -> str:
        return f"IF(contains({t}, {lit(_PLAIN)}), replace({t}, {lit(_PLAIN)}, '<'), {t})"

    is_raw = in_list(tag, RAW_TEXT.split("|"))
    return trim_space_sql(let(let(f"IF({is_raw}, {raw}, {markup})", finished), unsealed))


_WITH_TEXT = ("a", "h1", "h2", "h3", "h4", "h5", "h6", *RAW_TEXT.split("|"))


def elements_sql(
    html: str,
    names: tuple[str, ...] | None,
    with_text: bool = True,
    table: str = ENTITY_TABLE,
) -> str:
    """array<struct<pos, tag, attrs, text>> of the elements in document order.

    ``text`` is NULL for elements of which only the start tag is taken."""
    return let(sealed_sql(html), lambda h: _elements(h, names, with_text, table))


def _elements(html: str, names: tuple[str, ...] | None, with_text: bool, table: str) -> str:
    return _parsed(_pieces(html, element_pattern(names)), with_text, table)


def _tag_sql(piece: str) -> str:
    """Lower-case name of a piece of markup, with the slash of an end tag."""
    return f"lower(regexp_extract({piece}, {lit(r'^<(/?+[^\s/>]++)')}, 1))"


def _fields(pos: str, tag: str, markup: str, with_text: bool, table: str) -> str:
    text = f"IF({in_list(tag, _WITH_TEXT)}, {text_sql(tag, markup, table)}, NULL)"
    return struct(
        pos=pos,
        tag=tag,
        attrs=attributes_sql(markup, table),
        text=text if with_text else "CAST(NULL AS STRING)",
    )


def _parsed(pieces: str, with_text: bool, table: str) -> str:
    return each_indexed(
        pieces, lambda e, pos: let(_tag_sql(e), lambda tag: _fields(pos, tag, e, with_text, table))
    )


def document_sql(html: str, names: tuple[str, ...], inside: dict[str, tuple[str, ...]]) -> str:
    """struct<elements, form, video, ...>: the elements called ``names``, and for
    each container in ``inside`` an array with, per occurrence, an array of its
    elements of the given names, the container itself first where it is one of them.

    One pass over the HTML cuts out everything that is asked for, and the containers'
    end tags. A piece's place in that list is its label: a container holds the pieces
    between its start tag and the first end tag of its name, whatever is nested, so its
    content is a stretch of the list. The entity table is bound once for all.
    """
    every = tuple(dict.fromkeys([*names, *inside, *(n for ns in inside.values() for n in ns)]))

    def build(h: str, table: str) -> str:
        if not inside:
            return struct(elements=_elements(h, names, True, table))
        pieces = _pieces(h, element_pattern(every, tuple(inside)))
        tagged = each(pieces, lambda e: struct(tag=_tag_sql(e), markup=e))

        def parts(p: str) -> str:
            own = keep(p, lambda x: in_list(f"{x}.tag", names)) if names else "array()"
            return let(
                _marks(p, tuple(inside)),
                lambda marks: struct(
                    elements=_tagged(own, True, table) if names else "array()",
                    **{c: _contained(p, marks, c, inside[c], table) for c in inside},
                ),
            )

        return let(tagged, parts)

    return let(sealed_sql(html), lambda h: let(ENTITY_TABLE, lambda table: build(h, table)))


def _tagged(pieces: str, with_text: bool, table: str) -> str:
    return each_indexed(
        pieces, lambda x, pos: _fields(pos, f"{x}.tag", f"{x}.markup", with_text, table)
    )


def _marks(pieces: str, containers: tuple[str, ...]) -> str:
    """array<struct<tag, i>>: start and end tags of the containers, with their places."""
    tags = (*containers, *(f"/{c}" for c in containers))
    mark = lambda x, i: f"IF({in_list(f'{x}.tag', tags)}, {struct(tag=f'{x}.tag', i=i)}, NULL)"
    return keep(each_indexed(pieces, mark), lambda m: f"{m} IS NOT NULL")


def _contained(pieces: str, marks: str, container: str, names: tuple[str, ...], table: str) -> str:
    """Per occurrence of a container, its elements, out of a page's tagged pieces and the
    marks of all containers among them.

    Of the container's own tags in order, a start tag opens one unless the tag before it
    is a start tag too (it is nested then), and an end tag closes one if the tag before it
    is a start tag. The k-th that opens and the k-th that closes belong together; what
    isn't closed ends with the page."""
    start, end = lit(container), lit(f"/{container}")
    own_marks = keep(marks, lambda m: in_list(f"{m}.tag", (container, f"/{container}")))

    def where(own: str, tag: str, first: str) -> str:
        n = fresh()
        before = f"get({own}, j{n} - 1).tag"
        other = end if tag == start else start
        return f"filter({own}, (m{n}, j{n}) -> m{n}.tag = {tag} AND (j{n} = 0 AND {first} OR {before} = {other}))"

    def stretches(opens: str, closes: str) -> str:
        def content(o: str, k: str) -> str:
            upto = f"coalesce(get({closes}, {k}).i, size({pieces}))"
            held = f"slice({pieces}, {o}.i + 1, {upto} - {o}.i)"
            return _tagged(keep(held, lambda x: in_list(f"{x}.tag", names)), False, table)

        return each_indexed(opens, content)

    return let(
        own_marks,
        lambda own: let(
            where(own, start, "true"),
            lambda opens: let(where(own, end, "false"), lambda closes: stretches(opens, closes)),
        ),
    )
