"""URL functions: reference resolution, canonical form, scope tests.

A URL is split once into a struct (see ``parse_sql``); the other functions work
on that struct, so a page's base is parsed once per page and not once per link.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.core import case, each, expr, in_list, let, lit, non_empty, struct
from pageloom.functions.text import find_all_sql

# Groups: scheme, //authority, path, ?query, #fragment. Authority, query and
# fragment keep their lead character: '' means absent, '?' means empty.
# Without a scheme '///' starts a path.
_SPLIT = (
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?((?:(?<=:)//|(?<!:)//(?!/))[^/?#]*)?"
    r"([^?#]*)(\?[^#]*)?(#.*)?$"
)

# Which characters stay unescaped.
_PATH_PLAIN = r"A-Za-z0-9\-_.~$&+,/:;=@"
_PATH_LEGAL = _PATH_PLAIN + r"!'()*\[\]%"
_FRAGMENT_PLAIN = r"A-Za-z0-9\-_.~$&+,/:;=?@!()*"
_FRAGMENT_LEGAL = _FRAGMENT_PLAIN + r"'\[\]%"

# Letters and digits one by one: a class of single characters is a table, one of ranges a
# row of tests, and these two patterns look at every character of every reference.
_ALNUM = string.ascii_letters + string.digits
_CONTROLS = "".join(rf"\x{c:02x}" for c in (*range(32), 127))

# A path that resolves to itself, with or without a query: legal characters, no
# segment that is empty or starts with a dot.
_PLAIN_PATH = (
    rf"(?:/(?![/.])[{_ALNUM}\-_.~$&+,:;=@!'()*\[\]]*+)++(?:\?[^#{_CONTROLS}]*+)?$"
)

# A whole URL of the commonest kind, for which nothing is to be escaped, checked or cut:
# http or https, a plain host, no empty or dotted segment, no fragment.
_PLAIN_URL = (
    rf"^https?://[{_ALNUM}.-]++(?::[0-9]++)?"
    rf"(?:/(?=\?|\z)|(?:/(?![/.])[{_ALNUM}\-_.~$&+,:;=@!'()*\[\]]++)++)(?:\?[^#{_CONTROLS}]*+)?\z"
)

_CONTROL = r"[\x00-\x1f\x7f]"
_TRIPLET = r"%[0-9A-Fa-f]{2}"
_BAD_PERCENT = r"%(?![0-9A-Fa-f]{2})"
_AUTHORITY = (
    r"^//(?:[A-Za-z0-9\-._:~!$&'()*+,;=%@]*@)?"
    r"(?:\[[0-9A-Za-z:.%\-_~]+\]"
    r"|(?:[A-Za-z0-9\-_.~!$&'()*+,;=<>\"\[\]]|[^\x00-\x7f]|%[89A-Fa-f][0-9A-Fa-f]|%25)*)"
    r"(?::[0-9]*)?$"
)


def _matches(c: str, pattern: str) -> str:
    return f"{c} RLIKE {lit(pattern)}"


def _percent(s: str) -> str:
    return f"regexp_replace(hex(encode({s}, 'UTF-8')), '(..)', '%$1')"


def _escape_all(s: str, plain: str) -> str:
    """Undo the escapes that were not needed, escape what is not plain."""

    def unescape(p: str) -> str:
        char = f"char(CAST(conv(substr({p}, 2), 16, 10) AS INT))"
        return let(
            char,
            lambda c: case(
                (f"{_matches(p, '^%[0-7]')} AND {_matches(c, f'[{plain}]')}", c),
                default=f"upper({p})",
            ),
        )

    def piece(p: str) -> str:
        return case(
            (_matches(p, f"^{_TRIPLET}$"), unescape(p)),
            (_matches(p, f"^[{plain}]"), p),
            default=_percent(p),
        )

    pieces = find_all_sql(s, rf"[{plain}]++|{_TRIPLET}|(?:(?!{_TRIPLET})[^{plain}])++")
    return f"array_join({each(pieces, piece)}, '')"


def _escape_path(path: str) -> str:
    legal = _matches(path, f"^[{_PATH_LEGAL}]*+$")
    return f"IF({legal}, {path}, {_escape_all(path, _PATH_PLAIN)})"


def escape_path(path: str) -> Column:
    """A path made of legal characters stays as written, any other is escaped
    as a whole."""
    return expr(_escape_path(path))


def _escape_fragment(frag: str) -> str:
    escaped = f"concat('#', {_escape_all(f'substr({frag}, 2)', _FRAGMENT_PLAIN)})"
    return case(
        (f"{frag} IN ('', '#')", "''"),
        (_matches(frag, f"^#[{_FRAGMENT_LEGAL}]*+$"), frag),
        default=escaped,
    )


def _escape_authority(auth: str) -> str:
    pieces = find_all_sql(auth, r"[\x00-\x7f]++|[^\x00-\x7f]++")
    ascii_only = r"^[\x00-\x7f]"
    escaped = each(pieces, lambda p: f"IF({_matches(p, ascii_only)}, {p}, {_percent(p)})")
    return f"IF({_matches(auth, ascii_only + '*+$')}, {auth}, array_join({escaped}, ''))"


def parse_sql(url: str) -> str:
    """Struct of the escaped parts of a URL; NULL if it is not a URL."""

    def split(u: str) -> str:
        # one match for all five parts; a URL cannot contain the separator
        parts = f"split(regexp_replace({u}, {lit(_SPLIT)}, '$1\\0$2\\0$3\\0$4\\0$5'), '\\0')"
        named = let(
            parts,
            lambda p: struct(
                scheme=f"lower({p}[0])",
                authority=f"{p}[1]",
                path=f"{p}[2]",
                query=f"{p}[3]",
                fragment=f"{p}[4]",
            ),
        )
        return f"IF({u} IS NULL OR {_matches(u, _CONTROL)}, NULL, {named})"

    def check(s: str) -> str:
        no_authority = f"{s}.authority = ''"
        opaque = f"({s}.scheme != '' AND {no_authority} AND NOT startswith({s}.path, '/'))"
        bad = " OR ".join(
            [
                f"({s}.scheme = '' AND {no_authority} AND {_matches(f'{s}.path', '^[^/]*:')})",
                f"(NOT {opaque} AND {_matches(f'{s}.path', _BAD_PERCENT)})",
                _matches(f"{s}.fragment", _BAD_PERCENT),
                f"NOT ({no_authority} OR {_matches(f'{s}.authority', _AUTHORITY)})",
            ]
        )
        parts = struct(
            scheme=f"{s}.scheme",
            authority=_escape_authority(f"{s}.authority"),
            path=f"IF({opaque}, {s}.path, {_escape_path(f'{s}.path')})",
            query=f"{s}.query",
            fragment=_escape_fragment(f"{s}.fragment"),
            opaque=opaque,
        )
        return f"IF({bad}, NULL, {parts})"

    def plain(u: str) -> str:
        rest = let(
            f"split({u}, '/', 4)",
            lambda p: struct(scheme=f"substring_index({u}, ':', 1)", authority=f"concat('//', {p}[2])", rest=f"concat('/', {p}[3])"),
        )
        return let(
            rest,
            lambda p: struct(
                scheme=f"{p}.scheme",
                authority=f"{p}.authority",
                path=f"substring_index({p}.rest, '?', 1)",
                query=f"IF(contains({p}.rest, '?'), substr({p}.rest, instr({p}.rest, '?')), '')",
                fragment="''",
                opaque="false",
            ),
        )

    def whole(u: str) -> str:
        any_ = let(split(u), lambda s: f"IF({s} IS NULL, NULL, {check(s)})")
        return f"IF({_matches(u, _PLAIN_URL)}, {plain(u)}, {any_})"

    return let(url, whole)


def _assemble(scheme: str, authority: str, path: str, query: str, fragment: str) -> str:
    return (
        f"concat(IF({scheme} = '', '', concat({scheme}, ':')),"
        f" IF({authority} = '//' AND {path} = '', '', {authority}),"
        f" {path}, {query}, {fragment})"
    )


def host_sql(authority: str) -> str:
    """``host[:port]`` of an authority, without user information."""
    return f"regexp_extract({authority}, '^//(?:.*@)?(.*)$', 1)"


def with_host_sql(p: str) -> str:
    """A parsed base: its ``host[:port]`` and ``scheme://authority`` as well."""
    names = ("scheme", "authority", "path", "query", "fragment", "opaque")
    known = f"{p}.scheme != '' AND {p}.authority NOT IN ('', '//')"
    return struct(
        **{n: f"{p}.{n}" for n in names},
        host=host_sql(f"{p}.authority"),
        origin=f"IF({known}, concat({p}.scheme, ':', {p}.authority), '')",
    )


def base_sql(url: str) -> str:
    """Parsed URL to resolve against, NULL if it does not parse."""
    return let(parse_sql(url), lambda b: f"IF({b} IS NULL, NULL, {with_host_sql(b)})")


def host_name_sql(url: str) -> str:
    without_port = lambda p: f"regexp_replace({host_sql(f'{p}.authority')}, ':[0-9]*$', '')"
    plain = lambda u: f"substring_index(split({u}, '/', 4)[2], ':', 1)"
    any_ = lambda u: let(parse_sql(u), lambda p: f"btrim({without_port(p)}, '[]')")
    return let(url, lambda u: f"IF({_matches(u, _PLAIN_URL)}, {plain(u)}, {any_(u)})")


def host_name(url: str) -> Column:
    """Host without port."""
    return expr(host_name_sql(url))


def _clean_path(path: str) -> str:
    """Resolve ``.`` and ``..`` segments; ``..`` never climbs above the root."""

    def resolve(p: str) -> str:
        # acc is the path so far without its first slash, NULL for "at the root"
        up = "IF(contains(acc, '/'), regexp_replace(acc, '/[^/]*+$', ''), NULL)"
        step = case(
            ("seg = '.'", "coalesce(acc, '')"),
            ("seg = '..'", up),
            default="coalesce(concat(acc, '/', seg), seg)",
        )
        merged = f"aggregate(split({p}, '/'), CAST(NULL AS STRING), (acc, seg) -> {step})"
        tail = f"IF({_matches(p, '(?:^|/)[.][.]?$')}, '/', '')"
        return f"regexp_replace(concat('/', coalesce({merged}, ''), {tail}), '^//', '/')"

    return let(
        path,
        lambda p: case(
            (_matches(p, "(?:^|/)[.][.]?(?:/|$)"), resolve(p)),
            (f"{p} = '' OR startswith({p}, '/')", p),
            default=f"concat('/', {p})",
        ),
    )


def resolve_parsed_sql(base: str, ref: str) -> str:
    """Resolve ``ref`` against a parsed base: struct(url, host, path).

    NULL if ``ref`` is not a URL. Without a base the reference is returned as is.
    """

    def target(r: str) -> str:
        absolute = f"({r}.scheme != '' OR {r}.authority != '')"
        same_doc = f"(NOT {absolute} AND {r}.path = '' AND {r}.query = '')"
        path = case(
            (f"{absolute} OR startswith({r}.path, '/')", f"{r}.path"),
            (f"{r}.path = ''", f"{base}.path"),
            default=f"concat(regexp_replace({base}.path, '[^/]*+$', ''), {r}.path)",
        )
        return struct(
            scheme=f"IF({r}.scheme != '', {r}.scheme, {base}.scheme)",
            authority=f"IF({absolute}, {r}.authority, {base}.authority)",
            path=f"IF({r}.opaque, {r}.path, {_clean_path(path)})",
            query=f"IF({same_doc}, {base}.query, {r}.query)",
            fragment=f"IF({same_doc} AND {r}.fragment = '', {base}.fragment, {r}.fragment)",
            opaque=f"{r}.opaque",
        )

    def quick(r: str) -> str:
        # most references need nothing done: a plain path under the base's host,
        # or a plain absolute URL
        rooted = struct(
            url=f"concat({base}.origin, {r})",
            host=f"{base}.host",
            path=f"substring_index({r}, '?', 1)",
        )
        absolute = struct(
            url=r,
            host=f"split({r}, '/', 4)[2]",
            path=f"substring_index(substr({r}, length(split({r}, '/', 4)[2]) + instr({r}, '//') + 2), '?', 1)",
        )
        return case(
            (f"{base} IS NULL", unresolved(r)),
            (f"{base}.origin != '' AND {_matches(r, '^' + _PLAIN_PATH)}", rooted),
            (_matches(r, rf"^https?://[{_ALNUM}.-]++(?::[0-9]++)?" + _PLAIN_PATH), absolute),
            default=with_base(r),
        )

    def result(t: str) -> str:
        return struct(
            url=_assemble(
                f"{t}.scheme", f"{t}.authority", f"{t}.path", f"{t}.query", f"{t}.fragment"
            ),
            host=host_sql(f"{t}.authority"),
            path=f"IF({t}.opaque, '', {t}.path)",
        )

    def with_base(r: str) -> str:
        parsed = parse_sql(r)
        return let(parsed, lambda p: f"IF({p} IS NULL, NULL, {let(target(p), result)})")

    unresolved = lambda r: struct(
        url=r, host="CAST(NULL AS STRING)", path="CAST(NULL AS STRING)"
    )
    return let(ref, quick)


def resolve_url(base: str, ref: str) -> Column:
    """Absolute URL of ``ref`` on the page ``base``; NULL if it cannot be parsed."""
    return expr(let(base_sql(base), lambda b: f"{resolve_parsed_sql(b, ref)}.url"))


def canonical_sql(url: str, ignore_query: bool = False) -> str:
    slashes = "(?:/|%2[fF])"

    def path(p: str) -> str:
        trimmed = f"regexp_replace({p}.path, '(?<!/|%2[fF]){slashes}++$', '')"
        cut = case(
            (f"{p}.opaque", f"{p}.path"),
            (_matches(f"{p}.path", slashes + "$"), _escape_all(trimmed, _PATH_PLAIN)),
            default=f"{p}.path",
        )
        return let(cut, lambda c: f"IF({c} = '' AND NOT {p}.opaque, '/', {c})")

    def canon(p: str) -> str:
        query = "''" if ignore_query else f"{p}.query"
        built = let(
            path(p), lambda c: _assemble(f"{p}.scheme", f"{p}.authority", c, query, "''")
        )
        return f"IF({p}.scheme IN ('http', 'https'), {built}, NULL)"

    def whole(u: str) -> str:
        own = f"substring_index({u}, '?', 1)" if ignore_query else u
        return f"IF({_matches(u, _PLAIN_URL)}, {own}, {let(parse_sql(u), canon)})"

    return let(url, whole)


def canonical_url(url: str, ignore_query: bool = False) -> Column:
    """The form under which the crawl counts two URLs as one.

    http and https only (else NULL); no fragment; no trailing slashes; an empty
    path becomes ``/``; query and host case stay. ``ignore_query`` drops the
    query as well.
    """
    return expr(canonical_sql(url, ignore_query))


def is_http(url: str) -> Column:
    return expr(f"{url} RLIKE '^(?i:https?):'")


def link_type_sql(host: str, base_host: str) -> str:
    """``internal`` only if host and port equal the page's own."""
    return f"IF({host} = {base_host}, 'internal', 'external')"


def in_allowed_domain(url: str, domain: str, allow_external: bool = False) -> Column:
    """Host is ``domain`` or ``www.domain``; always true if external is allowed."""
    if allow_external:
        return F.lit(True)
    scope = let(host_name_sql(url), lambda h: in_list(h, (domain, "www." + domain)))
    return expr(f"coalesce({scope}, false)")


def path_extension_sql(path: str) -> str:
    """Lower-cased suffix from the last dot of the last path segment, or NULL."""
    decoded = lambda e: f"coalesce(try_url_decode(replace({e}, '+', '%2B')), {e})"
    return let(
        f"regexp_extract({path}, '[.][^./]*+$', 0)",
        lambda e: non_empty(f"lower(IF(contains({e}, '%'), {decoded(e)}, {e}))"),
    )


def url_extension(url: str) -> Column:
    ext = let(parse_sql(url), lambda p: f"IF({p}.opaque, NULL, {path_extension_sql(f'{p}.path')})")
    return expr(ext)


def with_scheme(url: str) -> Column:
    """Prefix ``https://`` unless the URL names http or https already."""
    return expr(
        f"IF(startswith({url}, 'http://') OR startswith({url}, 'https://'),"
        f" {url}, concat('https://', {url}))"
    )
