"""Images, scripts, stylesheets, fonts, icons, linked files, video and audio."""

from __future__ import annotations

from pageloom.functions.core import EMPTY_MAP, case, each, first_by_key, in_list, keep, let, lit, struct, text_map
from pageloom.functions.text import truncate_sql
from pageloom.functions.urls import path_extension_sql
from pageloom.operators.items import DOCUMENT, ELEMENTS, item
from pageloom.operators.links import resolved_sql

NAME, TYPE = "assets", "asset"
TAGS = ("img", "script", "link", "a", "picture", "video", "audio")
INSIDE = {
    "picture": ("source",),
    "video": ("video", "source"),
    "audio": ("audio", "source"),
}

# Linked files that count as assets, in order of precedence.
FILE_TYPES = {
    ".pdf": "document",
    ".doc": "document",
    ".docx": "document",
    ".xls": "spreadsheet",
    ".xlsx": "spreadsheet",
    ".csv": "data",
    ".zip": "archive",
    ".tar": "archive",
    ".gz": "archive",
    ".rar": "archive",
    ".mp4": "video",
    ".webm": "video",
    ".mp3": "audio",
    ".wav": "audio",
    ".svg": "image",
}
_NAMES_FILE = f"'(?i)[.](?:{'|'.join(ext[1:] for ext in FILE_TYPES)})(?:[?]|$)'"


def _tags(own: str, tag: str, test: str = "true") -> str:
    return f"filter({own}, e -> e.tag = '{tag}' AND {test})"


def _candidate(raw: str, kind: str, tag: str, phase: int, pos: str, sub="0", extra=EMPTY_MAP) -> str:
    return struct(
        raw=raw, kind=kind, tag=f"'{tag}'", phase=str(phase), pos=pos, sub=sub, extra=extra
    )


def _srcset(elements: str, tag: str, phase: int, extra=lambda e: EMPTY_MAP) -> str:
    """First word of each comma-separated entry."""
    word = lit(r"(?U)^\s*+(\S++)")

    def urls(e: str) -> str:
        words = f"transform(split({e}.attrs['srcset'], ','), s -> regexp_extract(s, {word}, 1))"
        return (
            f"transform(filter({words}, w -> w != ''), (w, j) -> "
            f"{_candidate('w', lit('image'), tag, phase, f'{e}.pos', 'j', extra(e))})"
        )

    return f"flatten({each(elements, urls)})"


def _inside(container: str) -> str:
    """Elements inside the page's ``container`` elements, numbered over the page."""
    return (
        f"transform(flatten({DOCUMENT}.{container}), (e, i) -> "
        f"{struct(pos='i', tag='e.tag', attrs='e.attrs')})"
    )


def file_type_sql(href: str) -> str:
    kind = let(
        f"lower({href})",
        lambda h: case(
            *[
                (f"endswith({h}, '{ext}') OR contains({h}, '{ext}?')", f"'{kind}'")
                for ext, kind in FILE_TYPES.items()
            ]
        ),
    )
    # one test settles the many anchors that link no file
    return f"IF({href} RLIKE {_NAMES_FILE}, {kind}, NULL)"


def candidates_sql() -> str:
    """All asset references in order of precedence, still unresolved."""
    # the page's other elements, mostly anchors, are passed over once
    return let(keep(ELEMENTS, lambda e: in_list(f"{e}.tag", ("img", "script", "link"))), _candidates)


def _candidates(own: str) -> str:
    images = each(
        _tags(own, "img", "e.attrs['src'] IS NOT NULL"),
        lambda e: _candidate(
            f"{e}.attrs['src']",
            "'image'",
            "img",
            0,
            f"{e}.pos",
            extra=text_map(
                alt=f"IF({e}.attrs['alt'] != '', {truncate_sql(f'''{e}.attrs['alt']''', 200)}, NULL)",
                width=f"{e}.attrs['width']",
                height=f"{e}.attrs['height']",
            ),
        ),
    )
    img_srcset = _srcset(_tags(own, "img", "e.attrs['srcset'] IS NOT NULL"), "img-srcset", 1)
    picture_srcset = _srcset(
        keep(_inside("picture"), lambda e: f"{e}.attrs['srcset'] IS NOT NULL"),
        "picture-source",
        2,
        lambda e: text_map(media_type=f"nullif({e}.attrs['type'], '')"),
    )
    scripts = each(
        _tags(own, "script", "e.attrs['src'] IS NOT NULL"),
        lambda e: _candidate(
            f"{e}.attrs['src']",
            "'script'",
            "script",
            3,
            f"{e}.pos",
            extra=text_map(
                script_type=f"{e}.attrs['type']",
                **{
                    "async": f"IF({e}.attrs['async'] IS NOT NULL, 'true', NULL)",
                    "defer": f"IF({e}.attrs['defer'] IS NOT NULL, 'true', NULL)",
                },
            ),
        ),
    )

    def linked(test: str, kind: str, tag: str, phase: int, **extra: str) -> str:
        return each(
            _tags(own, "link", test),
            lambda e: _candidate(
                f"coalesce({e}.attrs['href'], '')",
                lit(kind),
                tag,
                phase,
                f"{e}.pos",
                extra=text_map(**{k: f"{e}.attrs['{v}']" for k, v in extra.items()})
                if extra
                else EMPTY_MAP,
            ),
        )

    styles = linked("e.attrs['rel'] = 'stylesheet'", "stylesheet", "link", 4, media="media")
    fonts = linked(
        "e.attrs['rel'] = 'preload' AND e.attrs['as'] = 'font'", "font", "link-preload", 5
    )
    icons = linked(
        "e.attrs['rel'] IN ('icon', 'shortcut icon', 'apple-touch-icon')", "icon", "link", 6, rel="rel"
    )
    files = keep(
        each(
            _tags(ELEMENTS, "a", f"e.attrs['href'] RLIKE {_NAMES_FILE}"),
            lambda e: _candidate(
                f"{e}.attrs['href']", file_type_sql(f"{e}.attrs['href']"), "a", 7, f"{e}.pos"
            ),
        ),
        lambda c: f"{c}.kind IS NOT NULL",
    )

    def media(tag: str, phase: int) -> str:
        found = keep(_inside(tag), lambda e: f"{e}.attrs['src'] != ''")
        return each(
            found, lambda e: _candidate(f"{e}.attrs['src']", f"'{tag}'", tag, phase, f"{e}.pos")
        )

    parts = (
        images,
        img_srcset,
        picture_srcset,
        scripts,
        styles,
        fonts,
        icons,
        files,
        media("video", 8),
        media("audio", 9),
    )
    return f"concat({', '.join(parts)})"


def items_sql() -> str:
    found = first_by_key(
        resolved_sql(candidates_sql(), lambda c: f"{c}.raw"), lambda x: f"{x}.to.url"
    )
    return each(
        found,
        lambda x: item(
            TYPE,
            f"{x}.to.url",
            "map_concat("
            + text_map(
                asset_type=f"{x}.of.kind",
                tag=f"{x}.of.tag",
                extension=path_extension_sql(f"coalesce({x}.to.path, '')"),
            )
            + f", {x}.of.extra)",
            f"{x}.of.phase",
            f"{x}.of.pos",
            f"{x}.of.sub",
        ),
    )
