"""API endpoints among the calls a page made."""

from __future__ import annotations

from pyspark.sql import Column

from pageloom.functions.core import each, each_indexed, expr, first_by_key, in_list, keep, lit, non_empty, struct, text_map
from pageloom.operators.items import item

NAME, TYPE, TAGS = "api_endpoints", "api_endpoint", ()

# What is a static file and no endpoint.
STATIC_TYPES = ("image", "stylesheet", "font", "media", "manifest", "texttrack")
STATIC_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp", ".avif",
    ".css", ".woff", ".woff2", ".ttf", ".eot", ".otf",
    ".mp4", ".webm", ".mp3", ".wav", ".ogg",
    ".map",
)
_STATIC_URL = "(?i)" + "|".join("[.]" + e[1:] for e in STATIC_EXTENSIONS)


def is_static_sql(url: str, resource_type: str) -> str:
    by_type = in_list(f"lower({resource_type})", STATIC_TYPES)
    return f"(coalesce({by_type}, false) OR {url} RLIKE '{_STATIC_URL}')"


def is_static_resource(url: str, resource_type: str) -> Column:
    """By type, or by a file extension anywhere in the URL."""
    return expr(is_static_sql(url, resource_type))


def items_sql() -> str:
    numbered = each_indexed(
        "coalesce(intercepted_requests, array())",
        lambda r, i: struct(
            i=i,
            url=f"{r}.url",
            method=f"coalesce({r}.method, '')",
            content_type=f"{r}.content_type",
            resource_type=f"{r}.resource_type",
        ),
    )
    dynamic = keep(
        numbered,
        lambda r: f"{r}.url IS NOT NULL AND NOT {is_static_sql(f'{r}.url', f'{r}.resource_type')}",
    )
    return each(
        first_by_key(dynamic, lambda r: f"concat({r}.method, ' ', {r}.url)"),
        lambda r: item(
            TYPE,
            f"{r}.url",
            text_map(
                method=f"{r}.method",
                content_type=non_empty(f"{r}.content_type"),
                resource_type=non_empty(f"{r}.resource_type"),
            ),
            0,
            f"{r}.i",
        ),
    )
