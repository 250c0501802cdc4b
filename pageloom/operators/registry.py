"""The extractors a run uses: built-in ones and those a user adds."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from types import ModuleType

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pageloom.operators import api, assets, emails, forms, links, metadata, phones, social
from pageloom.plans.checkpoints import stored
from pageloom.schema import ITEM, ORD, PAGE, PAGE_ITEM
from pageloom.sources.pages import as_pages, is_ok

log = logging.getLogger(__name__)

BUILT_IN: dict[str, ModuleType] = {
    m.NAME: m for m in (links, forms, emails, phones, social, metadata, assets, api)
}

_ERROR = T.StructType(
    [T.StructField("extractor", T.StringType()), T.StructField("error", T.StringType())]
)
_FOUND = T.StructType(
    [T.StructField("items", T.ArrayType(PAGE_ITEM)), T.StructField("errors", T.ArrayType(_ERROR))]
)
_KINDS = {f.name: f.dataType for f in PAGE.fields}


def _plain(value, kind: T.DataType):
    """A value out of an Arrow column, as a row of a DataFrame would hold it."""
    if value is None:
        return None
    if isinstance(kind, T.TimestampType):
        return value.astimezone().replace(tzinfo=None)
    if isinstance(kind, T.MapType):
        return dict(value)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return [x if x is None else Row(**x) for x in value]
    return value


def found_by(extractors: dict[str, tuple[Callable[[dict], Iterable], list[str]]], first: int = 0) -> Column:
    """Column struct<items, errors> of all row-level Python functions together.

    A batch of pages crosses to Python once, whatever the number of functions, and only
    the columns that one of them asks for. Each function gets one page as a dict and yields
    findings: dicts with ``value`` and optionally ``type`` and ``metadata``. An exception
    costs this extractor's items of this page and nothing else, and is listed in
    ``errors``. ``first`` is the number of the first function in its registry."""
    wanted = list(dict.fromkeys(c for _, columns in extractors.values() for c in columns))

    def one(nth: int, name: str, fn: Callable, page: dict) -> tuple[list, str | None]:
        try:
            found = []
            for pos, x in enumerate(fn(page) or ()):
                meta = [(str(k), str(v)) for k, v in (x.get("metadata") or {}).items()]
                kind = str(x.get("type", name))
                place = {"nth": nth, "phase": 0, "pos": pos, "sub": 0}
                found.append({"type": kind, "value": str(x["value"]), "metadata": meta, "ord": place})
            return found, None
        except Exception as e:  # noqa: BLE001 - user code, any failure is theirs
            return [], f"{type(e).__name__}: {e}"

    def run(pages: pa.Array) -> pa.Array:
        values = [[_plain(v, _KINDS[c]) for v in pages.field(c).to_pylist()] for c in wanted]
        out = []
        for ok, *cells in zip(pages.is_valid().to_pylist(), *values, strict=True):
            row, found, errors = dict(zip(wanted, cells, strict=True)), [], []
            for nth, (name, (fn, columns)) in enumerate(extractors.items(), first):
                if ok:
                    items, error = one(nth, name, fn, {c: row[c] for c in columns})
                    found += items
                    if error is not None:
                        errors.append({"extractor": name, "error": error})
            out.append({"items": found, "errors": errors})
        return pa.array(out, to_arrow_type(_FOUND))

    # failed fetches reach the functions as NULL: they are never called for them
    return F.arrow_udf(run, _FOUND)(F.when(is_ok(), F.struct(*wanted)))


@dataclass
class Registry:
    """Extractors in the order in which their items are listed.

    ``frames`` map a page table to an items table, ``rows`` one page to its
    findings (see ``found_by``).
    """

    built_in: list[str] = field(default_factory=lambda: list(BUILT_IN))
    options: dict[str, dict] = field(default_factory=dict)
    rows: dict[str, tuple[Callable, list[str]]] = field(default_factory=dict)
    frames: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    def register(
        self,
        name: str,
        fn: Callable,
        row_level: bool = False,
        columns: Iterable[str] = ("page_id", "url", "final_url", "raw_html", "rendered_html"),
    ) -> None:
        """Add an extractor: DataFrame of pages -> DataFrame of items, or with
        ``row_level`` one page (a dict of ``columns``) -> findings."""
        if name in self.names():
            raise ValueError(f"extractor {name!r} is registered already")
        if row_level:
            unknown = set(columns) - set(PAGE.names)
            if unknown:
                raise ValueError(f"not page columns: {sorted(unknown)}")
            self.rows[name] = (fn, list(columns))
        else:
            self.frames[name] = fn

    def names(self) -> list[str]:
        return [*self.built_in, *self.rows, *self.frames]

    def frame_items(self, pages: DataFrame) -> list[tuple[str, DataFrame | None, str | None]]:
        """(name, items, error) of every frame-level extractor, over pages that were fetched.

        Each runs here, into the shared folder, so that one that fails while it runs
        costs its own items and nothing else. On a stream nothing can run ahead."""
        out = []
        good = as_pages(pages).where(is_ok())
        first = len(self.built_in) + len(self.rows)
        for nth, (name, fn) in enumerate(self.frames.items(), first):
            try:
                items = _as_items(fn(good), nth)
                out.append((name, items if pages.isStreaming else stored(items), None))
            except Exception as e:  # noqa: BLE001 - user code, the others must run
                log.exception("extractor %s failed and is skipped", name)
                out.append((name, None, f"{type(e).__name__}: {e}"))
        return out


def _as_items(items: DataFrame, nth: int) -> DataFrame:
    """A user's items table in the common layout: missing columns NULL, places numbered."""
    have = set(items.columns)
    own = items.schema["ord"].dataType.names if "ord" in have else []
    place = [F.lit(nth).alias("nth")]
    place += [(F.col(f"ord.{n}") if n in own else F.lit(None)).cast("int").alias(n) for n in ORD.names[1:]]
    columns = [
        F.struct(*place) if f.name == "ord" else F.col(f.name) if f.name in have else F.lit(None)
        for f in ITEM.fields
    ]
    return items.select(*[c.cast(f.dataType).alias(f.name) for c, f in zip(columns, ITEM.fields, strict=True)])


def default_registry() -> Registry:
    return Registry()
