"""From pages to findings.

All findings of a page are made, de-duplicated and ordered inside its row, so
the whole way from the scan to ``extract_all`` or ``page_results`` is one stage
without a shuffle: it reads every page once and parallelises over input splits,
whatever a site's or URL's share of the pages.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions.core import expr, struct
from pageloom.functions.html import document_sql
from pageloom.functions.text import strip_tags_sql
from pageloom.operators.items import ANCHORS, BASE, DOCUMENT, HTML, TEXT, inline_rows, numbered
from pageloom.operators.links import resolved_anchors_sql
from pageloom.operators.registry import BUILT_IN, Registry, default_registry, found_by
from pageloom.plans.checkpoints import shared_dir, stored
from pageloom.schema import ITEM, PAGE, PAGE_ITEM
from pageloom.sources.pages import BASE as BASE_SQL
from pageloom.sources.pages import EFFECTIVE_HTML, as_pages, is_ok

ITEMS = T.ArrayType(PAGE_ITEM)


@cache
def _document(names: tuple[str, ...]) -> str:
    used = [BUILT_IN[n] for n in names]
    tags = tuple(dict.fromkeys(t for m in used for t in m.TAGS))
    inside = {c: tags for m in used for c, tags in getattr(m, "INSIDE", {}).items()}
    return document_sql(HTML, tags, inside) if tags else "NULL"


@cache
def _anchors() -> str:
    return resolved_anchors_sql()


@cache
def _items(name: str) -> str:
    return f"coalesce({BUILT_IN[name].items_sql()}, array())"


def prepare(pages: DataFrame, names: list[str]) -> DataFrame:
    """Pages with what the named extractors share: effective HTML, parsed base,
    the elements they ask for (shredded once for all of them), naive text."""
    pages = as_pages(pages)
    shared = {
        BASE: expr(BASE_SQL),
        DOCUMENT: expr(_document(tuple(names))),
        TEXT: expr(strip_tags_sql(HTML)),
    }
    html = F.when(is_ok(), expr(EFFECTIVE_HTML))  # a failed fetch is not taken apart
    ready = pages.withColumn(HTML, html).withColumns(shared)
    if {"links", "social"} & set(names):
        ready = ready.withColumn(ANCHORS, expr(_anchors()))
    return ready


def page_items(pages: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Pages plus ``items``: array of their findings in registry order.

    Failed fetches have none. Items of frame-level extractors are joined in by
    page_id, which a stream can't do."""
    reg = registry or default_registry()
    rows = _row_items(pages, reg)
    if not reg.frames:
        return rows
    if pages.isStreaming:
        raise ValueError("frame-level extractors can't be joined to a stream's pages; use extract_all")
    found = None
    for n, (_, items, _) in enumerate(reg.frame_items(pages)):
        if items is not None:
            items = items.withColumn("_n", F.lit(n))
            found = items if found is None else found.unionByName(items)
    if found is None:
        return rows
    listed = F.sort_array(F.collect_list(F.struct("_n", "ord", "type", "value", F.to_json("metadata").alias("m"))))
    more = found.groupBy("page_id").agg(listed.alias("_more")).withColumnRenamed("page_id", "_page")
    own = (
        "transform(coalesce(_more, array()), i -> named_struct('type', i.type, 'value', i.value,"
        " 'metadata', from_json(i.m, 'map<string,string>'), 'ord', i.ord))"
    )
    joined = rows.join(more, rows["page_id"] == more["_page"], "left")
    return joined.select(*PAGE.names, F.concat("items", F.expr(own).cast(ITEMS)).alias("items"))


#: what row-level functions found on a page, and what failed
_FOUND = "_found"


def _row_items(pages: DataFrame, reg: Registry, *more) -> DataFrame:
    """Pages, their items by built-in and row-level extractors, and ``more`` columns."""
    parts = []
    for nth, name in enumerate(reg.built_in):
        opts = reg.options.get(name)
        sql = f"coalesce({BUILT_IN[name].items_sql(**opts)}, array())" if opts else _items(name)
        parts.append(expr(numbered(sql, nth)))
    ready = prepare(pages, reg.built_in)
    if reg.rows:
        ready = ready.withColumn(_FOUND, found_by(reg.rows, len(reg.built_in)))
        parts.append(F.col(f"{_FOUND}.items"))
    items = F.concat(*parts) if parts else expr("array()")
    kept = F.when(is_ok(), items.cast(ITEMS)).otherwise(expr("array()").cast(ITEMS))
    return ready.select(*PAGE.names, kept.alias("items"), *more)


def explode_items(with_items: DataFrame) -> DataFrame:
    """One row per finding of a ``page_items`` table."""
    rows = inline_rows(with_items, "items", "page_id", F.col("url").alias("source_url"))
    return rows.select("page_id", "type", "value", "source_url", "metadata", "ord")


def extract(pages: DataFrame, name: str, **options) -> DataFrame:
    """Items of one built-in extractor."""
    reg = Registry(built_in=[name], options={name: options} if options else {})
    return explode_items(page_items(pages, reg))


def extract_all(pages: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Items of all extractors: one row per finding."""
    reg = registry or default_registry()
    items = explode_items(_row_items(pages, reg))
    for _, custom, _ in reg.frame_items(pages):
        if custom is not None:
            items = items.unionByName(custom)
    return items


def extract_checked(
    pages: DataFrame, registry: Registry, folder: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(items, errors) of all extractors from one run: what ``extract_all`` and
    ``extractor_errors`` give, but every page is taken apart once and every function called
    once for it. The findings and failures are written together, into ``folder`` or below
    the shared one, and both tables read them from there."""
    spark = pages.sparkSession
    path = folder or shared_dir(spark)
    frames = registry.frame_items(pages)
    none = expr("CAST(array() AS array<struct<extractor: string, error: string>>)")
    errors = F.col(f"{_FOUND}.errors") if registry.rows else none
    rows = _row_items(pages, registry, errors.alias("_errors"))
    names = PAGE_ITEM.names
    kinds = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in PAGE_ITEM.fields)
    kind = f"array<struct<{kinds}, extractor: string, error: string>>"
    finding = struct(**{n: f"i.{n}" for n in names}, extractor="NULL", error="NULL")
    failure = struct(**dict.fromkeys(names, "NULL"), extractor="e.extractor", error="e.error")
    both = (
        f"concat(CAST(transform(items, i -> {finding}) AS {kind}),"
        f" CAST(transform(_errors, e -> {failure}) AS {kind}))"
    )
    listed = rows.select("page_id", F.col("url").alias("source_url"), expr(both).alias("_rows"))
    flat = listed.select("page_id", "source_url", F.inline_outer("_rows")).where("type IS NOT NULL OR extractor IS NOT NULL")
    run = stored(flat, path)
    items = run.where("extractor IS NULL").select(*ITEM.names)
    failed = run.where("extractor IS NOT NULL").select("page_id", F.col("source_url").alias("url"), "extractor", "error")
    for name, custom, error in frames:
        if custom is not None:
            items = items.unionByName(custom)
        else:
            whole = spark.createDataFrame([(None, None, name, error)], failed.schema)
            failed = failed.unionByName(whole)
    return items, failed


def extractor_errors(pages: DataFrame, registry: Registry) -> DataFrame:
    """What failed: page_id, url, extractor, error.

    A row-level extractor fails page by page, a frame-level one as a whole (page_id and
    url are NULL). Failed fetches are never handed to either. Runs the registered functions
    and nothing else; ``extract_checked`` gives the items of the same run too."""
    pages = as_pages(pages)
    whole = [(None, None, name, error) for name, _, error in registry.frame_items(pages) if error]
    schema = "page_id long, url string, extractor string, error string"
    out = pages.sparkSession.createDataFrame(whole, schema)
    if not registry.rows:
        return out
    found = pages.select("page_id", "url", found_by(registry.rows)["errors"].alias("_errors"))
    return inline_rows(found, "_errors", "page_id", "url").unionByName(out)


def page_results(pages: DataFrame, registry: Registry | None = None) -> DataFrame:
    """struct page and array extracted_items per page; pages without items stay, and
    failed fetches, which have none.

    The nested items keep their order. Needs no join: the items are made in the
    page's row."""
    return nested(page_items(pages, registry))


def nested(with_items: DataFrame) -> DataFrame:
    """``page_results`` out of a ``page_items`` table."""
    return with_items.select(
        F.struct(*PAGE.names).alias("page"),
        F.expr(
            "transform(items, i -> named_struct('type', i.type, 'value', i.value,"
            " 'source_url', url, 'metadata', i.metadata))"
        ).alias("extracted_items"),
    )


def attach_items(pages: DataFrame, items: DataFrame) -> DataFrame:
    """Left join of pages with an items table: one row per page and item, pages
    without items once.

    Items are never broadcast: how many a page has can't be told from the size of the
    files that the pages were read from."""
    own = items.select("page_id", "type", "value", "metadata", "ord")
    return pages.join(own.hint("merge"), "page_id", "left")
