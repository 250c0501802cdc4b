"""Writing items and page results."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.sources.pages import is_ok

# Names and order of the page fields in written results. Headers
# and both HTML columns stay out.
_PAGE_FIELDS = {
    "url": "page.url",
    "final_url": "page.final_url",
    "status_code": "page.status_code",
    "content_type": "page.content_type",
    "fetched_at": "page.fetched_at",
    "fetch_duration": "page.fetch_duration_ns",
    "fetcher_used": "page.fetcher_used",
    "intercepted_requests": "IF(size(page.intercepted_requests) > 0, page.intercepted_requests, NULL)",
    "error": "nullif(page.error, '')",
    "depth": "page.depth",
    "response_size": "page.response_size",
    "technologies": "IF(size(page.technologies) > 0, page.technologies, NULL)",
}


def result_rows(results: DataFrame) -> DataFrame:
    """``page_results`` in the layout that is written: empty optional values NULL,
    so JSON leaves them out."""
    page = F.struct(*[F.expr(e).alias(n) for n, e in _PAGE_FIELDS.items()])
    items = F.expr(
        "transform(extracted_items, i -> named_struct('type', i.type, 'value', i.value,"
        " 'source_url', i.source_url, 'metadata', IF(size(i.metadata) > 0, i.metadata, NULL)))"
    )
    return results.select(page.alias("page"), items.alias("extracted_items"))


def write_results(results: DataFrame, path: str, format: str = "json", mode: str = "errorifexists") -> None:
    """Persist ``page_results``; failed fetches are left out."""
    result_rows(fetched(results)).write.format(format).mode(mode).save(path)


def fetched(results: DataFrame) -> DataFrame:
    """Results of pages that could be fetched."""
    names = results.schema["page"].dataType.names
    return results.where(is_ok("page.") if {"error", "status_code"} <= set(names) else F.lit(True))


def write_items(items: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists") -> None:
    """Persist an items table, one folder per item type.

    Rows are brought together by type first, and a type with many rows is split again
    by size, so that a folder has few and full files."""
    flat = items.select("page_id", "type", "value", "source_url", "metadata").hint("rebalance", "type")
    flat.write.format(format).mode(mode).partitionBy("type").save(path)


class Writer(Protocol):
    """A custom sink: results in one or more tables, then the summary, once."""

    def write_results(self, results: DataFrame, batch: int) -> None: ...

    def finalize(self, summary: DataFrame) -> None: ...


def run_writer(writer: Writer, results: DataFrame, summary: DataFrame) -> None:
    """Hand a custom writer the results of all fetched pages as batch 0, then the one-row summary.

    If the results can't be written the writer is not finalised."""
    writer.write_results(fetched(results), 0)
    writer.finalize(summary)
