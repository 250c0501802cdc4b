"""The plain-text report of a crawl."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions.core import expr
from pageloom.functions.text import format_duration_sql
from pageloom.operators.registry import Registry
from pageloom.operators.stats import count_label, crawl_summary, type_counts
from pageloom.plans.checkpoints import stored
from pageloom.plans.pipeline import page_items
from pageloom.schema import ITEM_TYPES
from pageloom.sources.pages import as_pages, is_ok


def report_lines(pages: DataFrame, registry: Registry | None = None, log: DataFrame | None = None) -> DataFrame:
    """page_id, line_no, line: a line per page, then one per item of it. Failed
    fetches are not reported. With the log of the crawl the closing lines follow, without
    a page_id: pages, errors and time by the log, and the totals of the items listed.

    The lines of a page are made in its row; nothing is shuffled or sorted. For the totals
    they are made once, into the shared folder."""
    counted = type_counts(page_items(pages, registry).where(is_ok())).withColumn("label", count_label())
    head = (
        "concat('  [', coalesce(status_code, 0), '] ', url, ' (',"
        f" {format_duration_sql('coalesce(fetch_duration_ns, 0)')}, ') ', label)"
    )
    body = "transform(items, i -> concat('      +-- ', i.type, ': ', i.value))"
    lines = expr(f"concat(array({head}), {body})")
    if log is None:
        return counted.select("page_id", F.posexplode(lines).alias("line_no", "line"))
    types = expr("transform(items, i -> i.type)")
    made = stored(counted.select("page_id", lines.alias("lines"), types.alias("types")))
    summary = crawl_summary(log, made.select(F.explode("types").alias("type")), "")
    closing = summary_lines(summary).select(F.lit(None).cast("long").alias("page_id"), "line_no", "line")
    return made.select("page_id", F.posexplode("lines").alias("line_no", "line")).unionByName(closing)


def summary_lines(summary: DataFrame) -> DataFrame:
    """line_no, line: the closing lines, with the crawl's real totals."""
    types = ", ".join(
        f"IF(items_by_type['{t}'] > 0, concat('{t}:', items_by_type['{t}']), NULL)"
        for t in ITEM_TYPES
    )
    lines = [
        "'  Crawl complete'",
        "concat('    Pages:  ', total_pages, ' crawled, ', total_errors, ' errors')",
        f"concat('    Items:  ', total_items, ' extracted in ', {format_duration_sql('duration_ns')})",
        f"IF(total_items > 0, concat('    Types:  ', concat_ws(', ', {types})), NULL)",
    ]
    rows = expr(f"filter(array({', '.join(lines)}), l -> l IS NOT NULL)")
    return summary.select(F.posexplode(rows).alias("line_no", "line"))


def header_lines(summary: DataFrame) -> DataFrame:
    """line_no, line: target and start of the crawl."""
    started = "date_format(started_at, 'EEE, dd MMM yyyy HH:mm:ss z')"
    rows = expr(f"array(concat('  Target: ', target_url), concat('  Started: ', {started}))")
    return summary.select(F.posexplode(rows).alias("line_no", "line"))


def write_report(pages: DataFrame, summary: DataFrame, path: str, registry=None) -> None:
    """Text files in three folders: header, pages (as many files as tasks), summary.

    Lines of one page stay together and in order; pages keep the order of their
    input splits. The summary is made once, into the shared folder, for both of its ends."""
    summary = stored(summary)
    header_lines(summary).orderBy("line_no").select("line").write.text(f"{path}/header")
    report_lines(as_pages(pages), registry).select("line").write.text(f"{path}/pages")
    summary_lines(summary).orderBy("line_no").select("line").write.text(f"{path}/summary")
