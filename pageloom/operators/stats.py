"""Counts over items, pages and crawl logs.

A crawl log is any table with ``event_type``, ``ts`` (event time) and, for the
page events, ``status_code`` and ``duration_ns``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.core import expr, lit
from pageloom.schema import ITEM_TYPES
from pageloom.sources.pages import status_class

# Short names used in count labels.
SHORT_NAMES = {"api_endpoint": "api", "metadata": "meta"}


def items_by_type(items: DataFrame) -> DataFrame:
    """type, n"""
    return items.groupBy("type").agg(F.count("*").alias("n"))


def type_counts(with_items: DataFrame, types: tuple[str, ...] = ITEM_TYPES) -> DataFrame:
    """Add one count column per item type to a ``page_items`` table, in its rows."""
    # one pass over the array, then one lookup per type
    listed = with_items.withColumn("_types", expr("transform(items, i -> i.type)"))
    return listed.withColumns(
        {t: expr(f"CAST(size(filter(_types, t -> t = {lit(t)})) AS BIGINT)") for t in types}
    ).drop("_types")


def page_item_counts(items: DataFrame) -> DataFrame:
    """page_id and one count column per type, from an items table.

    Sums per type instead of a pivot: one shuffle of at most one row per task and
    page. For pages that still hold their items use ``type_counts``, which needs
    none."""
    return items.groupBy("page_id").agg(*[F.count_if(F.col("type") == t).alias(t) for t in ITEM_TYPES])


def count_label() -> Column:
    """``[link:3 api:1 meta:2]``: fixed order, zeros left out, empty if none."""
    terms = [
        f"IF({t} > 0, concat('{SHORT_NAMES.get(t, t)}:', {t}), NULL)" for t in ITEM_TYPES
    ]
    joined = f"concat_ws(' ', {', '.join(terms)})"
    return expr(f"IF({' + '.join(ITEM_TYPES)} > 0, concat('[', {joined}, ']'), '')")


def item_totals(items: DataFrame) -> DataFrame:
    """One row: total_items and the map items_by_type, of whatever types there are."""
    return items_by_type(items).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_items"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("items_by_type"),
    )


def _log_totals(log: DataFrame) -> DataFrame:
    n = lambda e: F.count_if(F.col("event_type") == e)
    return log.agg(
        n("page_queued").alias("pages_queued"),
        n("page_done").alias("pages_crawled"),
        n("page_error").alias("pages_errored"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("finished_at"),
        # works for both timestamp types, whatever the session's time zone
        F.expr(
            "CAST(CAST(CAST(max(ts) - min(ts) AS INTERVAL SECOND) AS DECIMAL(20, 6)) * 1000000000 AS BIGINT)"
        ).alias("elapsed_ns"),
    )


def crawl_stats(log: DataFrame, items: DataFrame) -> DataFrame:
    """One row: queued, crawled, errored, items, by type, elapsed, pages per second."""
    rate = expr("IF(elapsed_ns > 0, pages_crawled / (elapsed_ns / 1e9D), 0D)")
    return (
        _log_totals(log)
        .crossJoin(item_totals(items))  # one row each
        .select(
            "pages_queued",
            "pages_crawled",
            "pages_errored",
            F.col("total_items").alias("items_extracted"),
            "items_by_type",
            "elapsed_ns",
            rate.alias("pages_per_sec"),
        )
    )


def crawl_summary(log: DataFrame, items: DataFrame, target_url: str) -> DataFrame:
    """One row: target, start, end, duration, totals, items by type."""
    return (
        _log_totals(log)
        .crossJoin(item_totals(items))  # one row each
        .select(
            F.lit(target_url).alias("target_url"),
            "started_at",
            "finished_at",
            F.col("elapsed_ns").alias("duration_ns"),
            F.col("pages_crawled").alias("total_pages"),
            F.col("pages_errored").alias("total_errors"),
            "total_items",
            "items_by_type",
        )
    )


def status_classes(pages: DataFrame) -> DataFrame:
    """status_class, n"""
    return pages.groupBy(status_class().alias("status_class")).agg(F.count("*").alias("n"))


def event_counts(log: DataFrame) -> DataFrame:
    """event_type, n; batch or stream."""
    return log.groupBy("event_type").agg(F.count("*").alias("n"))
