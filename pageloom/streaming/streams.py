"""The same work on streams of pages and crawl events.

A page arrives as one row, so extraction keeps no state: it runs in append mode
and a stream gives the rows a batch run gives.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pageloom.functions.urls import canonical_url
from pageloom.operators.registry import Registry
from pageloom.operators.stats import event_counts, type_counts
from pageloom.plans.checkpoints import exists, is_folder, listed, removed
from pageloom.plans.pipeline import extract_all, nested, page_items, page_results
from pageloom.schema import ITEM_TYPES
from pageloom.sinks.writers import Writer, fetched
from pageloom.sources.pages import as_pages, dealt, is_ok


def read_page_stream(
    spark: SparkSession,
    path: str,
    schema: StructType,
    format: str = "parquet",
    glob: str | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """Pages from files that arrive in ``path``."""
    reader = spark.readStream.format(format).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return as_pages(reader.load(path))


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The rows of the table ``folder/name``, a file or a folder of files, as a stream.

    A stream reads folders: a file is picked from the one it lies in."""
    path = f"{folder}/{name}"
    reader = spark.readStream.format("parquet").schema(spark.read.parquet(path).schema)
    if is_folder(spark, path):
        return reader.load(path)
    return reader.option("pathGlobFilter", name).load(folder)


def stream_extract(pages: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Items of a page stream; stateless, append mode. Failed pages give none."""
    return extract_all(pages.where(is_ok()), registry)


def stream_stats(pages: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Running totals over a page stream, one row: pages, errors, items and items
    by type, pages per second between the first and last fetch.

    A column per built-in type, and per name of a registered row-level extractor,
    whose items have that type unless they name another; the total has them all, and
    ``run_stats`` counts whatever types there are.
    The counts are made in the page's row; the state is a single row."""
    types = (*ITEM_TYPES, *(registry.rows if registry else ()))
    counted = type_counts(page_items(pages, registry), types)
    ok = F.coalesce(is_ok(), F.lit(False))
    seconds = (
        F.unix_micros(F.max("fetched_at")) - F.unix_micros(F.min("fetched_at"))
    ) / F.lit(1e6)
    done = F.count_if(ok)
    return counted.groupBy().agg(
        done.alias("pages_crawled"),
        F.count_if(~ok).alias("pages_errored"),
        F.sum(F.when(ok, F.size("items")).otherwise(0)).cast("bigint").alias("items_extracted"),
        *[
            F.coalesce(F.sum(F.when(ok, F.col(t))), F.lit(0)).cast("bigint").alias(t)
            for t in types
        ],
        F.when(seconds > 0, done / seconds).otherwise(F.lit(0.0)).alias("pages_per_sec"),
    )


def stream_new_urls(urls: DataFrame, column: str = "url", watermark: tuple[str, str] | None = None) -> DataFrame:
    """Each canonical URL once.

    Without a watermark the state remembers every URL for good, as a crawl does: about
    a hundred bytes and the URL for each, on the executors' disks if the stream is started
    by ``run_available`` or within ``state_on_disk``.
    With ``(time column, delay)`` it forgets a URL after the delay: bounded state,
    but a URL that comes back later is new again."""
    canonical = urls.withColumn("url", canonical_url(column)).where("url IS NOT NULL")
    if watermark is None:
        return canonical.select("url").dropDuplicates(["url"])
    time, delay = watermark
    return (
        canonical.select("url", time).withWatermark(time, delay).dropDuplicatesWithinWatermark(["url"])
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def rocksdb_state(spark: SparkSession) -> None:
    """State of streams started from now on lives on the executors' disks."""
    spark.conf.set(_PROVIDER, ROCKSDB)


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """As ``rocksdb_state``, for the streams started inside the block: a stream keeps the
    settings it was started with, and the session gets its own back. A session that names
    a state store already keeps it."""
    before = spark.conf.get(_PROVIDER, None)
    if before is None or before.endswith("HDFSBackedStateStoreProvider"):
        rocksdb_state(spark)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER)
        if before is not None and spark.conf.get(_PROVIDER, None) != before:
            spark.conf.set(_PROVIDER, before)


def stream_event_counts(log: DataFrame) -> DataFrame:
    """Running count per event type."""
    return event_counts(log)


def run_available(df: DataFrame, path: str, checkpoint: str, format: str = "parquet") -> None:
    """Process what has arrived and stop; append mode into files.

    State, where there is any, is kept on the executors' disks: a URL that
    ``stream_new_urls`` remembers takes its bytes and about a hundred more there, and
    as much in the checkpoint."""
    writer = (
        df.writeStream.format(format)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
    )
    with state_on_disk(df.sparkSession):
        query = writer.start(path)
    query.awaitTermination()


# ---- running totals of whatever types there are, and writers that end

TOTALS = (
    "pages_crawled long, pages_errored long, items_extracted long, items_by_type map<string, bigint>,"
    " started_at timestamp, finished_at timestamp"
)


def batch_totals(with_items: DataFrame) -> DataFrame:
    """One row of ``TOTALS`` over a ``page_items`` table, with a count for every type that occurs.

    One pass: a page becomes a row for itself and one per type it has, and both are added up
    by type before anything is shuffled."""
    ok = F.coalesce(is_ok(), F.lit(False))
    own = "named_struct('type', CAST(NULL AS STRING), 'n', 0L)"
    types = "transform(items, i -> i.type)"
    per_type = f"transform(array_distinct({types}), t -> named_struct('type', t, 'n', CAST(size(filter({types}, x -> x = t)) AS BIGINT)))"
    rows = with_items.select(ok.alias("ok"), "fetched_at", F.inline_outer(F.expr(f"concat(array({own}), {per_type})")))
    page = F.col("type").isNull()
    summed = rows.groupBy("type").agg(
        F.count_if(page & F.col("ok")).alias("crawled"),
        F.count_if(page & ~F.col("ok")).alias("errored"),
        F.sum("n").alias("n"),
        F.min("fetched_at").alias("first"),
        F.max("fetched_at").alias("last"),
    )
    entries = F.filter(F.collect_list(F.struct("type", "n")), lambda e: e["type"].isNotNull())
    return summed.agg(
        F.coalesce(F.sum("crawled"), F.lit(0)).alias("pages_crawled"),
        F.coalesce(F.sum("errored"), F.lit(0)).alias("pages_errored"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("items_extracted"),
        F.map_from_entries(F.sort_array(entries)).alias("items_by_type"),
        F.min("first").alias("started_at"),
        F.max("last").alias("finished_at"),
    )


def merged_totals(totals: DataFrame) -> DataFrame:
    """One row of ``TOTALS`` out of several."""
    add = "aggregate(collect_list(items_by_type), CAST(map() AS MAP<STRING, BIGINT>), (a, m) -> map_zip_with(a, m, (k, x, y) -> coalesce(x, 0L) + coalesce(y, 0L)))"
    return totals.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pages_crawled", "pages_errored", "items_extracted")],
        F.expr(add).alias("items_by_type"),
        F.min("started_at").alias("started_at"),
        F.max("finished_at").alias("finished_at"),
    )


class RunningTotals:
    """Totals over the batches of a stream, each batch counted exactly once.

    After batch n the totals lie in ``folder/upto=n``, made of those of the batch before and
    the batch's own; writing them again gives the same row, and a batch whose totals are
    there has been dealt with. One row and one small file per batch; older ones are deleted
    two batches later, so a batch that fails finds those it starts from."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, batch: int) -> str:
        return f"{self.folder}/upto={batch}"

    def done(self, batch: int) -> bool:
        return exists(self.spark, f"{self._path(batch)}/_SUCCESS")

    def last(self, before: float = float("inf")) -> int:
        """The last batch with totals (of those before a given one), -1 if there is none."""
        names = [int(n[5:]) for n in listed(self.spark, self.folder) if n.startswith("upto=")]
        return max((n for n in names if n < before and self.done(n)), default=-1)

    def add(self, batch: int, own: DataFrame) -> None:
        before, parts = self.last(batch), own
        if before >= 0:
            parts = parts.unionByName(self.spark.read.schema(TOTALS).parquet(self._path(before)))
        merged_totals(parts).coalesce(1).write.mode("overwrite").parquet(self._path(batch))
        for old in listed(self.spark, self.folder):
            if old.startswith("upto=") and int(old[5:]) < batch - 1:
                removed(self.spark, f"{self.folder}/{old}")

    def read(self) -> DataFrame:
        """One row of ``TOTALS``: all batches so far."""
        last = self.last()
        if last < 0:
            return merged_totals(self.spark.createDataFrame([], TOTALS))
        return self.spark.read.schema(TOTALS).parquet(self._path(last))


def run_stats(pages: DataFrame, folder: str, checkpoint: str, registry: Registry | None = None, **trigger) -> StreamingQuery:
    """Running totals of a page stream, read with ``RunningTotals(spark, folder).read()``.

    As ``stream_stats``, but a finding counts under whatever type it names: the types need
    not be known before."""
    totals = RunningTotals(pages.sparkSession, folder)

    def count(batch: DataFrame, number: int) -> None:
        if not totals.done(number):
            totals.add(number, batch_totals(page_items(dealt(batch), registry)))

    return _each_batch(as_pages(pages), count, checkpoint, **trigger)


def _each_batch(pages: DataFrame, what, checkpoint: str, **trigger) -> StreamingQuery:
    return (
        pages.writeStream.foreachBatch(what)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def run_writer_stream(
    pages: DataFrame, writer: Writer, folder: str, target_url: str, registry: Registry | None = None
) -> DataFrame:
    """Hand a custom writer all pages that have arrived, batch by batch, then the summary, once.

    ``folder`` keeps the stream's checkpoint and the totals. A batch is handed to the
    writer and then counted; one that has been counted is not handed over again when
    a run is repeated. (A run that ends between the two repeats the batch under the same
    number, so a writer should overwrite by number.) When all batches are through, ``finalize``
    gets the one-row summary over all runs so far, unless it has had that one: after a run that
    fails it isn't called, and a run that finds nothing new doesn't call it again. Frame-level
    extractors run per batch. Returns the summary."""
    spark = pages.sparkSession
    totals = RunningTotals(spark, f"{folder}/totals")

    def hand_over(batch: DataFrame, number: int) -> None:
        if totals.done(number):
            return
        found = page_items(dealt(batch), registry).persist(StorageLevel.DISK_ONLY)
        try:
            writer.write_results(fetched(nested(found)), number)
            totals.add(number, batch_totals(found))
        finally:
            found.unpersist()

    _each_batch(as_pages(pages), hand_over, f"{folder}/checkpoint").awaitTermination()
    nanos = F.expr("(unix_micros(finished_at) - unix_micros(started_at)) * 1000")
    summary = totals.read().select(
        F.lit(target_url).alias("target_url"),
        "started_at",
        "finished_at",
        nanos.alias("duration_ns"),
        F.col("pages_crawled").alias("total_pages"),
        F.col("pages_errored").alias("total_errors"),
        F.col("items_extracted").alias("total_items"),
        "items_by_type",
    )
    ended = f"{folder}/ended/upto={totals.last()}"
    if not exists(spark, f"{ended}/_SUCCESS"):
        writer.finalize(summary)
        spark.range(0).write.mode("overwrite").parquet(ended)
    return summary


def write_stream(
    pages: DataFrame,
    writer: Writer,
    checkpoint: str,
    registry: Registry | None = None,
    **trigger,
) -> StreamingQuery:
    """Page results to a custom writer, batch by batch. When the query has ended,
    ``writer.finalize`` is for the caller, who knows that it won't go on."""
    return (
        page_results(pages.where(is_ok()), registry)
        .writeStream.foreachBatch(writer.write_results)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
