"""Page tables: reading, normalising and preparing captured pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions.core import case, each, expr, in_list, keep, let, struct
from pageloom.functions.text import clip_bytes
from pageloom.functions.urls import in_allowed_domain, parse_sql, with_host_sql, with_scheme
from pageloom.schema import PAGE

# Fixed value: default limit on the bytes kept of a response body.
MAX_BODY_BYTES = 4_194_304

# Resource types of calls worth keeping.
CAPTURED_TYPES = ("xhr", "fetch", "websocket", "eventsource", "other")


def as_pages(df: DataFrame) -> DataFrame:
    """Give any table the page layout: known columns cast, missing ones NULL.

    ``html`` is taken for ``raw_html``, a missing ``final_url`` is the ``url``, and a
    missing ``page_id`` a hash of what tells captures apart: URL, time and body. Only
    columns present are selected from the source, so pruning still works. A table that
    has the layout is left as it is.
    """
    if df.columns == PAGE.names:
        return df
    have = set(df.columns)
    body = [c for c in ("url", "fetched_at", "raw_html", "html", "rendered_html") if c in have]
    fallback: dict[str, Column] = {"final_url": F.col("url"), "page_id": F.xxhash64(*body)}
    if "html" in have:
        fallback["raw_html"] = F.col("html")

    def column(name: str) -> Column:
        if name in have and name in fallback and name != "final_url":
            return F.coalesce(F.col(name), fallback[name])
        return F.col(name) if name in have else fallback.get(name, F.lit(None))

    return df.select(*[column(f.name).cast(f.dataType).alias(f.name) for f in PAGE.fields])


def spread(scan: DataFrame) -> DataFrame:
    """Use all cores on input that has fewer splits than the cluster has cores.

    Extraction is bound by CPU, so for such small input a shuffle of the rows pays
    off. Input with enough splits is left alone. For scans only: on other plans
    counting partitions may run them."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def dealt(rows: DataFrame, per_task: int | None = None) -> DataFrame:
    """Rows dealt evenly over tasks: four a core, and no more than ``per_task`` to a task.

    A number of splits says little about where the rows are: a file may be cut into many
    and have all rows in one of them, where its only row group lies. For narrow rows that
    pages are made of, and for batches of a stream, which may be a single file."""
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(tasks if per_task is None else max(tasks, -(-rows.count() // per_task)))


def read_pages(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Captured pages from files. JSON and CSV are read with the declared schema, never
    by inference; CSV, with a header, has the columns that are no lists or maps."""
    reader = spark.read.format(format)
    declared = T.StructType([*PAGE.fields, T.StructField("html", T.StringType())])
    if format == "csv":
        flat = [f for f in declared if not isinstance(f.dataType, T.ArrayType | T.MapType)]
        given = spark.read.option("header", True).csv(path).columns
        kinds = {f.name: f for f in flat}
        declared = T.StructType([kinds.get(c, T.StructField(c, T.StringType())) for c in given])
        reader = reader.options(header=True, multiLine=True, escape='"')
    if format in ("json", "csv"):
        reader = reader.schema(declared)
    return as_pages(spread(reader.load(path)))


def seed_urls(df: DataFrame, column: str = "url") -> DataFrame:
    """Seeds with the scheme they lack."""
    return df.withColumn(column, with_scheme(column))


EFFECTIVE_HTML = "coalesce(nullif(rendered_html, ''), nullif(raw_html, ''))"


def effective_html() -> Column:
    """Rendered HTML if there is any, else the raw HTML; NULL if both are empty."""
    return expr(EFFECTIVE_HTML)


# The final URL if it parses, else the requested one; NULL or '' counts as missing.
_FINAL = parse_sql("nullif(final_url, '')")
BASE = let(
    f"coalesce({_FINAL}, {parse_sql('url')})",
    lambda b: f"IF({b} IS NULL, NULL, {with_host_sql(b)})",
)


def base_url() -> Column:
    """The URL against which a page's references are resolved."""
    return expr(f"IF({_FINAL} IS NOT NULL, final_url, url)")


def clip_body(pages: DataFrame, max_bytes: int = MAX_BODY_BYTES) -> DataFrame:
    """Keep at most ``max_bytes`` of each body, on a character boundary."""
    return pages.withColumn("raw_html", clip_bytes("raw_html", max_bytes)).withColumn(
        "response_size", F.octet_length("raw_html").cast("int")
    )


def is_ok(prefix: str = "") -> Column:
    """The fetch worked: no error, and a status below 203 where there is one."""
    error, status = f"{prefix}error", f"{prefix}status_code"
    return expr(f"({error} IS NULL OR {error} = '') AND ({status} IS NULL OR {status} < 203)")


def split_ok_failed(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages to extract from, and failed fetches."""
    return pages.where(is_ok()), pages.where(~is_ok())


def capture_filter(pages: DataFrame) -> DataFrame:
    """Of all intercepted calls keep the kinds worth keeping."""
    kept = keep(
        "intercepted_requests", lambda r: in_list(f"lower({r}.resource_type)", CAPTURED_TYPES)
    )
    return pages.withColumn("intercepted_requests", expr(kept))


def header_map(pairs: str) -> Column:
    """array<struct<name, value>> -> map of header name to its values in order.

    Names are compared and written in the usual form (``Content-Type``)."""
    canonical = lambda n: f"replace(initcap(replace({n}, '-', ' ')), ' ', '-')"
    named = each(pairs, lambda p: struct(n=canonical(f"{p}.name"), v=f"{p}.value"))
    by_name = lambda a: each(
        f"array_distinct({each(a, lambda p: f'{p}.n')})",
        lambda n: struct(
            k=n, v=each(keep(a, lambda p: f"{p}.n = {n}"), lambda p: f"{p}.v")
        ),
    )
    return expr(f"get(transform(array({named}), a -> map_from_entries({by_name('a')})), 0)")


def with_provenance(pages: DataFrame, fetcher: str = "http") -> DataFrame:
    """Fill what a capture leaves open: final URL, fetcher, time, depth."""
    return pages.withColumns(
        {
            "final_url": expr("coalesce(nullif(final_url, ''), url)"),
            "fetcher_used": F.coalesce("fetcher_used", F.lit(fetcher)),
            "fetched_at": F.coalesce("fetched_at", F.current_timestamp()),
            "depth": F.coalesce("depth", F.lit(0)),
        }
    )


def allowed_domain_filter(pages: DataFrame, domain: str, allow_external: bool = False) -> DataFrame:
    """Pages whose host is in scope."""
    return pages.where(in_allowed_domain("url", domain, allow_external))


def status_class() -> Column:
    """Label of a page's status code."""
    return expr(
        case(
            ("status_code >= 200 AND status_code < 300", "'2xx'"),
            ("status_code >= 300 AND status_code < 400", "'3xx'"),
            ("status_code >= 400", "'error'"),
            default="'other'",
        )
    )
