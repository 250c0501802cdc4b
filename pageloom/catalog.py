"""Named queries over the driver tables, at least one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.text import (
    decode_entities,
    format_duration,
    normalize_phone,
    strip_tags,
    trim_space,
    truncate_text,
)
from pageloom.functions.urls import (
    canonical_url,
    host_name,
    is_http,
    resolve_url,
    url_extension,
)
from pageloom.operators import stats
from pageloom.operators.items import keep_first
from pageloom.operators.registry import Registry
from pageloom.operators.social import platforms_of
from pageloom.operators.shred import contained_elements, select_elements, shred_html
from pageloom.plans import crawl as crawling
from pageloom.plans import platforms
from pageloom.plans import report
from pageloom.plans.checkpoints import shared_dir
from pageloom.plans.growing import GrowingCrawl, run_crawl_stream
from pageloom.plans.pipeline import (
    attach_items,
    extract,
    extract_all,
    extract_checked,
    extractor_errors,
    page_items,
    page_results,
)
from pageloom.schema import ITEM_TYPES
from pageloom.sinks.writers import result_rows, run_writer, write_items, write_results
from pageloom.sources import pages as P
from pageloom.sources.corpora import (
    crawl_log,
    customer_pages,
    document_pages,
    site_pages,
    table,
    varied_pages,
    visit_pages,
)
from pageloom.streaming import streams

SEED = "shop.test"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def pages(spark: SparkSession, d: str) -> DataFrame:
    return P.read_pages(spark, f"{d}/pages.parquet")


def meta(*keys: str, **renamed: str) -> list:
    names = {k: k for k in keys} | {v: k for k, v in renamed.items()}
    return [F.col("metadata")[key].alias(out) for out, key in names.items()]


# ---- links and URLs


@query
def links(spark, d):
    return extract(pages(spark, d), "links").select(
        "page_id", "value", "source_url", *meta("link_type", "anchor_text", "rel")
    )


@query
def links_site(spark, d):
    return extract(customer_pages(spark, d), "links").select(
        "page_id", "value", *meta("link_type", "anchor_text", "rel")
    )


@query
def links_by_type(spark, d):
    return links_site(spark, d).groupBy("link_type").agg(F.count("*").alias("n"))


@query
def link_edges(spark, d):
    return crawling.link_edges(pages(spark, d))


@query
def resolved_urls(spark, d):
    refs = F.explode(F.array(*[F.lit(r) for r in RESOLVE_REFS]))
    pairs = pages(spark, d).select("page_id", "url", refs.alias("ref"))
    return pairs.select("page_id", "ref", resolve_url("url", "ref").alias("resolved"))


# references whose resolution needs no more than the base's origin in SQL
RESOLVE_REFS = (
    "/a/b", "//cdn.test/x", "https://h.test/y?q#f", "/a/./b/../c", "/../up", "/sp ace!", "mailto:a@b.co",
    "/x?q=a b#fr", "a:b:c", "1x:y", "/%zz",
)


@query
def canonical_urls(spark, d):
    return pages(spark, d).select("page_id", "url", canonical_url("url").alias("canonical"))


@query
def unique_paths(spark, d):
    return crawling.unique_paths(pages(spark, d).select("page_id", "url"))


@query
def http_urls(spark, d):
    links_ = extract(customer_pages(spark, d), "social").select("page_id", "value")
    return links_.where(is_http("value"))


@query
def allowed_domain(spark, d):
    return P.allowed_domain_filter(pages(spark, d), "ththhe.example.com").select("page_id", "url")


@query
def host_names(spark, d):
    return pages(spark, d).groupBy(host_name("url").alias("host")).agg(F.count("*").alias("n"))


@query
def seed_urls(spark, d):
    raw = table(spark, d, "customer").select(
        "c_custkey",
        F.concat(
            F.element_at(F.array(F.lit(""), F.lit("http://"), F.lit("https://"), F.lit("HTTP://")),
                         (F.col("c_custkey") % 4 + 1).cast("int")),
            F.lit("shop.test/c/"), "c_custkey",
        ).alias("url"),
    )
    return P.seed_urls(raw)


@query
def url_extensions(spark, d):
    return pages(spark, d).select("page_id", url_extension("url").alias("extension"))


@query
def base_urls(spark, d):
    redirected = customer_pages(spark, d).withColumn(
        "final_url",
        F.expr("CASE page_id DIV 8 % 4 WHEN 0 THEN '' WHEN 1 THEN concat(url, '#x') WHEN 2 THEN 'http://a b/' END"),
    )
    return redirected.select("page_id", P.base_url().alias("base"))


@query
def provenance(spark, d):
    out = P.with_provenance(customer_pages(spark, d).withColumn("final_url", F.lit("")))
    return out.select(
        "page_id", "final_url", "fetcher_used", "depth", F.col("fetched_at").isNotNull().alias("timed")
    )


# ---- HTML and text


@query
def element_counts(spark, d):
    els = shred_html(pages(spark, d))
    return els.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query
def element_attributes(spark, d):
    els = select_elements(shred_html(customer_pages(spark, d), ("img", "link", "meta")), "img", present="width")
    return els.select("page_id", "tag", F.explode("attrs").alias("name", "value"))


@query
def inner_text(spark, d):
    els = shred_html(pages(spark, d), ("a", "h1", "title", "script"))
    return els.select("page_id", "pos", "tag", "text")


@query
def descendants(spark, d):
    found = contained_elements(customer_pages(spark, d), "picture", ("source",))
    return found.select("page_id", "parent", "tag", F.col("attrs")["srcset"].alias("srcset"))


@query
def selected_prefix(spark, d):
    els = shred_html(customer_pages(spark, d), ("a",))
    return select_elements(els, "a", prefix={"href": "mailto:"}).select(
        "page_id", F.col("attrs")["href"].alias("href")
    )


@query
def stripped_text(spark, d):
    return pages(spark, d).select("page_id", strip_tags("raw_html").alias("text"))


@query
def decoded_entities(spark, d):
    return pages(spark, d).select("page_id", decode_entities("raw_html").alias("decoded"))


@query
def clip_body(spark, d):
    return P.clip_body(pages(spark, d), 1000).select("page_id", "raw_html", "response_size")


@query
def effective_html(spark, d):
    rendered = customer_pages(spark, d).withColumn(
        "rendered_html", F.expr("CASE page_id % 3 WHEN 0 THEN concat('R', page_id) WHEN 1 THEN '' END")
    ).withColumn("raw_html", F.expr("IF(page_id % 5 = 0, '', concat('W', page_id))"))
    html = rendered.select("page_id", P.effective_html().alias("html"))
    return html.where("html IS NOT NULL")


@query
def truncated_text(spark, d):
    return table(spark, d, "documents").select("doc_id", truncate_text("text", 200).alias("text"))


@query
def trimmed_text(spark, d):
    padded = table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit(" \t　\xa0"), "text", F.lit("\n ")).alias("t")
    )
    return padded.select("doc_id", trim_space("t").alias("text"))


# ---- e-mails, phones, social


@query
def emails(spark, d):
    docs = extract(document_pages(spark, d), "emails", denied_suffixes=(), denied_parts=())
    return docs.select("page_id", "value", *meta("source"))


@query
def emails_pages(spark, d):
    found = extract(pages(spark, d), "emails", denied_suffixes=(), denied_parts=())
    return found.select("page_id", "value", *meta("source"))


@query
def emails_default_deny(spark, d):
    found = extract(document_pages(spark, d), "emails").unionByName(
        extract(customer_pages(spark, d), "emails")
    )
    return found.select("page_id", "value", *meta("source"))


@query
def phones(spark, d):
    found = extract(document_pages(spark, d), "phones")
    return found.select("page_id", "value", *meta("normalized", "source"))


@query
def phones_site(spark, d):
    found = extract(customer_pages(spark, d), "phones")
    return found.select("page_id", "value", *meta("normalized", "source"))


@query
def normalized_phones(spark, d):
    return table(spark, d, "documents").select("doc_id", normalize_phone("text").alias("digits"))


@query
def social(spark, d):
    found = extract(customer_pages(spark, d), "social")
    return found.select("page_id", "value", *meta("platform", "anchor_text"))


@query
def social_table(spark, d):
    """Platforms from a user's table: a region each, told by the first digit of a customer's name there."""
    rows = table(spark, d, "region").select(
        F.lower("r_name").alias("platform"), F.concat(F.lit("github.com/CUST"), "r_regionkey").alias("pattern"),
        F.col("r_regionkey").alias("rank"),
    )
    found = extract(customer_pages(spark, d), "social", platforms=platforms_of(rows))
    return found.select("page_id", "value", *meta("platform"))


def _many_platforms(spark, d) -> DataFrame:
    """A pattern per customer, 97 platforms; patterns contain one another, later customers come first."""
    return table(spark, d, "customer").select(
        F.concat(F.lit("p"), F.col("c_custkey") % 97).alias("platform"),
        F.concat(F.lit("GitHub.com/cust"), "c_custkey").alias("pattern"),
        (-F.col("c_custkey")).alias("rank"),
    )


@query
def social_many(spark, d):
    """Platforms from a table with a pattern per customer, which is joined."""
    found = platforms.social_items(customer_pages(spark, d), _many_platforms(spark, d))
    return found.select("page_id", "value", *meta("platform", "anchor_text"))


# ---- forms, metadata, assets, API calls


@query
def forms(spark, d):
    found = extract(customer_pages(spark, d), "forms")
    return found.select(
        "page_id", "value", *meta("method", "action", "id", "input_count", "inputs", "enctype", "name")
    )


@query
def form_fields(spark, d):
    els = contained_elements(customer_pages(spark, d), "form", ("input", "select", "textarea"))
    return els.select("page_id", "parent", "pos", "tag", F.col("attrs")["name"].alias("name"))


@query
def metadata_all(spark, d):
    found = extract(pages(spark, d), "metadata")
    return found.select("page_id", "value", F.col("ord.phase").alias("phase"), *meta("field", "index"))


def _field(df: DataFrame, *fields: str) -> DataFrame:
    found = extract(df, "metadata").where(F.col("metadata")["field"].isin(*fields))
    return found.select("page_id", "value", *meta("field", "index"))


@query
def titles(spark, d):
    return _field(pages(spark, d), "title")


@query
def headings(spark, d):
    return _field(pages(spark, d), "h1", "h2", "h3", "h4", "h5", "h6")


@query
def language(spark, d):
    return _field(pages(spark, d), "language")


@query
def meta_tags(spark, d):
    return _field(customer_pages(spark, d), "description", "og:type")


@query
def canonical_links(spark, d):
    return _field(customer_pages(spark, d), "canonical")


@query
def json_ld(spark, d):
    return _field(customer_pages(spark, d), "json-ld")


_ASSET_KEYS = (
    "asset_type", "tag", "extension", "alt", "width", "height", "media_type", "script_type",
    "async", "defer", "media", "rel",
)


def _assets(spark, d, *tags: str) -> DataFrame:
    found = extract(customer_pages(spark, d), "assets").select("page_id", "value", *meta(*_ASSET_KEYS))
    return found.where(F.col("tag").isin(*tags)) if tags else found


@query
def assets_all(spark, d):
    return _assets(spark, d)


@query
def assets_images(spark, d):
    return _assets(spark, d, "img", "img-srcset", "picture-source").select(
        "page_id", "value", "tag", "extension", "alt", "width", "media_type"
    )


@query
def assets_scripts(spark, d):
    return _assets(spark, d, "script").select("page_id", "value", "script_type", "async", "defer")


@query
def assets_styles(spark, d):
    return _assets(spark, d, "link", "link-preload").select(
        "page_id", "value", "asset_type", "tag", "media", "rel"
    )


@query
def assets_files(spark, d):
    return _assets(spark, d, "a").select("page_id", "value", "asset_type", "extension")


@query
def assets_media(spark, d):
    return _assets(spark, d, "video", "audio").select("page_id", "value", "asset_type", "tag")


@query
def captured_requests(spark, d):
    kept = P.capture_filter(visit_pages(spark, d))
    return kept.select("page_id", F.size("intercepted_requests").cast("bigint").alias("n"))


@query
def api_endpoints(spark, d):
    found = extract(P.capture_filter(visit_pages(spark, d)), "api_endpoints")
    return found.select("page_id", "value", *meta("method", "content_type", "resource_type"))


@query
def static_resources(spark, d):
    from pageloom.operators.api import is_static_resource

    calls = visit_pages(spark, d).select("page_id", F.inline_outer("intercepted_requests"))
    static = calls.select(is_static_resource("url", "resource_type").alias("is_static"))
    return static.groupBy("is_static").agg(F.count("*").alias("n"))


@query
def header_maps(spark, d):
    named = table(spark, d, "events").select(
        "event_id",
        F.expr(
            "array(named_struct('name', 'content-type', 'value', event_type),"
            " named_struct('name', 'Set-cookie', 'value', concat('u=', user_id)),"
            " named_struct('name', 'set-Cookie', 'value', concat('e=', event_id)))"
        ).alias("pairs"),
    )
    maps = named.select("event_id", P.header_map("pairs").alias("headers"))
    return maps.select("event_id", F.explode("headers").alias("name", "vals")).select(
        "event_id", "name", F.array_join("vals", "|").alias("joined")
    )


# ---- items over all extractors


@query
def extract_all_pages(spark, d):
    return extract_all(pages(spark, d)).select("page_id", "type", "value", "source_url")


@query
def extract_all_site(spark, d):
    return extract_all(customer_pages(spark, d)).select("page_id", "type", "value", "source_url")


@query
def items_by_type(spark, d):
    return stats.items_by_type(extract_all(customer_pages(spark, d)))


@query
def page_item_counts(spark, d):
    return stats.page_item_counts(extract_all(customer_pages(spark, d)))


@query
def count_labels(spark, d):
    counted = stats.type_counts(page_items(customer_pages(spark, d)))
    return counted.select("page_id", stats.count_label().alias("label"))


@query
def page_result_sizes(spark, d):
    results = page_results(site_pages(spark, d))
    return results.select(
        F.col("page.page_id").alias("page_id"),
        F.size("extracted_items").cast("bigint").alias("n_items"),
        F.expr("get(extracted_items, 0).value").alias("first_value"),
        F.expr("get(extracted_items, 0).source_url").alias("source_url"),
    )


@query
def first_items(spark, d):
    items = extract(customer_pages(spark, d), "assets").withColumn(
        "kind", F.col("metadata")["asset_type"]
    )
    return keep_first(items, ["kind"]).select("page_id", "kind", "value")


@query
def items_with_pages(spark, d):
    some = customer_pages(spark, d)
    joined = attach_items(some.select("page_id", "status_code"), extract(some, "links"))
    return joined.groupBy("page_id", "status_code").agg(F.count("value").alias("n"))


def _with_custom() -> Registry:
    reg = Registry(built_in=["metadata"])

    def shout(page):
        if page["page_id"] % 16 == 11:
            raise ValueError("cannot read this page")
        return [{"value": page["url"].upper(), "metadata": {"n": len(page["url"])}}]

    reg.register("shout", shout, row_level=True, columns=("page_id", "url"))
    reg.register(
        "status",
        lambda df: df.select(
            "page_id",
            F.lit("status").alias("type"),
            F.col("status_code").cast("string").alias("value"),
            F.col("url").alias("source_url"),
        ),
    )
    return reg


@query
def custom_extractors(spark, d):
    items = extract_all(customer_pages(spark, d), _with_custom())
    return items.where("type IN ('shout', 'status')").select("page_id", "type", "value", *meta("n"))


@query
def custom_errors(spark, d):
    return extractor_errors(customer_pages(spark, d), _with_custom())


@query
def custom_checked(spark, d):
    """Findings and failures of one run, in registry order."""
    items, errors = extract_checked(customer_pages(spark, d), _with_custom())
    own = items.where("type IN ('shout', 'status')").select("page_id", F.col("ord.nth").cast("long").alias("nth"), "value")
    return own.unionByName(errors.select("page_id", F.lit(-1).cast("long").alias("nth"), F.col("error").alias("value")))


@query
def custom_results(spark, d):
    results = page_results(customer_pages(spark, d), _with_custom())
    kinds = F.expr("array_distinct(transform(extracted_items, i -> i.type))")
    return results.select(F.col("page.page_id").alias("page_id"), F.array_join(kinds, ",").alias("kinds"))


@query
def custom_report(spark, d):
    lines = report.report_lines(customer_pages(spark, d), _with_custom())
    return lines.where("line RLIKE 'shout|status'").select("page_id", "line")


@query
def custom_stats(spark, d):
    items = extract_all(customer_pages(spark, d), _with_custom())
    return stats.item_totals(items).select("total_items", F.explode("items_by_type").alias("type", "n"))


@query
def custom_frame_errors(spark, d):
    """A frame-level extractor that fails while it runs costs its own items only."""
    reg = _with_custom()
    broken = F.expr("IF(page_id >= 0, raise_error('cannot be'), '')")
    reg.register("broken", lambda df: df.select("page_id", broken.alias("value"), F.lit("broken").alias("type")))
    df = customer_pages(spark, d)
    failed = extractor_errors(df, reg).where("extractor = 'broken'").select(F.col("extractor").alias("type"))
    return stats.items_by_type(extract_all(df, reg)).unionByName(failed.withColumn("n", F.lit(-1).cast("long")))


# ---- pages that differ by key


@query
def varied_social(spark, d):
    found = extract(varied_pages(spark, d), "social")
    return found.select("page_id", "value", *meta("platform", "anchor_text"))


@query
def varied_files(spark, d):
    found = extract(varied_pages(spark, d), "assets")
    return found.select("page_id", "value", *meta("asset_type", "tag", "extension"))


@query
def varied_metadata(spark, d):
    return extract(varied_pages(spark, d), "metadata").select("page_id", "value", *meta("field", "index"))


@query
def varied_links(spark, d):
    found = extract(varied_pages(spark, d), "links")
    return found.select("page_id", "value", *meta("link_type", "anchor_text"))


# ---- crawling


@query
def crawl_depth3(spark, d):
    return crawling.crawl(site_pages(spark, d), SEED).drop("page_id")


@query
def crawl_capped(spark, d):
    return crawling.crawl(site_pages(spark, d), SEED, max_depth=4, max_pages=500).drop("page_id")


@query
def crawl_external(spark, d):
    reached = crawling.crawl(
        site_pages(spark, d), SEED, max_depth=4, max_pages=None, allow_external=True
    )
    return reached.drop("page_id")


@query
def crawl_deep(spark, d):
    return crawling.crawl(site_pages(spark, d), SEED, max_depth=7, max_pages=None).drop("page_id")


@query
def crawl_no_query(spark, d):
    return crawling.crawl(
        site_pages(spark, d), SEED, max_depth=4, max_pages=None, ignore_query_params=True
    ).drop("page_id")


@query
def crawl_redirected(spark, d):
    """Nations with odd numbers now answer from another host, whose pages were captured."""
    site = site_pages(spark, d)
    odd = "startswith(url, 'https://shop.test/n/') AND try_cast(substr(url, 21) AS INT) % 2 = 1"
    moved = site.withColumn("final_url", F.expr(f"IF({odd}, replace(url, 'shop.test/n', 'moved.test/n'), final_url)"))
    elsewhere = site.where("startswith(url, 'https://shop.test/c/')").withColumns(
        {"url": F.expr("replace(url, 'shop.test', 'moved.test')"), "final_url": F.expr("replace(url, 'shop.test', 'moved.test')"),
         "page_id": F.expr("page_id + 1000000000000")}
    )
    return crawling.crawl(moved.unionByName(elsewhere), SEED, max_depth=5, max_pages=None).drop("page_id")


@query
def crawl_recaptured(spark, d):
    """Every page was captured three times, without page_id; the first capture counts."""
    site = site_pages(spark, d).drop("page_id")
    again = site.withColumn("n", F.explode(F.array(*map(F.lit, (2, 0, 1))))).select(
        *[c for c in site.columns if c not in ("raw_html", "fetched_at", "status_code")],
        F.expr("timestamp_seconds(1700000000 + 60 * n)").alias("fetched_at"),
        F.expr("IF(n = 0, raw_html, '<a href=/later>later</a>')").alias("raw_html"),
        F.expr("IF(n = 0, status_code, 200)").alias("status_code"),
    )
    shuffled = again.repartition(7, F.xxhash64("url", "fetched_at"))
    return crawling.crawl(shuffled, SEED, max_depth=4, max_pages=None).drop("page_id")


@query
def crawl_growing(spark, d):
    """A crawl that a stream of pages extends in three batches."""
    path = shared_dir(spark)
    site = site_pages(spark, d)
    site.repartition(3, F.col("page_id") % 97).write.parquet(f"{path}/in")
    stream = streams.read_page_stream(spark, f"{path}/in", site.schema, max_files=1)
    growing = GrowingCrawl(spark, f"{path}/crawl", SEED, max_depth=3)
    run_crawl_stream(stream, growing, f"{path}/state").awaitTermination()
    return growing.reached().drop("page_id")


@query
def crawl_items(spark, d):
    site = site_pages(spark, d)
    reached = crawling.crawl(site, SEED, max_depth=4, max_pages=None)
    items = crawling.crawl_extract(site, reached)
    return stats.items_by_type(items)


# ---- crawl statistics and reports


@query
def crawl_stats(spark, d):
    out = stats.crawl_stats(crawl_log(spark, d), extract_all(pages(spark, d)))
    return out.select(
        "pages_queued", "pages_crawled", "pages_errored", "items_extracted",
        *[F.col("items_by_type")[t].alias(f"n_{t}") for t in ITEM_TYPES], "elapsed_ns",
        F.round("pages_per_sec", 6).alias("pages_per_sec"),
    )


def _summary(spark, d) -> DataFrame:
    return stats.crawl_summary(
        crawl_log(spark, d), extract_all(pages(spark, d)), "https://shop.test/"
    )


@query
def crawl_summary(spark, d):
    return _summary(spark, d).select(
        "target_url", "started_at", "finished_at", "duration_ns", "total_pages", "total_errors",
        "total_items",
        *[F.col("items_by_type")[t].alias(f"n_{t}") for t in ITEM_TYPES],
    )


@query
def status_classes(spark, d):
    return stats.status_classes(crawl_log(spark, d))


@query
def event_counts(spark, d):
    return stats.event_counts(crawl_log(spark, d))


@query
def durations(spark, d):
    ns = crawl_log(spark, d).select(
        "event_id", (F.col("duration_ns") * (1 + F.col("event_id") % 3 * 700)).alias("ns")
    )
    return ns.select("event_id", format_duration("ns").alias("duration"))


@query
def ok_failed(spark, d):
    ok, failed = P.split_ok_failed(crawl_log(spark, d))
    return (
        ok.select(F.lit("ok").alias("outcome"))
        .unionByName(failed.select(F.lit("failed").alias("outcome")))
        .groupBy("outcome")
        .agg(F.count("*").alias("n"))
    )


@query
def report_lines(spark, d):
    return report.report_lines(customer_pages(spark, d), log=crawl_log(spark, d))


@query
def summary_lines(spark, d):
    return report.summary_lines(_summary(spark, d))


@query
def report_header(spark, d):
    return report.header_lines(_summary(spark, d))


# ---- sinks and streams


@query
def written_results(spark, d):
    path = shared_dir(spark)
    write_results(page_results(customer_pages(spark, d)), f"{path}/results", "json")
    lines = spark.read.text(f"{path}/results")
    field = lambda p: F.get_json_object("value", p)
    return lines.select(
        field("$.page.url").alias("url"),
        field("$.page.status_code").alias("status_code"),
        field("$.page.raw_html").alias("raw_html"),
        field("$.page.error").alias("error"),
        field("$.extracted_items[0].value").alias("first_value"),
    )


@query
def written_items(spark, d):
    path = shared_dir(spark)
    write_items(extract_all(customer_pages(spark, d)), f"{path}/items")
    return spark.read.parquet(f"{path}/items").groupBy("type").agg(F.count("*").alias("n"))


@query
def result_json(spark, d):
    path = shared_dir(spark)
    write_results(page_results(visit_pages(spark, d)), f"{path}/results", "json")
    calls = F.get_json_object("value", "$.page.intercepted_requests")
    return spark.read.text(f"{path}/results").select(
        F.get_json_object("value", "$.page.url").alias("url"), F.json_array_length(calls).alias("calls")
    )


class _Folder:
    """A custom writer: results as JSON in one folder, the summary in another."""

    def __init__(self, path: str):
        self.path = path

    def write_results(self, results: DataFrame, batch: int) -> None:
        result_rows(results).write.json(f"{self.path}/results/batch={batch}")

    def finalize(self, summary: DataFrame) -> None:
        summary.select("target_url", "total_items").write.json(f"{self.path}/summary")


@query
def custom_writer(spark, d):
    path = shared_dir(spark)
    run_writer(_Folder(path), page_results(customer_pages(spark, d)), _summary(spark, d))
    written = spark.read.schema("page struct<url string>, extracted_items array<struct<type string>>").json(f"{path}/results")
    end = spark.read.schema("target_url string, total_items long").json(f"{path}/summary")
    pages_ = written.select(F.col("page.url").alias("name"), F.size("extracted_items").cast("long").alias("n"))
    return pages_.unionByName(end.select(F.col("target_url").alias("name"), F.col("total_items").alias("n")))


@query
def written_report(spark, d):
    path = shared_dir(spark)
    report.write_report(customer_pages(spark, d), _summary(spark, d), path)
    lines = spark.read.text(f"{path}/pages").unionByName(spark.read.text(f"{path}/summary"))
    return lines.groupBy(F.regexp_extract("value", r"^ *(\+-- [a-z_]+|\[[0-9]+\]|[A-Za-z]+)", 1).alias("kind")).agg(F.count("*").alias("n"))


@query
def json_pages(spark, d):
    """Pages from JSON lines with ``html`` or ``raw_html``, none with page_id, and a crawl over them."""
    path = shared_dir(spark)
    site = site_pages(spark, d).select("url", "raw_html", "status_code")
    old = site.where("xxhash64(url) % 2 = 0")
    new = site.where("xxhash64(url) % 2 <> 0").withColumnRenamed("raw_html", "html")
    old.write.json(f"{path}/pages/part=0")
    new.write.json(f"{path}/pages/part=1")
    read = P.read_pages(spark, f"{path}/pages", "json")
    return crawling.crawl(read, SEED, max_depth=4, max_pages=None).drop("page_id")


@query
def csv_pages(spark, d):
    path = shared_dir(spark)
    pages(spark, d).select("page_id", "url", F.col("raw_html").alias("html")).write.option("header", True).option("escape", '"').csv(path)
    found = extract(P.read_pages(spark, path, "csv"), "links")
    return found.select("page_id", "value", "source_url", *meta("link_type", "anchor_text", "rel"))


def _page_stream(spark, d) -> DataFrame:
    return P.as_pages(streams.table_stream(spark, d, "pages.parquet"))


@query
def stream_extract(spark, d):
    path = shared_dir(spark)
    items = streams.stream_extract(_page_stream(spark, d))
    streams.run_available(items.drop("ord"), f"{path}/out", f"{path}/state")
    out = spark.read.parquet(f"{path}/out")
    return out.select("page_id", "type", "value", "source_url")


@query
def stream_new_urls(spark, d):
    path = shared_dir(spark)
    found = streams.stream_extract(_page_stream(spark, d), Registry(built_in=["links"]))
    fresh = streams.stream_new_urls(found.select(F.col("value").alias("url")))
    streams.run_available(fresh, f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out")


def _drain(df: DataFrame, name: str) -> DataFrame:
    """Final state of a running aggregate that has one row, or one per event type."""
    path = shared_dir(df.sparkSession)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    run = df.writeStream.outputMode("complete").foreachBatch(keep)
    run.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    out = df.sparkSession.read.parquet(f"{path}/{name}")
    last = out.agg(F.max("batch").alias("batch"))
    return out.join(F.broadcast(last), "batch").drop("batch")  # last is one row


@query
def stream_stats(spark, d):
    timed = _page_stream(spark, d).withColumn("fetched_at", F.timestamp_seconds(F.col("page_id") * 2))
    counts = _drain(streams.stream_stats(timed), "stats")
    return counts.withColumn("pages_per_sec", F.round("pages_per_sec", 6))


@query
def stream_open_stats(spark, d):
    """Findings that name a type of their own, which no one knew before, are counted under it."""
    reg = Registry(built_in=["links"])
    own = lambda p: [{"type": f"ends-{p['url'][-1]}", "value": p["url"]}]
    reg.register("ends", own, row_level=True, columns=("url",))
    path = shared_dir(spark)
    streams.run_stats(_page_stream(spark, d), f"{path}/totals", f"{path}/state", reg).awaitTermination()
    totals = streams.RunningTotals(spark, f"{path}/totals").read()
    return totals.select("pages_crawled", "items_extracted", F.explode("items_by_type").alias("type", "n"))


class _Counted(_Folder):
    """Overwrites a batch by its number, and keeps every summary it is given."""

    def write_results(self, results: DataFrame, batch: int) -> None:
        result_rows(results).write.mode("overwrite").json(f"{self.path}/results/batch={batch}")

    def finalize(self, summary: DataFrame) -> None:
        summary.select("target_url", "total_pages", "total_errors", "total_items").write.mode("append").json(f"{self.path}/summary")


@query
def stream_writer(spark, d):
    """A stream in four batches, run twice: results of all batches, and one summary."""
    path = shared_dir(spark)
    site = customer_pages(spark, d)
    site.repartition(4).write.parquet(f"{path}/in")
    for _ in range(2):
        stream = streams.read_page_stream(spark, f"{path}/in", site.schema, max_files=1)
        streams.run_writer_stream(stream, _Counted(f"{path}/out"), f"{path}/run", f"https://{SEED}/")
    written = spark.read.schema("page struct<url string>, extracted_items array<struct<type string>>").json(f"{path}/out/results")
    ends = spark.read.schema("target_url string, total_pages long, total_errors long, total_items long").json(f"{path}/out/summary")
    results = written.select(F.col("page.url").alias("name"), F.lit("items").alias("what"), F.size("extracted_items").cast("long").alias("n"))
    totals = F.expr("stack(3, 'pages', total_pages, 'errors', total_errors, 'items', total_items)").alias("what", "n")
    return results.unionByName(ends.select(F.col("target_url").alias("name"), totals))


@query
def stream_event_counts(spark, d):
    events = streams.table_stream(spark, d, "events.parquet")
    return _drain(streams.stream_event_counts(events), "events")
