"""Page corpora derived from the star-schema tables, for queries and tests.

Every page is made from its own row with ``concat``; fan-out is bounded by
construction (a customer links 20 others, found by arithmetic), so the corpora
grow with the tables without collecting anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.operators.assets import FILE_TYPES
from pageloom.operators.social import PLATFORMS
from pageloom.sources.pages import as_pages, dealt, spread

SITE = "https://shop.test"
CHILDREN = 20
FIRST_CHILD = 25
EVENTS_PER_VISIT = 1000
# Rows of which one task makes its pages.
CUSTOMERS_PER_TASK, ORDERS_PER_TASK = 10_000, 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _page(key: str, kind: int, url: str, html: str, status: str = "200") -> list[str]:
    return [
        f"CAST({key} AS BIGINT) * 8 + {kind} AS page_id",
        f"concat('{SITE}', {url}) AS url",
        f"{html} AS raw_html",
        f"CAST({status} AS INT) AS status_code",
        f"(CAST({key} AS BIGINT) * 37000000) % 90000000000 AS fetch_duration_ns",
    ]


_ROOT = """concat('<html><head><title>Shop</title></head><body>',
 array_join(transform(keys, k -> concat('<a href="/r/', k, '">r</a>')), ''),
 '<a href="https://partner.test/">partner</a></body></html>')"""

_REGION = """concat('<html><head><title>', r_name, '</title></head><body>',
 array_join(transform(coalesce(keys, array()), k -> concat('<a href="../n/', k, '/">n</a>')), ''),
 '<a href="#top">top</a><a href="/">home</a></body></html>')"""

_NATION = """concat('<html><head><title>', n_name, '</title></head><body><a href="/c/', n_nationkey,
 '?ref=n">first</a></body></html>')"""

_CUSTOMER = """concat('<html lang="en"><head><title>', c_name, '</title>
<meta name="Description" content="', c_mktsegment, '"><meta property="og:type" content="profile">
<link rel="canonical" href="/c/', c_custkey, '"><link rel="stylesheet" href="/s/main.css" media="print">
<link rel="icon" href="/favicon.ico"><link rel="preload" as="font" href="/f/a.woff2">
<script type="application/ld+json">{"id": ', c_custkey, '}</script><script src="/j/app.js" async></script></head>
<body><h1>', c_name, '</h1><h2></h2>',
 array_join(transform(sequence(0, 19), i -> concat('<a href="/c/', 25 + 20 * c_custkey + i, '?ref=n">c</a>')), ''), '
<a href="/o/', c_custkey, '#lines" rel="nofollow">order</a><a href="https://github.com/cust', c_custkey, '">gh</a>
<a href="mailto:Cust', c_custkey, '@shop.test?subject=hi">mail</a><a href="tel:+1-555-010-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), '">call</a>
<img src="/i/', c_custkey, '.PNG" alt="', c_name, '" width="10" srcset="/i/', c_custkey, '.PNG 1x, /i/', c_custkey, '@2x.png 2x">
<picture><source srcset="/p/', c_custkey, '.webp 1x" type="image/webp"><img src="/p/', c_custkey, '.jpg"></picture>
<a href="/d/', c_custkey, '.pdf">invoice</a><video src="/v/', c_custkey, '.mp4"></video><audio><source src="/a/', c_custkey, '.mp3"></audio>
<form action="/buy" method="post" id="f', c_custkey, '"><input name="q" type="text" placeholder="Qty"><select name="size"></select><textarea></textarea></form>
<form><input type="text"></form>
</body></html>')"""

_ORDER = """concat('<html><head><title>Order ', o_orderkey, '</title></head><body><a href="/c/', o_custkey,
 '?ref=n">customer</a></body></html>')"""


def customer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per customer, with one of everything the extractors look for.
    Some of the fetches failed."""
    return as_pages(_customers(_customer_rows(spark, sf_dir)))


def _customer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "customer"), CUSTOMERS_PER_TASK)


def _customers(customer: DataFrame) -> DataFrame:
    url = "concat('/c/', c_custkey, '?ref=n')"
    status = "IF(c_custkey % 97 = 13, 404, 200)"
    return customer.selectExpr(*_page("c_custkey", 3, url, _CUSTOMER, status))


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawlable site: home, regions, nations, customers (a tree of 20 each),
    orders (which lead back to customers)."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    # the home page lists all regions, a region's page its nations
    listed = lambda key: F.sort_array(F.collect_list(key)).alias("keys")
    nations = nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(listed("n_nationkey"))
    parts = [
        region.agg(listed("r_regionkey")).selectExpr(*_page("0", 0, "'/'", _ROOT)),
        region.join(nations, "r_regionkey", "left").selectExpr(
            *_page("r_regionkey", 1, "concat('/r/', r_regionkey)", _REGION)
        ),
        nation.selectExpr(
            *_page("n_nationkey", 2, "concat('/n/', n_nationkey)", _NATION)
        ),
        dealt(table(spark, sf_dir, "orders"), ORDERS_PER_TASK).selectExpr(
            *_page("o_orderkey", 4, "concat('/o/', o_orderkey)", _ORDER)
        ),
    ]
    out = _customers(_customer_rows(spark, sf_dir))
    for part in parts:
        out = out.unionByName(part)
    return as_pages(out)


_VARIED = """concat('<html lang=''de''><body><!-- <a href="/hidden/', c_custkey, '">no</a> --><a href=''https://',
 social[c_custkey % size(social)], 'u', c_custkey, chr(39), '>me &amp; you</a><a href="files/', c_custkey,
 upper(files[c_custkey % size(files)]), '?v=1">f</a><a href="../up/', c_custkey, '">up<a title="a > b" href=./same/', c_custkey,
 '>same</a><h', c_custkey % 6 + 1, '>A &lt; B ', c_custkey, '</h', c_custkey % 6 + 1, '><p><b>unclosed',
 repeat(concat('<script type="application/ld+json">{"n": ', c_custkey, '}</script>'), CAST(c_custkey % 3 AS INT)), '</body>')"""


def varied_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per customer that differs by key: all platforms, linked file types and
    heading levels, up to two JSON-LD blocks, relative references, comments, unclosed tags."""
    lists = {
        "social": F.array(*[F.lit(patterns[0]) for patterns in PLATFORMS.values()]),
        "files": F.array(*map(F.lit, FILE_TYPES)),
    }
    made = _customer_rows(spark, sf_dir).withColumns(lists)
    return as_pages(made.selectExpr(*_page("c_custkey", 5, "concat('/v/', c_custkey, '/page')", _VARIED)))


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the only paragraph of a page."""
    return as_pages(
        spread(table(spark, sf_dir, "documents")).select(
            F.col("doc_id").alias("page_id"),
            F.concat(F.lit(f"{SITE}/doc/"), "doc_id").alias("url"),
            F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("raw_html"),
        )
    )


def visit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per user and run of 1,000 events, with the calls it made.

    Splitting by runs of events bounds the calls a page can hold, however active
    its user is."""
    request = F.expr(
        """named_struct('event_id', event_id,
            'url', concat('https://api.shop.test/v1/', event_type, IF(event_id % 7 = 0, '.png', '')),
            'method', IF(event_type IN ('purchase', 'signup'), 'POST', 'GET'),
            'content_type', IF(event_type IN ('purchase', 'signup'), 'application/json', ''),
            'resource_type', element_at(
                array('xhr', 'fetch', 'image', 'other', 'websocket', 'Stylesheet'),
                CAST(event_id % 6 AS INT) + 1))"""
    )
    visits = (
        table(spark, sf_dir, "events")
        .withColumn("visit", F.expr(f"event_id DIV {EVENTS_PER_VISIT}"))
        .groupBy("user_id", "visit")
        .agg(F.sort_array(F.collect_list(request)).alias("requests"))
    )
    return as_pages(
        visits.select(
            (F.col("visit") * 1_000_000_000 + F.col("user_id")).alias("page_id"),
            F.concat(F.lit(f"{SITE}/c/"), "user_id", F.lit("?visit="), "visit").alias("url"),
            F.expr(
                "transform(requests, r -> named_struct('url', r.url, 'method', r.method,"
                " 'content_type', r.content_type, 'resource_type', r.resource_type))"
            ).alias("intercepted_requests"),
        )
    )


_LOG = [
    "event_id",
    "ts",
    "CASE WHEN event_type = 'error' THEN 'page_error'"
    " WHEN event_type IN ('view', 'click') THEN 'page_done' ELSE 'page_queued' END AS event_type",
    "concat('https://shop.test/c/', user_id) AS url",
    "CAST(value * 1000000 AS BIGINT) AS duration_ns",
    "CASE WHEN event_type = 'error' THEN 404 WHEN event_id % 10 = 0 THEN 301 ELSE 200 END"
    " AS status_code",
    "IF(event_type = 'error', 'Not Found', '') AS error",
]


def crawl_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events read as the log of a crawl."""
    return table(spark, sf_dir, "events").selectExpr(*_LOG)
