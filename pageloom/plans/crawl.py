"""Breadth-first expansion of a crawl over captured pages.

A crawl takes apart the pages that it reaches and no others. What is made of all pages is
narrow: one row per canonical URL, with the capture that counts. A level looks its URLs up
in that table, and a Bloom filter of the captures found goes to the scan of the pages, so
that HTML is read where it is wanted and never shuffled.

For many crawls of the same pages there is the link graph, for which all HTML is read
once: one node per canonical URL, with whether its page was fetched and where its links
lead, a narrow table in the shared folder. Both tables are in buckets by URL. Every level
joins the frontier with one of them, on a key that is unique on both sides, and neither it
nor the levels before are ever shuffled again: all that moves is the frontier and the links
that lead out of it. A URL to which a third of all pages link is reduced on the map
side. Only the loop over the levels runs on the driver.

Order: the reference takes URLs first in, first out. The place of a URL in that
order is the list of link positions on its way from the seed, so it needs no
global numbering: level by level, lists compare like the ranks of a queue.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.functions.core import each_indexed, expr, keep, struct
from pageloom.functions.urls import canonical_sql, canonical_url, host_name, in_allowed_domain, with_scheme
from pageloom.operators import links
from pageloom.operators.items import inline_rows
from pageloom.plans import bloom
from pageloom.plans.checkpoints import bucketed, open_bucketed, removed, shared_dir, stored
from pageloom.plans.pipeline import extract_all, prepare
from pageloom.sources.pages import as_pages, is_ok

# Defaults of a crawl.
MAX_DEPTH = 3
MAX_PAGES = 500

# Columns of a graph, and of the URLs queued.
GRAPH = "url string, page_id bigint, ok boolean, links array<struct<pos: int, dst_url: string, link_type: string>>"
QUEUED = "url string, depth int, path array<int>"

# Up to this many captures the graph of all pages is made for a single crawl too: it takes less
# time than the jobs that find a level's pages.
_GRAPH_CAPTURES = 250_000

# What of a page its links depend on.
_FOR_LINKS = ("page_id", "url", "final_url", "status_code", "raw_html", "rendered_html", "error")

# A level's filter has room for this many times its captures, and for so many at least: a page
# that it lets through besides is taken apart in vain.
_ROOM, _LEAST_KEYS = 4, 10_000

# Above this many rows a ranking is not left to a single task.
_ONE_TASK_ROWS = 100_000


def _links_sql(ignore_query: bool) -> str:
    canonical = each_indexed(
        links.links_sql(),
        lambda x, i: struct(
            pos=i,
            dst_url=canonical_sql(f"{x}.url", ignore_query),
            link_type=f"{x}.link_type",
        ),
    )
    return f"coalesce({keep(canonical, lambda e: f'{e}.dst_url IS NOT NULL')}, array())"


def with_links(pages: DataFrame, ignore_query: bool = False) -> DataFrame:
    """page_id, src_url (canonical), fetched_at, ok, links: array<struct<pos, dst_url,
    link_type>>; a failed fetch has none."""
    return prepare(pages, ["links"]).select(
        "page_id",
        canonical_url("url", ignore_query).alias("src_url"),
        "fetched_at",
        is_ok().alias("ok"),
        expr(_links_sql(ignore_query)).alias("links"),
    )


def link_edges(pages: DataFrame, ignore_query: bool = False) -> DataFrame:
    """page_id, src_url, dst_url (both canonical), link_type, pos of every link."""
    nodes = with_links(pages, ignore_query)
    edges = inline_rows(nodes, "links", "page_id", "src_url")
    return edges.select("page_id", "src_url", "dst_url", "link_type", "pos")


def captures(pages: DataFrame, ignore_query: bool = False) -> DataFrame:
    """url (canonical), fetched_at, page_id, ok of every capture that has a URL: narrow columns,
    so that a scan reads no HTML (but where a table has no page_id and it is made of the content)."""
    known = as_pages(pages).select(
        canonical_url("url", ignore_query).alias("url"), "fetched_at", "page_id", is_ok().alias("ok")
    )
    return known.where("url IS NOT NULL")


def _first_captures(pages: DataFrame, ignore_query: bool) -> tuple[DataFrame, Observation]:
    """url, page_id, ok of the first capture of every URL, by time and then page_id; and how
    many ``urls`` and ``captures`` there were, known once the rows are written."""
    seen = captures(pages, ignore_query).groupBy("url").agg(
        F.min(F.struct("fetched_at", "page_id", "ok")).alias("_first"), F.count("*").alias("_captures")
    )
    size = Observation()
    counted = seen.observe(size, F.count("*").alias("urls"), F.sum("_captures").alias("captures"))
    return counted.select("url", F.col("_first.page_id").alias("page_id"), F.col("_first.ok").alias("ok")), size


def site_graph(
    pages: DataFrame,
    ignore_query: bool = False,
    folder: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """One node per canonical URL: url, page_id, ok, links; a table in ``buckets`` by url (as many as
    Spark's shuffle partitions unless given), in ``folder`` or below the shared one. Hand it to
    ``crawl`` for as many seeds as there are; ``open_graph`` opens it in another session.

    Of several captures of a URL the first counts, by time and then page_id (which
    ``as_pages`` makes of the content where a table has none). The choice is made first, on
    the captures' narrow columns, combined on the map side: very many captures of one URL
    send one row per task. Only then is HTML read, of the captures that were chosen: a Bloom
    filter of their keys, at most 8 MB, goes to the scan, so pages are neither shuffled nor
    parsed in vain; the few others that it lets through are dropped by an exact join of the
    nodes, which are narrow. Where no URL was captured twice there is nothing to choose."""
    spark = pages.sparkSession
    work = shared_dir(spark)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys, size = _first_captures(pages, ignore_query)
    chosen = stored(keys.select("url", "page_id"), f"{work}/chosen")
    urls, many = size.get["urls"], size.get["captures"] or 0
    if urls == many:
        nodes = with_links(pages, ignore_query).where("src_url IS NOT NULL").withColumnRenamed("src_url", "url")
    else:
        nodes = _chosen_nodes(pages, ignore_query, chosen, urls, work)
    graph = nodes.select("url", "page_id", "ok", "links").repartition(n, "url")
    graph = bucketed(graph, "url", folder, n)
    removed(spark, work)
    return graph


def _chosen_nodes(pages: DataFrame, ignore_query: bool, chosen: DataFrame, urls: int, work: str) -> DataFrame:
    words = bloom.words_for(urls)
    passing = stored(bloom.bloom(chosen, ["url", "page_id"], words), f"{work}/bloom")
    wanted = bloom.may_contain(passing, words, canonical_url("url", ignore_query), F.col("page_id"))
    nodes = with_links(as_pages(pages).where(wanted), ignore_query).withColumnRenamed("src_url", "url")
    return nodes.join(chosen, ["url", "page_id"]).dropDuplicates(["url"])


def _known(pages: DataFrame, ignore_query: bool, folder: str) -> tuple[DataFrame, int, int]:
    """url, page_id, ok of every captured URL, a table in buckets by url; how many URLs and
    how many captures there are."""
    keys, size = _first_captures(pages, ignore_query)
    known = bucketed(keys, "url", folder)
    return known, size.get["urls"], size.get["captures"] or 0


def _level_nodes(
    pages: DataFrame, ignore_query: bool, level: DataFrame, known: DataFrame, unique: bool, folder: str
) -> DataFrame | None:
    """Nodes of a level's URLs that were captured and fetched, None if there is none: only
    these pages are taken apart, and the few others that the filter of page_ids lets through."""
    size = Observation()
    found = level.select("url").join(known.where("ok"), "url").observe(size, F.count("*").alias("n"))
    wanted = stored(found, f"{folder}/wanted")
    if size.get["n"] == 0:
        return None
    words = bloom.words_for(max(_LEAST_KEYS, _ROOM * size.get["n"]))
    passing = stored(bloom.bloom(wanted, ["page_id"], words), f"{folder}/bloom")
    some = as_pages(pages).where(bloom.may_contain(passing, words, F.col("page_id"))).select(*_FOR_LINKS)
    # written, so that a table put together from many is taken apart by one expression, not by one each
    nodes = with_links(stored(some, f"{folder}/pages"), ignore_query).withColumnRenamed("src_url", "url")
    if unique:
        return nodes
    return nodes.join(wanted, ["url", "page_id", "ok"]).dropDuplicates(["url"])


def open_graph(spark: SparkSession, folder: str, buckets: int) -> DataFrame:
    """A graph that ``site_graph`` wrote into ``folder``, in this session or another one."""
    return open_bucketed(spark, folder, "url", buckets, GRAPH)


def unique_paths(urls: DataFrame, column: str = "url", order: str = "page_id") -> DataFrame:
    """One URL per canonical form without its query: the first in ``order``."""
    keyed = urls.withColumn("path_url", canonical_url(column, ignore_query=True))
    return (
        keyed.where("path_url IS NOT NULL")
        .groupBy("path_url")
        .agg(F.min_by(column, order).alias(column))
    )


def expand_once(
    frontier: DataFrame,
    visited: DataFrame | list[DataFrame],
    nodes: DataFrame,
    allow_external: bool = False,
    remaining: int | None = None,
    domain: str | None = None,
) -> DataFrame:
    """The next level: url, depth, path of the URLs first seen now.

    ``frontier`` has url, depth, path (the place in the queue); ``visited`` may be a list
    of tables, each in buckets by url, which are then left where they are; ``remaining``
    is how many URLs may still be admitted. Internal links only unless external
    ones are allowed. Pages outside ``domain`` are not followed: a crawl never
    fetches them."""
    if domain is not None:
        frontier = frontier.where(in_allowed_domain("url", domain, allow_external))
    here = frontier.join(nodes.where("ok"), "url")
    followed = "links" if allow_external else "filter(links, l -> l.link_type = 'internal')"
    reached = inline_rows(
        here.select("depth", "path", F.expr(followed).alias("links")), "links", "depth", "path"
    )
    found = reached.groupBy(F.col("dst_url").alias("url")).agg(
        (F.min("depth") + 1).alias("depth"),
        F.min(F.concat("path", F.array("pos"))).alias("path"),
    )
    new = found
    for past in visited if isinstance(visited, list) else [visited]:
        new = new.join(past.select("url"), "url", "left_anti")
    return new if remaining is None else first_rows(new, remaining)


def first_rows(df: DataFrame, n: int, folder: str | None = None) -> DataFrame:
    """The n rows that come first by ``path``."""
    if n <= _ONE_TASK_ROWS:
        return df.orderBy("path").limit(n)
    return ranked(df, ["path"], folder).where(F.col("rank") < n).drop("rank")


def ranked(df: DataFrame, order: list[str], folder: str | None = None) -> DataFrame:
    """Add ``rank`` (from 0) by ``order`` without sorting everything in one task.

    Range-partitions, numbers each partition on its own as it is written, into ``folder`` or
    below the shared one, and adds the sizes of the partitions before it; only those sizes,
    one per partition, reach the driver."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # within a task the low bits of the identifier count its rows, here in their order
    sorted_parts = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("_part"), F.expr("monotonically_increasing_id() & 8589934591L").alias("_nth")
    )
    ranged = stored(sorted_parts, folder)
    sizes = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    offset, before = 0, []
    for part in sorted(sizes):
        before += [F.lit(part), F.lit(offset)]
        offset += sizes[part]
    if not before:
        return ranged.drop("_part", "_nth").withColumn("rank", F.lit(0).cast("bigint"))
    start = F.element_at(F.create_map(*before), F.col("_part"))
    return ranged.withColumn("rank", (F.col("_nth") + start).cast("bigint")).drop("_part", "_nth")


def crawl(
    pages: DataFrame,
    seed: str,
    max_depth: int = MAX_DEPTH,
    max_pages: int | None = MAX_PAGES,
    allow_external: bool = False,
    ignore_query_params: bool = False,
    graph: DataFrame | None = None,
) -> DataFrame:
    """Follow links from ``seed``: url, depth, rank, status, page_id.

    ``status`` is done, error (the fetch failed or the host is out of scope) or
    not_captured. Every URL that was queued holds its place in ``max_pages``.
    ``graph`` is the ``site_graph`` of the pages; without it, and where there are
    more than a few captures, the pages of a level are taken apart when the crawl gets there,
    and what it doesn't reach never is.

    Each level is written once, in buckets by url, and read by those after it; a level
    costs one shuffle, that of the links out of the level before. What is written on
    the way is deleted at the end."""
    spark = pages.sparkSession
    work = shared_dir(spark)
    known, unique = graph, True
    if graph is None:
        known, urls, many = _known(pages, ignore_query_params, f"{work}/known")
        unique = urls == many
        if many <= _GRAPH_CAPTURES:
            known = graph = site_graph(pages, ignore_query_params, f"{work}/graph")
    start, domain = _seed(spark, seed, ignore_query_params)
    level, added = _level(start if max_pages is None else start.limit(max_pages), f"{work}/level-0")
    levels = [level]
    total = added
    for depth in range(max_depth):
        left = None if max_pages is None else max_pages - total
        if added == 0 or left == 0:
            break
        nodes = graph
        if graph is None:
            followed = level.where(in_allowed_domain("url", domain, allow_external))
            nodes = _level_nodes(pages, ignore_query_params, followed, known, unique, f"{work}/nodes-{depth}")
            if nodes is None:
                break
        found = expand_once(level, levels, nodes, allow_external, None, domain)
        if left is not None:
            found = first_rows(found, left, f"{work}/first-{depth + 1}")
        level, added = _level(found, f"{work}/level-{depth + 1}")
        if graph is None:
            removed(spark, f"{work}/nodes-{depth}")
        levels.append(level)
        total += added
    queued = _numbered(reduce(DataFrame.unionByName, levels), total, f"{work}/ranked")
    found = queued.join(known.select("url", "page_id", "ok"), "url", "left")
    out = stored(_with_status(found, domain, allow_external))
    removed(spark, work)
    return out


def _level(level: DataFrame, folder: str) -> tuple[DataFrame, int]:
    """A level as a table in buckets by url, and its size, counted as it is written."""
    size = Observation()
    written = bucketed(level.observe(size, F.count("*").alias("n")), "url", folder)
    return written, size.get["n"]


def _seed(spark: SparkSession, seed: str, ignore_query: bool) -> tuple[DataFrame, str]:
    """The first level, and the host that limits the crawl."""
    given = spark.range(1).select(F.lit(seed).alias("seed"))
    one = given.select(with_scheme("seed").alias("url"))
    level = one.select(
        canonical_url("url", ignore_query).alias("url"),
        F.lit(0).alias("depth"),
        F.array(F.lit(0)).alias("path"),
    ).where("url IS NOT NULL")
    return level, one.select(host_name("url").alias("host")).first()["host"] or ""


def _numbered(queued: DataFrame, total: int, folder: str) -> DataFrame:
    if total > _ONE_TASK_ROWS:
        return ranked(queued, ["depth", "path"], folder)
    w = Window.orderBy("depth", "path")
    return queued.withColumn("rank", (F.row_number().over(w) - 1).cast("bigint"))


def _with_status(found: DataFrame, domain: str, allow_external: bool) -> DataFrame:
    in_scope = in_allowed_domain("url", domain, allow_external)
    status = (
        F.when(~in_scope, "error")
        .when(F.col("page_id").isNull(), "not_captured")
        .when(F.col("ok"), "done")
        .otherwise("error")
    )
    return found.select("url", "depth", "rank", status.alias("status"), "page_id")


def crawl_extract(pages: DataFrame, crawled: DataFrame, registry=None) -> DataFrame:
    """Items of the pages a crawl reached and could fetch; only those are parsed.

    The reached pages are a table of known size: Spark sends it to the scan while it
    is small, and else joins on page_id."""
    keys = stored(crawled.where("status = 'done'").select("page_id").distinct())
    return extract_all(as_pages(pages).join(keys, "page_id", "left_semi"), registry)
