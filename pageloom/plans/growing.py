"""A crawl that grows with its pages: batches of captures extend it, nothing is read twice.

The state in ``folder`` is a table of the URLs queued so far, with depth and place in the
queue, and one graph table per batch, all in buckets by URL. A batch adds nodes to the graph.
What it can change starts from queued URLs that have only now been captured: their links are
followed, level by level, and a URL that is new, or is now reached earlier than before, is
queued (again) and followed in turn. Links can only be added, so places only ever get better,
and each level is final when it is reached. A batch therefore costs its own pages and what
they change, and joins with the tables, which aren't shuffled.

Of captures of one URL the one that arrives first counts, within a batch the first by time: where
batches arrive in the order of their time that is the crawl over all pages at once, without
a page cap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pageloom.plans.checkpoints import bucketed, exists, listed, open_bucketed, removed, shared_dir, stored
from pageloom.plans.crawl import (
    MAX_DEPTH, QUEUED, _level, _numbered, _seed, _with_status, expand_once, open_graph, site_graph,
)
from pageloom.sources.pages import as_pages, dealt


class GrowingCrawl:
    """``crawl`` without a page cap, over batches of pages. ``buckets`` is fixed by the first."""

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        seed: str,
        max_depth: int = MAX_DEPTH,
        allow_external: bool = False,
        ignore_query_params: bool = False,
        buckets: int | None = None,
    ):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.max_depth, self.allow_external, self.ignore_query = max_depth, allow_external, ignore_query_params
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.start, self.domain = _seed(spark, seed, ignore_query_params)

    def _done(self) -> list[int]:
        """Numbers of the batches that have been added."""
        names = [int(n[5:]) for n in listed(self.spark, f"{self.folder}/queued") if n.startswith("upto=")]
        return sorted(n for n in names if exists(self.spark, f"{self.folder}/queued/upto={n}/_SUCCESS"))

    def _queued(self, batch: int) -> DataFrame:
        return open_bucketed(self.spark, f"{self.folder}/queued/upto={batch}", "url", self.buckets, QUEUED)

    def _graph(self) -> list[DataFrame]:
        batches = sorted(int(n[6:]) for n in listed(self.spark, f"{self.folder}/graph") if n.startswith("batch="))
        last = max(self._done(), default=-1)
        return [open_graph(self.spark, f"{self.folder}/graph/batch={n}", self.buckets) for n in batches if n <= last]

    def add(self, pages: DataFrame, batch: int) -> None:
        """Extend the crawl by a batch of pages; one that has been added is left alone. A batch
        that fails on the way leaves the state as it was, and can be added again."""
        done = self._done()
        if batch <= max(done, default=-1):
            return
        work = shared_dir(self.spark)
        earlier = self._graph()
        for rest in (f"{self.folder}/graph/batch={batch}", f"{self.folder}/queued/upto={batch}"):
            removed(self.spark, rest)  # of a run that failed
        fresh = site_graph(dealt(pages), self.ignore_query, f"{work}/graph", self.buckets)
        for table in earlier:
            fresh = fresh.join(table.select("url"), "url", "left_anti")
        fresh = bucketed(fresh, "url", f"{self.folder}/graph/batch={batch}", self.buckets)
        if done:
            queued, better = self._queued(done[-1]), []
        else:
            queued, better = self.start.limit(0), [_level(self.start, f"{work}/level-0")[0]]
        captured = stored(queued.join(fresh.select("url"), "url", "left_semi"), f"{work}/captured")
        for depth in range(self.max_depth):
            # those that have moved up meanwhile were followed from there
            now = captured.where(F.col("depth") == depth)
            for level in better:
                now = now.join(level.select("url"), "url", "left_anti")
            moved = [level.where(F.col("depth") == depth) for level in better]
            frontier = stored(reduce(DataFrame.unionByName, [now, *moved]), f"{work}/frontier-{depth}")
            if frontier.isEmpty():
                continue
            found = [
                expand_once(frontier, better, nodes, self.allow_external, None, self.domain)
                for nodes in [*earlier, fresh]
            ]
            reached = reduce(DataFrame.unionByName, found).groupBy("url").agg(F.min("depth").alias("depth"), F.min("path").alias("path"))
            before = queued.select("url", F.struct("depth", "path").alias("_before"))
            news = reached.join(before, "url", "left").where("_before IS NULL OR struct(depth, path) < _before")
            better.append(_level(news.drop("_before"), f"{work}/level-{depth + 1}")[0])
        for level in better:
            queued = queued.join(level.select("url"), "url", "left_anti")
        whole = reduce(DataFrame.unionByName, [queued, *better])
        bucketed(whole.repartition(self.buckets, "url"), "url", f"{self.folder}/queued/upto={batch}", self.buckets)
        removed(self.spark, work)
        for old in done[:-1]:
            removed(self.spark, f"{self.folder}/queued/upto={old}")

    def reached(self) -> DataFrame:
        """url, depth, rank, status, page_id, as ``crawl`` gives them, over all batches so far."""
        done, work = self._done(), shared_dir(self.spark)
        queued = self._queued(done[-1]) if done else self.start
        numbered = _numbered(queued, queued.count(), f"{work}/ranked")
        nodes = [g.select("url", "page_id", "ok") for g in self._graph()]
        none = self.spark.createDataFrame([], "url string, page_id long, ok boolean")
        found = numbered.join(reduce(DataFrame.unionByName, nodes or [none]), "url", "left")
        out = stored(_with_status(found, self.domain, self.allow_external))
        removed(self.spark, work)
        return out


def run_crawl_stream(pages: DataFrame, growing: GrowingCrawl, checkpoint: str, **trigger) -> StreamingQuery:
    """Extend a crawl by every batch of a page stream, each once."""
    return (
        as_pages(pages).writeStream.foreachBatch(growing.add)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
