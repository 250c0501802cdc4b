import json

import pytest
from pyspark.sql import functions as F

from pageloom.operators.registry import Registry
from pageloom.plans.pipeline import extract_all, page_items, page_results
from pageloom.plans.report import report_lines, write_report
from pageloom.operators.stats import crawl_summary
from pageloom.sinks.writers import run_writer, write_results
from pageloom.sources.corpora import crawl_log
from pageloom.sources.pages import read_pages
from pageloom.streaming import streams

D = "/root/testdata/sf0.001"


class Seen:
    def __init__(self):
        self.seen, self.ends = [], []

    def write_results(self, results, batch):
        self.seen.append(results.count())

    def finalize(self, summary):
        self.ends.append(summary.count())


def test_batch_and_stream_agree_on_failures(spark, tmp_path):
    rows = [(i, f"https://h/{i}", "<a href=/x>x</a>", 404 if i % 3 == 0 else 200) for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, status_code int")
    pages.write.parquet(str(tmp_path / "in"))
    stream = streams.read_page_stream(spark, str(tmp_path / "in"), pages.schema)
    streams.run_available(streams.stream_extract(stream).drop("ord"), str(tmp_path / "o"), str(tmp_path / "s"))
    key = ["page_id", "value"]
    got = spark.read.parquet(str(tmp_path / "o")).select(key).orderBy(key).collect()
    assert got == extract_all(pages).select(key).orderBy(key).collect() and len(got) == 6
    sizes = page_results(pages).selectExpr("page.page_id AS i", "size(extracted_items) AS n").collect()
    assert {r.i: r.n for r in sizes} == {i: int(i % 3 > 0) for i in range(9)}


def test_stream_in_many_batches_equals_batch(spark, tmp_path):
    source = spark.read.parquet(f"{D}/pages.parquet")
    source.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = streams.read_page_stream(spark, str(tmp_path / "in"), source.schema, max_files=1)
    items = streams.stream_extract(stream).drop("ord")
    streams.run_available(items, str(tmp_path / "out"), str(tmp_path / "state"))
    key = ["page_id", "type", "value"]
    got = spark.read.parquet(str(tmp_path / "out")).select(key).orderBy(key).collect()
    assert got == extract_all(read_pages(spark, f"{D}/pages.parquet")).select(key).orderBy(key).collect()


def test_new_urls_once_across_batches(spark, tmp_path):
    urls = spark.range(20).selectExpr("concat('https://h/', id % 4, '/') AS url", "timestamp_seconds(id) AS ts")
    urls.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(urls.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for i, mark in enumerate((None, ("ts", "1 hour"))):
        fresh = streams.stream_new_urls(stream, watermark=mark)
        streams.run_available(fresh, str(tmp_path / f"out{i}"), str(tmp_path / f"state{i}"))
        got = sorted(r.url for r in spark.read.parquet(str(tmp_path / f"out{i}")).collect())
        assert got == [f"https://h/{k}" for k in range(4)]


def test_custom_stream_writer_sees_every_page(spark, tmp_path):
    schema = spark.read.parquet(f"{D}/pages.parquet").schema
    stream = streams.read_page_stream(spark, D, schema, glob="pages.parquet")
    writer = Seen()
    streams.write_stream(stream, writer, str(tmp_path / "s"), Registry(built_in=["links"])).awaitTermination()
    assert sum(n for n in writer.seen) == spark.read.parquet(f"{D}/pages.parquet").count()


def test_written_json_leaves_out_html_and_empty_values(spark, page, tmp_path):
    write_results(page_results(page("<a href=/x>y</a>", error="")), str(tmp_path / "o"))
    (line,) = [r.value for r in spark.read.text(str(tmp_path / "o")).collect()]
    got = json.loads(line)
    assert set(got["page"]) == {"url", "final_url"}
    assert got["extracted_items"] == [
        {"type": "link", "value": "https://shop.test/x", "source_url": "https://shop.test/dir/page",
         "metadata": {"link_type": "internal", "anchor_text": "y"}}
    ]


def test_report_and_custom_writer(spark, page, tmp_path):
    df = page("<title>t</title>")
    summary = crawl_summary(crawl_log(spark, D), extract_all(df), "https://shop.test/")
    write_report(df, summary, str(tmp_path / "r"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "r" / "pages")).collect()]
    assert lines == ["  [0] https://shop.test/dir/page (0ms) [meta:1]", "      +-- metadata: t"]
    writer = Seen()
    failed = page("<title>t</title>", error="gone").selectExpr("page_id + 1 AS page_id", "url", "html", "error")
    results = page_results(df.selectExpr("*", "CAST(NULL AS STRING) AS error").unionByName(failed))
    run_writer(writer, results, summary)
    assert (writer.seen, writer.ends) == ([1], [1])


def test_report_lines_end_with_the_totals(spark, page):
    events = [("page_queued", 0), ("page_done", 1), ("page_error", 2), ("page_done", 3)]
    log = spark.createDataFrame(events, "event_type string, second int").selectExpr("event_type", "timestamp_seconds(second) AS ts")
    good = page("<title>t</title><a href=/x>y</a>", error="")
    failed = page("<title>t</title>", error="gone").selectExpr("page_id + 1 AS page_id", "url", "html", "error")
    lines = report_lines(good.unionByName(failed).unionByName(good), log=log)
    closing = [r.line for r in lines.where("page_id IS NULL").orderBy("line_no").collect()]
    assert closing == [
        "  Crawl complete", "    Pages:  2 crawled, 1 errors", "    Items:  4 extracted in 3.0s", "    Types:  link:2, metadata:2",
    ]
    own = sorted((r.page_id, r.line_no, r.line) for r in lines.where("page_id IS NOT NULL").collect())
    assert own == sorted(tuple(r) for r in report_lines(good.unionByName(good)).collect()) and len(own) == 6
    none = report_lines(failed, log=log)
    assert [r.line for r in none.orderBy("line_no").collect()][1:] == ["    Pages:  2 crawled, 1 errors", "    Items:  0 extracted in 3.0s"]


def test_a_report_makes_its_summary_once(spark, page, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = page("<title>t</title>")
    summary = crawl_summary(crawl_log(spark, D), extract_all(df), "https://shop.test/")
    write_report(df, summary.mapInArrow(count, summary.schema), str(tmp_path / "r"))
    assert made.value == 1
    header = [r.value for r in spark.read.text(str(tmp_path / "r" / "header")).collect()]
    closing = [r.value for r in spark.read.text(str(tmp_path / "r" / "summary")).collect()]
    assert header[0] == "  Target: https://shop.test/"
    assert closing[0] == "  Crawl complete" and closing[-1].split() == ["Types:", "metadata:1"]


def test_json_pages_are_read_with_the_declared_schema(spark, tmp_path):
    rows = spark.createDataFrame([("https://h/", "<p>", 200)], "url string, raw_html string, status_code int")
    rows.write.json(str(tmp_path / "p"))
    df = read_pages(spark, str(tmp_path / "p"), "json")
    assert df.select("status_code", F.col("headers").isNull()).first() == (200, True)


def test_extraction_needs_no_shuffle(spark):
    pages = spark.read.parquet(f"{D}/pages.parquet")
    plan = extract_all(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 1


class Kept:
    """Remembers what it is given, and can fail in a batch."""

    def __init__(self, fail=None):
        self.batches, self.ends, self.fail = {}, [], fail

    def write_results(self, results, batch):
        if batch == self.fail:
            raise RuntimeError("disk full")
        assert batch not in self.batches
        self.batches[batch] = results.count()

    def finalize(self, summary):
        self.ends.append(summary.first())


def test_writer_is_finalised_once_per_end(spark, tmp_path):
    rows = [(i, f"https://h/{i}", "<a href=/x>x</a>", 500 if i == 3 else 200, i) for i in range(10)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, status_code int, t int")
    pages = pages.selectExpr("page_id", "url", "html", "status_code", "timestamp_seconds(t) AS fetched_at")
    source, folder = str(tmp_path / "in"), str(tmp_path / "run")
    pages.where("page_id < 8").repartition(4, "page_id").write.parquet(source)

    def run(writer):
        stream = streams.read_page_stream(spark, source, pages.schema, max_files=1)
        return streams.run_writer_stream(stream, writer, folder, "https://h/").first()

    writer = Kept(fail=2)
    with pytest.raises(Exception, match="disk full"):
        run(writer)
    assert writer.ends == [] and sorted(writer.batches) == [0, 1]
    writer.fail = None
    done = run(writer)
    assert sum(writer.batches.values()) == 7 and writer.ends == [done]
    assert (done.total_pages, done.total_errors, done.total_items, done.items_by_type) == (7, 1, 7, {"link": 7})
    assert (done.target_url, done.duration_ns) == ("https://h/", 7_000_000_000)
    assert run(writer) == done and len(writer.ends) == 1
    pages.where("page_id >= 8").write.mode("append").parquet(source)
    more = run(writer)
    assert more.total_pages == 9 and writer.ends == [done, more]


def test_totals_count_a_batch_once_and_any_type(spark, tmp_path):
    reg = Registry(built_in=["links"])
    reg.register("own", lambda p: [{"type": f"t{p['page_id'] % 3}", "value": 1}], row_level=True, columns=("page_id",))
    pages = spark.createDataFrame([(i, f"https://h/{i}", "<a href=/x>x</a>") for i in range(6)], "page_id long, url string, html string")
    totals = streams.RunningTotals(spark, str(tmp_path / "t"))
    assert totals.read().first().items_extracted == 0
    for batch in (0, 1, 1, 2, 2, 3):
        totals.add(batch, streams.batch_totals(page_items(pages, reg)))
    row = totals.read().first()
    assert (row.pages_crawled, row.items_extracted) == (24, 48)
    assert row.items_by_type == {"link": 24, "t0": 8, "t1": 8, "t2": 8}
    empty = streams.batch_totals(page_items(pages.limit(0), reg)).first()
    assert (empty.pages_crawled, empty.items_by_type) == (0, {})


def test_state_store_is_restored(spark):
    before = spark.conf.get(streams._PROVIDER, None)
    with streams.state_on_disk(spark):
        assert spark.conf.get(streams._PROVIDER) == streams.ROCKSDB
    assert spark.conf.get(streams._PROVIDER, None) == before


@pytest.mark.parametrize("folder", [False, True])
def test_queries_stream_a_table_of_one_file_or_many(spark, tmp_path, folder):
    from pageloom.catalog import QUERIES

    rows = [(k, f"https://h/{k}", f"<a href=/x{k % 3}>x</a>") for k in range(6)]
    made = spark.createDataFrame(rows, "page_id long, url string, html string")
    d = tmp_path / "d"
    if folder:
        made.repartition(3).write.parquet(str(d / "pages.parquet"))
    else:
        d.mkdir()
        made.toPandas().to_parquet(str(d / "pages.parquet"))
    got = QUERIES["stream_extract"](spark, str(d))
    assert sorted((r.page_id, r.value) for r in got.where("type = 'link'").collect()) == [(k, f"https://h/x{k % 3}") for k in range(6)]
    urls = {r.url for r in QUERIES["stream_new_urls"](spark, str(d)).collect()}
    assert urls == {f"https://h/x{k}" for k in range(3)}
    assert [(r.pages_crawled, r.link) for r in QUERIES["stream_stats"](spark, str(d)).collect()] == [(6, 6)]


def test_a_batch_of_one_file_is_shared_out(spark, tmp_path):
    """A writer's batch is worked on by many tasks, even if all its pages lie in one split."""

    class Parts(Seen):
        def write_results(self, results, batch):
            self.seen += [r["count"] for r in results.groupBy(F.spark_partition_id()).count().collect()]

    pages = spark.range(400).selectExpr("id AS page_id", "concat('https://h/', id) AS url", "'<a href=/x>x</a>' AS html")
    pages.coalesce(1).write.parquet(str(tmp_path / "in"))
    writer = Parts()
    stream = streams.read_page_stream(spark, str(tmp_path / "in"), pages.schema)
    summary = streams.run_writer_stream(stream, writer, str(tmp_path / "run"), "https://h/", Registry(built_in=["links"])).first()
    assert sum(writer.seen) == 400 and max(writer.seen) <= 50
    assert (summary.total_pages, summary.total_items, len(writer.ends)) == (400, 400, 1)
