from pyspark.sql import functions as F

from pageloom.plans import crawl as C
from pageloom.plans.crawl import crawl, crawl_extract, ranked
from pageloom.plans.growing import GrowingCrawl, run_crawl_stream


def site(spark, links, **status):
    rows = [
        (i, f"https://h/{p}", "".join(f"<a href='{x}'>x</a>" for x in to), status.get(p, 200))
        for i, (p, to) in enumerate(links.items())
    ]
    return spark.createDataFrame(rows, "page_id long, url string, raw_html string, status_code int")


def reached(df):
    return [(r.url.removeprefix("https://h/"), r.depth, r.rank, r.status) for r in df.orderBy("rank").collect()]


LINKS = {
    "": ["/b", "/a", "/b#x", "/bad", "https://o.test/"],
    "b": ["/c/", "/a", "/"],
    "a": ["/d", "/c"],
    "bad": ["/never"],
    "c": ["/e"],
    "e": ["/f"],
    "f": [],
}


def test_first_in_first_out_until_the_depth_limit(spark):
    pages = site(spark, LINKS, bad=500)
    want = [
        ("", 0, 0, "done"), ("b", 1, 1, "done"), ("a", 1, 2, "done"), ("bad", 1, 3, "error"),
        ("c", 2, 4, "done"), ("d", 2, 5, "not_captured"), ("e", 3, 6, "done"),
    ]
    assert reached(crawl(pages, "h")) == want
    graph = C.site_graph(pages)
    assert reached(crawl(pages, "h", graph=graph)) == want
    assert reached(crawl(pages, "b", graph=graph)) == [("https://b/", 0, 0, "not_captured")]
    assert reached(crawl(pages, "h", max_depth=0)) == want[:1]
    assert reached(crawl(pages, "h", max_pages=5)) == want[:5]
    assert crawl(pages, "h", max_pages=0).count() == 0


def test_large_levels_give_the_same(spark, monkeypatch):
    pages = site(spark, LINKS, bad=500)
    small = crawl(pages, "h").orderBy("url").collect()
    monkeypatch.setattr(C, "_ONE_TASK_ROWS", 0)
    assert crawl(pages, "h").orderBy("url").collect() == small


def test_external_links_and_scope(spark):
    pages = site(spark, LINKS)
    got = {r.url: r.status for r in crawl(pages, "h", allow_external=True, max_depth=1).collect()}
    assert got["https://o.test/"] == "not_captured"
    moved = pages.selectExpr("page_id", "'https://h/' url", "'https://n/' final_url", "'<a href=/x>' html").limit(1)
    got = {r.url: r.status for r in crawl(moved, "h").collect()}
    assert got == {"https://h/": "done", "https://n/x": "error"}


def test_first_capture_of_a_url_counts(spark):
    pages = site(spark, {"": ["/a"]}).unionByName(
        site(spark, {"": ["/b"]}).selectExpr("page_id + 9 page_id", "url", "raw_html", "status_code")
    )
    assert [r.url for r in crawl(pages, "h").orderBy("rank").collect()] == ["https://h/", "https://h/a"]


def test_pages_out_of_scope_lead_nowhere(spark):
    rows = [(1, "https://a/", "https://b/", "<a href=/x>x</a>"), (2, "https://b/x", None, "<a href=/y>y</a>"),
            (3, "https://b/y", None, "<a href=/z>z</a>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, final_url string, html string")
    got = {r.url: r.status for r in crawl(pages, "a").collect()}
    assert got == {"https://a/": "done", "https://b/x": "error"}


def test_captures_without_id_in_any_order(spark):
    rows = [("https://h/", "<a href=/a>x</a>", 200, 1), ("https://h/", "<a href=/b>x</a>", 200, 2), ("https://h/", "x", 500, 3)]
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        pages = spark.createDataFrame(order, "url string, html string, status_code int, t int").selectExpr(
            "url", "html", "status_code", "timestamp_seconds(t) AS fetched_at"
        )
        done = crawl(pages, "h")
        assert [(r.url, r.status) for r in done.orderBy("rank").collect()] == [("https://h/", "done"), ("https://h/a", "not_captured")]
        assert [r.value for r in crawl_extract(pages, done).collect()] == ["https://h/a"]


def test_ignore_query(spark):
    pages = site(spark, {"": ["/a?x=1", "/a?x=2"], "a?x=9": ["/b"]})
    got = {r.url for r in crawl(pages, "h", ignore_query_params=True).collect()}
    assert got == {"https://h/", "https://h/a", "https://h/b"}


def test_crawl_extract(spark):
    pages = site(spark, LINKS, bad=500)
    done = crawl(pages, "h", max_depth=1)
    few = crawl_extract(pages, done).orderBy("page_id", "value").collect()
    assert {r.page_id for r in few} == {0, 1, 2}


def test_ranked_is_a_global_row_number(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k")
    assert [(r.k, r["rank"]) for r in ranked(df, ["k"]).orderBy("k").collect()] == [(i, i) for i in range(1000)]


def test_only_chosen_captures_are_parsed(spark, monkeypatch):
    """Of three captures of each URL one is taken apart, and what a filter lets through besides."""
    pages = spark.range(900).selectExpr(
        "id AS page_id", "concat('https://h/', id % 300) AS url", "concat('<a href=/', id, '>x</a>') AS raw_html",
        "timestamp_seconds(1000 - id) AS fetched_at",
    )
    parsed = []
    real = C.with_links

    def counted(some, *more):
        parsed.append(some.count())
        return real(some, *more)

    monkeypatch.setattr(C, "with_links", counted)
    graph = {r.url: (r.page_id, [x.dst_url for x in r.links]) for r in C.site_graph(pages).collect()}
    # the latest number has the earliest time
    assert graph == {f"https://h/{i}": (i + 600, [f"https://h/{i + 600}"]) for i in range(300)}
    assert 300 <= parsed.pop() <= 320
    same = pages.unionByName(pages).unionByName(pages.where("page_id >= 600"))
    assert C.site_graph(same).count() == 300
    # the filter of a full size and of one word that lets everything through
    monkeypatch.setattr(C.bloom, "MAX_WORDS", 1)
    assert {r.url: r.page_id for r in C.site_graph(pages).collect()} == {u: p for u, (p, _) in graph.items()}


def test_only_reached_pages_are_parsed(spark, monkeypatch):
    """A crawl takes apart the pages it follows links from, however many were captured; also where
    URLs were captured twice or a page has no page_id."""
    pages = spark.range(3000).selectExpr(
        "IF(id = 1, NULL, id) AS page_id", "concat('https://h/', IF(id = 0, '', CAST(id AS STRING))) AS url",
        "concat('<a href=/', id + 1, '>x</a>') AS raw_html", "IF(id = 3, 500, 200) AS status_code",
    )
    parsed = []
    real = C.with_links

    def counted(some, *more):
        parsed.append(some.count())
        return real(some, *more)

    want = [("", 0, 0, "done"), ("1", 1, 1, "done"), ("2", 2, 2, "done"), ("3", 3, 3, "error")]
    monkeypatch.setattr(C, "with_links", counted)
    monkeypatch.setattr(C, "_GRAPH_CAPTURES", -1)
    assert reached(crawl(pages, "h", max_depth=9)) == want
    assert len(parsed) == 3 and 3 <= sum(parsed) <= 6
    parsed.clear()
    again = pages.withColumn("fetched_at", F.timestamp_seconds(F.lit(0))).unionByName(
        pages.selectExpr("page_id + 10000 AS page_id", "url", "'<a href=/9>x</a>' AS raw_html", "200 AS status_code", "timestamp_seconds(1) AS fetched_at")
    )
    assert reached(crawl(again, "h", max_depth=9)) == want
    assert len(parsed) == 3 and 3 <= sum(parsed) <= 9


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(2000).selectExpr("IF(id = 0, NULL, concat('k', id)) AS a", "id * 3 AS b")
    words = C.bloom.words_for(2000)
    row = C.bloom.bloom(keys, ["a", "b"], words)
    hit = C.bloom.may_contain(row, words, F.col("a"), F.col("b"))
    assert keys.where(hit).count() == 2000
    others = spark.range(2000, 12000).selectExpr("concat('k', id) AS a", "id * 3 AS b")
    assert others.where(hit).count() < 300
    assert C.bloom.words_for(0) == 1 and C.bloom.words_for(10**12) == C.bloom.MAX_WORDS


def test_a_level_costs_one_shuffle(spark, tmp_path):
    """Neither the graph nor the levels before are shuffled; also where the graph is opened again."""
    pages = site(spark, LINKS)
    C.site_graph(pages, folder=str(tmp_path / "graph"))
    graph = C.open_graph(spark, str(tmp_path / "graph"), 8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        start, domain = C._seed(spark, "h", False)
        first, _ = C._level(start, str(tmp_path / "0"))
        second, n = C._level(C.expand_once(first, [first], graph, domain=domain), str(tmp_path / "1"))
        assert n == 3
        third = C.expand_once(second, [first, second], graph, domain=domain)
        plan = third._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("SortMergeJoin") == 3
        assert plan.count("Bucketed: true") == 4
        assert {r.url for r in third.collect()} == {"https://h/c", "https://h/d", "https://h/never"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("pageloom_")]


def test_growing_crawl_equals_the_crawl_over_all(spark, tmp_path):
    """Captures in any order: places get better as shorter ways are found."""
    pages = site(spark, {**LINKS, "x": ["/b", "/y"], "d": ["/x"], "y": ["/c"], "never": ["/x"]}, bad=500)
    pages = pages.withColumn("fetched_at", F.timestamp_seconds("page_id"))
    parts = (["c", "e", "d", "x"], [], ["", "b", "f"], ["a", "bad", "y", "never", "c"])
    growing = GrowingCrawl(spark, str(tmp_path / "crawl"), "h", max_depth=4)
    assert [r.status for r in growing.reached().collect()] == ["not_captured"]
    seen = []
    for n, part in enumerate(parts):
        some = pages.where(F.col("url").isin([f"https://h/{p}" for p in part]))
        growing.add(some, n)
        seen += part
        if n < 2:
            continue
        upto = pages.where(F.col("url").isin([f"https://h/{p}" for p in seen]))
        want = crawl(upto, "h", max_depth=4, max_pages=None)
        growing.add(pages, n)  # a batch that comes again is left alone
        assert sorted(map(str, growing.reached().collect())) == sorted(map(str, want.collect()))
    assert reached(growing.reached())[:2] == [("", 0, 0, "done"), ("b", 1, 1, "done")]


def test_a_batch_of_one_split_is_shared_out(spark, tmp_path, monkeypatch):
    """Pages that arrive as one file are taken apart by many tasks."""
    from pageloom.plans import growing

    parts, plain = [], growing.site_graph

    def counted(pages, *more):
        parts.append(pages.rdd.getNumPartitions())
        return plain(pages, *more)

    monkeypatch.setattr(growing, "site_graph", counted)
    rows = spark.range(40).selectExpr("id AS page_id", "concat('https://h/', IF(id = 0, '', CAST(id AS STRING))) AS url", "concat('<a href=/', id + 1, '>x</a>') AS html")
    crawl = growing.GrowingCrawl(spark, str(tmp_path / "crawl"), "h", max_depth=2)
    crawl.add(growing.as_pages(rows.coalesce(1)), 0)
    assert parts[0] >= spark.sparkContext.defaultParallelism
    assert sorted(r.url for r in crawl.reached().collect()) == ["https://h/", "https://h/1", "https://h/2"]
