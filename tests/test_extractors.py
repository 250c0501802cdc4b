import pytest

from pageloom import extract_all, page_results
from pageloom.operators import assets, social
from pageloom.operators.items import NTH, keep_first
from pageloom.operators.registry import BUILT_IN, Registry
from pageloom.plans import platforms
from pageloom.plans.pipeline import extract, extract_checked, extractor_errors


def items(df, name, **options):
    rows = extract(df, name, **options).orderBy("ord").collect()
    return [(r.value, r.metadata) for r in rows]


def test_link_skips(page):
    html = "<a href='#x'>1</a><a href='javascript:f()'>2</a><a href=' mailto:a@b.co'>3</a><a href='tel:1'>4</a><a href=''>5</a><a>6</a>"
    assert items(page(html), "links") == []


def test_link_skip_is_case_sensitive(page):
    assert items(page("<a href='MAILTO:a@b.co'>x</a>"), "links") == [
        ("mailto:a@b.co", {"link_type": "external", "anchor_text": "x"})
    ]


def test_links_keep_fragments_apart_and_drop_repeats(page):
    html = "<a href='/a'></a><a href='/a#1' rel=nofollow>t</a><a href='/a'>again</a>"
    assert items(page(html), "links") == [
        ("https://shop.test/a", {"link_type": "internal"}),
        ("https://shop.test/a#1", {"link_type": "internal", "anchor_text": "t", "rel": "nofollow"}),
    ]


def test_link_type_compares_host_and_port(page):
    html = "<a href='//other.test/x'></a><a href='https://shop.test:443/x'></a><a href='https://www.shop.test/'></a><a href=p></a><a href=ftp://shop.test/f></a>"
    got = [(v, m["link_type"]) for v, m in items(page(html), "links")]
    assert got == [
        ("https://other.test/x", "external"),
        ("https://shop.test:443/x", "external"),
        ("https://www.shop.test/", "external"),
        ("https://shop.test/dir/p", "internal"),
        ("ftp://shop.test/f", "internal"),
    ]


def test_final_url_is_the_base(page):
    df = page("<a href=x></a>", final_url="https://new.test/d/")
    assert items(df, "links")[0][0] == "https://new.test/d/x"
    assert extract(df, "links").first().source_url == "https://shop.test/dir/page"


def test_blank_href_is_the_page_itself(page):
    assert items(page("<a href=' '>x</a>"), "links")[0][0] == "https://shop.test/dir/page"


def test_rendered_html_wins(page):
    df = page("<a href=/raw></a>", rendered_html="<a href=/rendered></a>")
    assert items(df, "links")[0][0] == "https://shop.test/rendered"


def test_email_precedence(page):
    html = "<a href='mailto:A@b.co?x=1'>m</a> a@b.co, logo@2x.png a@example.com k@o1.ingest.sentry.io c@d.org"
    assert items(page(html), "emails") == [
        ("a@b.co", {"source": "mailto_link"}),
        ("c@d.org", {"source": "page_text"}),
    ]
    open_ = [v for v, _ in items(page(html), "emails", denied_suffixes=(), denied_parts=())]
    assert open_ == ["a@b.co", "logo@2x.png", "a@example.com", "k@o1.ingest.sentry.io", "c@d.org"]


def test_phones(page):
    html = "<a href='tel:+1-555-010-0000'>x</a><a href='tel:12345'>y</a> +1 (555) 010 0000 or +44 2079460958"
    assert items(page(html), "phones") == [
        ("+1-555-010-0000", {"normalized": "+15550100000", "source": "tel_link"}),
        ("2079460958", {"normalized": "2079460958", "source": "page_text"}),
        ("+44 2079460958", {"normalized": "+442079460958", "source": "page_text"}),
    ]


def test_social(page):
    html = "<a href='https://fedex.com/a'>f</a><a href='https://youtu.be/1'></a><a href='/x?u=FACEBOOK.com/'></a><a href='#t.me/'></a>"
    got = [(v, m["platform"]) for v, m in items(page(html), "social")]
    assert got == [
        ("https://fedex.com/a", "twitter"),
        ("https://youtu.be/1", "youtube"),
        ("https://shop.test/x?u=FACEBOOK.com/", "facebook"),
        ("https://shop.test/dir/page#t.me/", "telegram"),
    ]
    own = items(page(html), "social", platforms={"parcel": ("fedex.com/",)})
    assert [m["platform"] for _, m in own] == ["parcel"]


def test_metadata(page):
    html = """<html><title> T </title><title>no</title><meta property="OG:Title" content="x"><meta charset=utf-8>
    <meta name="" http-equiv=Refresh content=" 5 "><meta name=n content=""><h2>b</h2><h1>a</h1><h1> </h1>
    <link rel=canonical href=/c><link rel="Canonical" href=/d>
    <script type="application/ld+json"> </script><script type="application/ld+json">{"a":1}</script>"""
    assert items(page(html), "metadata") == [
        ("T", {"field": "title"}),
        ("x", {"field": "og:title"}),
        (" 5 ", {"field": "refresh"}),
        ("a", {"field": "h1"}),
        ("b", {"field": "h2"}),
        ("/c", {"field": "canonical"}),
        ('{"a":1}', {"field": "json-ld", "index": "1"}),
    ]


def test_empty_first_title_gives_none(page):
    assert items(page("<title></title><title>x</title>"), "metadata") == []


def test_assets(page):
    html = """<img src="/a.png" alt="" height=2><img srcset="/a.png 1x,  /b.PNG?v=1 2x,"><img src="">
    <script src=s.js defer></script><link rel=stylesheet><link rel="shortcut icon" href=/f.ico>
    <a href="/x.DOCX?y">d</a><a href=/x.docx>e</a><video src=v.mp4><source src=v.webm></video><source src=no.mp4>
    <audio><source src=""><source src=a.mp3></audio>"""
    assert items(page(html), "assets") == [
        ("https://shop.test/a.png", {"asset_type": "image", "tag": "img", "extension": ".png", "height": "2"}),
        ("https://shop.test/dir/page", {"asset_type": "image", "tag": "img"}),
        ("https://shop.test/b.PNG?v=1", {"asset_type": "image", "tag": "img-srcset", "extension": ".png"}),
        ("https://shop.test/dir/s.js", {"asset_type": "script", "tag": "script", "extension": ".js", "defer": "true"}),
        ("https://shop.test/f.ico", {"asset_type": "icon", "tag": "link", "extension": ".ico", "rel": "shortcut icon"}),
        ("https://shop.test/x.DOCX?y", {"asset_type": "document", "tag": "a", "extension": ".docx"}),
        ("https://shop.test/x.docx", {"asset_type": "document", "tag": "a", "extension": ".docx"}),
        ("https://shop.test/dir/v.mp4", {"asset_type": "video", "tag": "video", "extension": ".mp4"}),
        ("https://shop.test/dir/v.webm", {"asset_type": "video", "tag": "video", "extension": ".webm"}),
        ("https://shop.test/dir/a.mp3", {"asset_type": "audio", "tag": "audio", "extension": ".mp3"}),
    ]


@pytest.mark.parametrize(
    "html, value, inputs",
    [
        ("<form><input type=text></form>", "FORM#1 GET  (0 inputs)", None),
        ("<form id=f><input type=text></form>", "FORM#1 GET  (1 inputs)", "input[name=,type=text]"),
        (
            "<form method=post action=/s><textarea name=t>x</textarea><select name=s></select>"
            f"<input name=v value={'x' * 51}>",
            "FORM#1 POST /s (3 inputs)",
            f"textarea[name=t,type=] | select[name=s,type=] | input[name=v,type=,value={'x' * 50}...]",
        ),
        ("<form><form id=in><input name=a></form>", "FORM#1 GET  (1 inputs)", "input[name=a,type=]"),
    ],
)
def test_forms(page, html, value, inputs):
    ((got, meta),) = items(page(html), "forms")
    assert (got, meta.get("inputs")) == (value, inputs)


def test_api_endpoints(spark, page):
    calls = [
        ("https://h/v1/a", "GET", "", "xhr"), ("https://h/v1/a", "POST", "application/json", None),
        ("https://h/v1/a", "GET", "late", "fetch"), ("https://h/v1/api.mapbox", "GET", "", "xhr"),
        ("https://h/v1/b", "GET", "", "STYLESHEET"),
    ]
    df = spark.createDataFrame(
        [(1, "https://shop.test/", calls)],
        "page_id long, url string, intercepted_requests array<struct<url:string,method:string,"
        "content_type:string,resource_type:string>>",
    )
    assert items(df, "api_endpoints") == [
        ("https://h/v1/a", {"method": "GET", "resource_type": "xhr"}),
        ("https://h/v1/a", {"method": "POST", "content_type": "application/json"}),
    ]


def test_pages_without_html_have_results_without_items(page):
    (row,) = page_results(page("")).collect()
    assert row.page.page_id == 1 and row.extracted_items == []


def test_registry(page):
    reg = Registry()
    assert reg.names() == [
        "links", "forms", "emails", "phones", "social", "metadata", "assets", "api_endpoints",
    ]

    def broken(p):
        raise ValueError("no")

    reg.register("broken", broken, row_level=True)
    reg.register("words", lambda p: [{"value": len(p["raw_html"])}], row_level=True)
    reg.register("worse", lambda df: df.select("no_such_column"))
    df = page("<a href=/x>y</a>")
    got = {(r.type, r.value) for r in extract_all(df, reg).collect()}
    assert got == {("link", "https://shop.test/x"), ("words", "16")}
    errors = {r.extractor: (r.page_id, r.error) for r in extractor_errors(df, reg).collect()}
    assert errors["broken"] == (1, "ValueError: no")
    assert errors["worse"][0] is None and errors["worse"][1].startswith("AnalysisException")
    assert set(errors) == {"broken", "worse"}
    with pytest.raises(ValueError):
        reg.register("links", broken)


def test_keep_first_is_idempotent(page):
    df = extract(page("<img src=1.png><img src=2.png><script src=3.js></script>"), "assets")
    once = keep_first(df, ["source_url"])
    assert [r.value for r in once.collect()] == ["https://shop.test/dir/1.png"]
    assert keep_first(once, ["source_url"]).collect() == once.collect()


def test_row_extractors_run_once_per_page(spark, tmp_path):
    """Items and errors of one run, ``nth`` in registry order, one call per page and function."""
    calls = spark.sparkContext.accumulator(0)

    def counted(p):
        calls.add(1)
        if p["page_id"] % 3 == 0:
            raise ValueError("third")
        return [{"value": p["url"], "type": "own"}, {"value": p["intercepted_requests"][0].url}]

    rows = [(i, f"https://h/{i}", "<title>t</title>", 500 if i == 8 else 200, [("u", "GET", "", "")]) for i in range(9)]
    df = spark.createDataFrame(
        rows, "page_id long, url string, html string, status_code int, intercepted_requests"
        " array<struct<url:string,method:string,content_type:string,resource_type:string>>",
    )
    reg = Registry(built_in=["links", "metadata"])
    reg.register("counted", counted, row_level=True, columns=("page_id", "url", "intercepted_requests"))
    reg.register("frame", lambda p: p.selectExpr("page_id", "'framed' AS value", "'frame' AS type"))
    reg.register("worse", lambda p: p.select("no_such_column"))
    found, errors = extract_checked(df, reg, str(tmp_path / "run"))
    got = {(r.page_id, r.ord.nth, r.type, r.value) for r in found.collect()}
    want = {(i, 1, "metadata", "t") for i in range(8)} | {(i, 3, "frame", "framed") for i in range(8)}
    want |= {(i, 2, *x) for i in range(8) if i % 3 for x in (("own", f"https://h/{i}"), ("counted", "u"))}
    assert got == want
    listed = sorted((r.page_id, r.url, r.extractor) for r in errors.where("page_id IS NOT NULL").collect())
    assert listed == [(i, f"https://h/{i}", "counted") for i in (0, 3, 6)]
    assert [r.extractor for r in errors.where("page_id IS NULL").collect()] == ["worse"]
    assert calls.value == 8
    assert {(r.page_id, r.ord.nth, r.type, r.value) for r in extract_all(df, reg).collect()} == want


@pytest.mark.parametrize("bytes_", [1 << 20, 0])
def test_platforms_from_a_table_of_any_size(spark, page, monkeypatch, bytes_):
    """The join gives what the expression gives, broadcast or not."""
    monkeypatch.setattr(platforms, "KEY_BYTES", bytes_)
    rows = [
        ("b", "https://A.test/", 5), ("a", "a.test/x", 5), ("short", "q", 1), ("none", "", 0), (None, "a.test", 0),
        ("late", "https://a.test/x?q", 9), ("late", "never", -3), ("b", "https://A.test/", 5), ("tail", "#z", 7),
    ]
    table = spark.createDataFrame(rows, "platform string, pattern string, rank int")
    hrefs = ["http://A.TEST/x", "//a.test/", "/x?q=1", "#z", "https://a.test/x?Q", "https://a.test/x?Q", "n", "", "mailto:q@a.test"]
    df = page("".join(f"<a href='{h}'>t{i}</a>" for i, h in enumerate(hrefs)))
    df = df.unionByName(df).unionByName(df.selectExpr("page_id + 1 AS page_id", "url", "'' AS html"))
    key = lambda rows: sorted((r.page_id, r.value, r.source_url, str(r.metadata), r.ord.pos) for r in rows)
    want = extract(df, "social", platforms=social.platforms_of(table))
    assert key(platforms.social_items(df, table).collect()) == key(want.collect())
    assert platforms.social_items(df, table.limit(0)).count() == 0
    reg = Registry(built_in=["links"])
    reg.register("social", lambda p: platforms.social_items(p, table))
    assert key(extract_all(df, reg).where("type = 'social'").collect()) == key(want.collect())


def test_pattern_keys_are_rare(spark):
    table = spark.range(500).selectExpr("concat('p', id) AS platform", "concat('https://www.site', id, '.test/') AS pattern", "id AS rank")
    shared = platforms.pattern_keys(table).groupBy("key").count().agg({"count": "max"}).first()[0]
    assert shared <= 11


def test_items_are_never_broadcast(spark, page):
    """However small the files look that the pages were read from."""
    from pageloom.plans.pipeline import attach_items

    df = page("<a href=/x>x</a>")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    joined = attach_items(df.select("page_id"), extract(df, "links"))
    assert "BroadcastHashJoin" not in plan(joined) and "SortMergeJoin" in plan(joined)
    assert [(r.page_id, r.value) for r in joined.collect()] == [(1, "https://shop.test/x")]


def test_large_platform_tables_are_not_broadcast(spark, page, monkeypatch):
    monkeypatch.setattr(platforms, "KEY_BYTES", 0)
    table = spark.range(50).selectExpr("concat('p', id % 7) AS platform", "concat('/u', id, '/') AS pattern", "id AS rank")
    df = page("<a href=/u7/>x</a><a href=/u8/>y</a><a href=/none/>z</a>")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    found = platforms.social_items(df, table)
    assert not any("BroadcastHashJoin" in plan(x) for x in (platforms.pattern_keys(table), found))
    assert sorted((r.value, r.metadata["platform"]) for r in found.collect()) == [("https://shop.test/u7/", "p0"), ("https://shop.test/u8/", "p1")]


def test_pages_are_dealt_evenly_whatever_the_splits_hold(spark, tmp_path):
    """All rows of a file may lie in one of its splits, where its row group starts."""
    from pyspark.sql import functions as F

    from pageloom.sources.corpora import customer_pages, site_pages

    n = 4000
    tables = {
        "region": spark.range(2).selectExpr("CAST(id AS INT) AS r_regionkey", "concat('R', id) AS r_name"),
        "nation": spark.range(4).selectExpr("CAST(id AS INT) AS n_nationkey", "concat('N', id) AS n_name", "CAST(id % 2 AS INT) AS n_regionkey"),
        "customer": spark.range(n).selectExpr("id AS c_custkey", "concat('C', id, uuid()) AS c_name", "'M' AS c_mktsegment"),
        "orders": spark.range(n).selectExpr("id AS o_orderkey", "id AS o_custkey", "uuid() AS o_comment"),
    }
    for name, df in tables.items():
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    small = {"spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "1"}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        for made, rows in ((customer_pages, n), (site_pages, 2 * n)):
            parts = made(spark, str(tmp_path)).select("url").groupBy(F.spark_partition_id()).count().collect()
            assert sum(r["count"] for r in parts) >= rows and max(r["count"] for r in parts) <= n // 8
    finally:
        for k in small:
            spark.conf.unset(k)


def test_items_are_made_whole_and_once(page):
    # no second pass that builds every item again around its number
    assert all(f"'nth', {NTH}" in m.items_sql() for m in BUILT_IN.values())
    df = page('<a href="https://github.com/u">g</a><a href="/a.pdf?x">f</a><a href="/b">b</a><title>t</title>')
    reg = Registry(built_in=["social", "assets", "links", "metadata"])
    got = sorted((r.ord.nth, r.ord.pos, r.type, r.value) for r in extract_all(df, reg).collect())
    site = "https://shop.test"
    assert got == [
        (0, 0, "social", "https://github.com/u"),
        (1, 1, "asset", f"{site}/a.pdf?x"),
        (2, 0, "link", "https://github.com/u"),
        (2, 1, "link", f"{site}/a.pdf?x"),
        (2, 2, "link", f"{site}/b"),
        (3, 3, "metadata", "t"),
    ]


def test_only_linked_files_become_candidates():
    # the test is part of the choice of anchors, before anything is built of them
    chosen = assets.candidates_sql().split("e.tag = 'a' AND ")[1]
    assert chosen.startswith("e.attrs['href'] RLIKE ")
