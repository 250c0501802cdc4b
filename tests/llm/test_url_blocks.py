import time

from pageloom.llm import url_blocks
from pageloom.llm.graph import components


def verdicts(spark, rows, links=None):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule long")
    links = links and spark.createDataFrame(links, "source string, target string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_blocks.judged(pages, links).collect()}


def page(i, url, html=""):
    return (i, url, html, "clash", 1)


def test_rules(spark):
    got = verdicts(spark, [
        page(1, "http://A.Example.NET/en/1?x"), page(2, "http://a.example.net/fr/1"), page(3, "x://example.com/de/"),
        page(4, "https://notexample.com/de/"), page(5, "https://a.org/fr/#t"), page(6, None), page(7, "example.net/en/"),
        page(8, "http://net"), page(9, "http://example.com"), page(10, "http://b://c.net/"), page(11, ""), page(12, "http://"),
    ])
    assert got == {
        1: ("a.example.net", "/en/1", "example.net/en/", "allow"), 2: ("a.example.net", "/fr/1", "net/", "block"),
        3: ("example.com", "/de/", "example.com/de/", "block"), 4: ("notexample.com", "/de/", None, "allow"),
        5: ("a.org", "/fr/", "org/fr/", "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
        8: ("net", "", None, "allow"), 9: ("example.com", "", None, "allow"), 10: ("b:", "//c.net/", None, "allow"),
        11: ("", "", None, "allow"), 12: ("", "", None, "allow"),
    }


def test_aliases(spark):
    canonical = '<link rel="canonical" href="{}">'.format
    got = verdicts(spark, [
        page(1, "http://a.test/x", canonical("http://bad.net/y")),  # to a blocked address
        page(2, "http://b.test/x", canonical("//a.test/x")),  # two steps away
        page(3, "http://c.test/x", '<META http-equiv="Refresh" content="0; URL=http://b.test/x">'),
        page(4, "http://d.test/x", "<!-- " + canonical("http://bad.net/y") + " --><script>" + canonical("http://bad.net/y")),
        page(5, "http://e.test/x", canonical("http://example.net/en/ok") + canonical("http://bad.net/z")),
        page(6, "http://bad.net/z"), page(7, "http://f.test/"), page(8, None, canonical("http://bad.net/y")),
    ], [("http://g.test/", "http://f.test"), ("http://f.test/", "http://worse.net/"), (None, "http://bad.net/y")])
    assert {k: v[3] for k, v in got.items()} == {
        1: "block", 2: "block", 3: "block", 4: "allow",
        5: "allow",  # an explicit allow among the aliases
        6: "block",  # its own rule
        7: "block", 8: "allow",
    }


def test_empty(spark):
    assert verdicts(spark, []) == {}


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (None, 3), (100, 102), (101, 102)]
    star = [(1000, k) for k in range(1001, 1200)]
    rows = spark.createDataFrame(chain + star, "a long, b long")
    got = {r.node: r.component for r in components(rows, "a", "b").collect()}
    want = {k: 0 for k in range(41)} | dict.fromkeys((100, 101, 102), 100) | dict.fromkeys(range(1000, 1200), 1000)
    assert got == want


def test_open_tags_without_end_are_linear(spark):
    """320 kB of link tags that never end, with and without a tag behind them."""
    for tail in ("", "<p>"):
        html = "<link canonical " * 20_000 + tail
        df = spark.createDataFrame([(1, "https://a.test/", html)], "page_id long, url string, html string")
        url_blocks.page_links(df).count()
        start = time.time()
        assert url_blocks.page_links(df).count() == 0
        assert time.time() - start < 5
