import pytest

from pageloom.functions import urls as U

BASE = "http://a/b/c/d;p?q"
# RFC 3986 section 5.4; ".." never climbs above the root
RFC = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/",
    "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y",
    "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s",
    ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "": "http://a/b/c/d;p?q",
    ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/",
    "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g",
    "../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.",
    ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g",
    "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h",
    "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g?y/../x": "http://a/b/c/g?y/../x",
    "g#s/../x": "http://a/b/c/g#s/../x",
}
OTHER = {
    "/für": "http://a/f%C3%BCr", "/a b!": "http://a/a%20b%21", "/a!(b)": "http://a/a!(b)",
    "/%41é": "http://a/A%C3%A9", "/x?q=é b": "http://a/x?q=é b", "a:b:c": "a:b:c", "1a:b": None,
    "/a%zz": None, "//ho st/": None, "///x": "http://a///x", "/a#": "http://a/a", "/a?": "http://a/a?",
    "http:///x": "http:///x", "MAILTO:a@b.co": "mailto:a@b.co", "//o.test:8/x": "http://o.test:8/x",
    "/a#b c": "http://a/a#b%20c", "//münchen.de/ü": "http://m%C3%BCnchen.de/%C3%BC",
    "a\nb": None, "HTTP://H/A": "http://H/A", "http://h": "http://h", "http://h/..": "http://h/",
    "https://h/a/b?x=1#f": "https://h/a/b?x=1#f", "/.hidden": "http://a/.hidden",
    "http://h:80x/": None, "//": "http:",
}


@pytest.mark.parametrize("cases", [RFC, OTHER], ids=["rfc", "other"])
def test_resolve_url(spark, cases):
    df = spark.createDataFrame([(BASE, r) for r in cases], "b string, r string")
    got = {r.r: r.o for r in df.select("r", U.resolve_url("b", "r").alias("o")).collect()}
    assert got == cases


def test_resolve_without_base_returns_reference(spark):
    df = spark.createDataFrame([("http://a b/", "x y")], "b string, r string")
    assert df.select(U.resolve_url("b", "r").alias("o")).first().o == "x y"


CANONICAL = {
    "https://h/a//#f": "https://h/a", "https://h": "https://h/", "ftp://h/": None,
    "HTTP://H/a?x=1#y": "http://H/a?x=1", "https://h/a(b)/": "https://h/a%28b%29",
    "https://h/a(b)": "https://h/a(b)", "https://h/a%2F": "https://h/a", "https://h//": "https://h/",
    "https://h/a/?q": "https://h/a?q", "https://h?x": "https://h/?x", "/rel": None,
}


def test_canonical_url(spark):
    df = spark.createDataFrame([(u,) for u in CANONICAL], "u string")
    got = {r.u: r.c for r in df.select("u", U.canonical_url("u").alias("c")).collect()}
    assert got == CANONICAL
    no_query = df.where("u = 'https://h/a/?q'").select(U.canonical_url("u", True).alias("c"))
    assert no_query.first().c == "https://h/a"


def test_canonical_url_is_idempotent(spark):
    urls = [u for u in CANONICAL.values() if u]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert all(r.u == r.c for r in df.select("u", U.canonical_url("u").alias("c")).collect())


def test_host_extension_scheme_scope(spark):
    rows = [
        ("https://u@www.shop.test:443/i/A.PNG?v=1", "www.shop.test", ".png", True),
        ("http://shop.test/a.b/c", "shop.test", None, True),
        ("https://a.shop.test/x.tar.GZ#f", "a.shop.test", ".gz", False),
        ("mailto:x@shop.test", "", None, False),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "u string")
    got = df.select(
        U.host_name("u").alias("h"),
        U.url_extension("u").alias("e"),
        U.in_allowed_domain("u", "shop.test").alias("s"),
        U.is_http("u").alias("http"),
    ).collect()
    assert [(g.h, g.e, g.s) for g in got] == [r[1:] for r in rows]
    assert [g.http for g in got] == [True, True, True, False]
    assert df.select(U.in_allowed_domain("u", "x", allow_external=True).alias("s")).first().s


def test_with_scheme_is_case_sensitive(spark):
    df = spark.createDataFrame([("a.test",), ("http://a",), ("HTTP://a",)], "u string")
    got = [r.s for r in df.select(U.with_scheme("u").alias("s")).collect()]
    assert got == ["https://a.test", "http://a", "https://HTTP://a"]
