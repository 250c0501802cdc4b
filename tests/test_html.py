import re
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from pageloom.functions.html import document_sql
from pageloom.operators.shred import contained_elements, select_elements, shred_html


def shred(page, html, tags=None):
    rows = shred_html(page(html), tags).orderBy("pos").collect()
    return [(r.tag, r.attrs, r.text) for r in rows]


def test_raw_text_and_comments_hide_tags(page):
    html = '<!-- <a href="n"> --><script>var t="</p><a href=x>";</script><title>a <b> &amp;</title><a href=y>z</a>'
    assert shred(page, html, ("a", "script", "title", "p", "b")) == [
        ("script", {}, 'var t="</p><a href=x>";'),
        ("title", {}, "a <b> &"),
        ("a", {"href": "y"}, "z"),
    ]


def test_attributes(page):
    html = "<A HREF='1&amp;2' href=\"3\" checked data-x = y title=\"a > b\" q=it's>t</A>"
    assert shred(page, html) == [
        ("a", {"href": "1&2", "checked": "", "data-x": "y", "title": "a > b", "q": "it's"}, "t")
    ]


def test_text_of_anchors_and_headings(page):
    html = "<h1>a <a href=1>b <i>c</i></a> d</h2><a href=2>e<a href=3>f</a><h3> <!-- x --> g&nbsp;"
    got = [(t, x) for t, _, x in shred(page, html, ("a", "h1", "h3"))]
    assert got == [("h1", "a b c d"), ("a", "b c"), ("a", "e"), ("a", "f"), ("h3", "g")]


@pytest.mark.parametrize(
    "html, tags",
    [
        ("<script>unclosed <a href=1>x</a>", ["script"]),
        ("<a href=1>x</a><a href='2", ["a"]),
        ("a < b <p>c</p> <", ["p"]),
        ("<!-- unclosed <p>", []),
        ("<noscript><img src=1></noscript><img src=2>", ["noscript", "img"]),
        ("<!doctype html><p/><br><x-y z>", ["p", "br", "x-y"]),
        ("", []),
    ],
)
def test_broken_markup(page, html, tags):
    assert [t for t, _, _ in shred(page, html)] == tags


SHAPES = ("<a ", "<form ", "<p ", '<a b="', "<!--", "<script", "<form>", "<a href=x>", "<h1>", "<video ", "<![x", "</a ", '<a b=" ', "<")


def test_broken_markup_is_linear(spark):
    """Four times the markup takes little more than four times as long, for every shape and end."""
    from pageloom.plans.pipeline import page_items

    def seconds(n):
        rows = [(k, "https://h/", s * n + e) for k, (s, e) in enumerate((s, e) for s in SHAPES for e in ("", ">", "'>", '">'))]
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
        start = time.perf_counter()
        page_items(df).select(F.size("items")).collect()
        return time.perf_counter() - start

    seconds(10)
    assert seconds(8000) < 2 + 6 * seconds(2000)


def test_text_behind_the_last_tag(page):
    assert shred(page, "<a href=1>x < y <b z", ("a", "b")) == [("a", {"href": "1"}, "x < y <b z")]
    assert shred(page, "<script>if (a <b) c", ("script", "b")) == [("script", {}, "if (a <b) c")]
    assert shred(page, "<h1>x <!-- y", ("h1",)) == [("h1", {}, "x")]


def test_descendants(page):
    html = "<video><source src=1></video><source src=2><picture><source srcset=3></picture>"
    got = contained_elements(page(html), "picture", ("source",)).collect()
    assert [r.attrs for r in got] == [{"srcset": "3"}]


def test_selectors(page):
    df = shred_html(page("<link rel=icon href=a><link rel=Icon><a href=mailto:x>m</a><a>n</a>"))
    assert select_elements(df, "link", equals={"rel": "icon"}).count() == 1
    assert select_elements(df, "a", present="href").count() == 1
    assert select_elements(df, "a", prefix={"href": "mailto:"}).count() == 1


class Tags(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found = []

    def handle_starttag(self, tag, attrs):
        self.found.append((tag, {k: v or "" for k, v in reversed(attrs)}))


def test_same_tags_as_the_standard_parser(spark):
    from pageloom.sources.corpora import customer_pages
    from pageloom.sources.pages import read_pages

    d = "/root/testdata/sf0.001"
    for pages in (read_pages(spark, f"{d}/pages.parquet"), customer_pages(spark, d)):
        els = shred_html(pages).groupBy("page_id").agg(
            F.sort_array(F.collect_list(F.struct("pos", "tag", F.to_json("attrs").alias("a")))).alias("e")
        )
        got = {r.page_id: [(e.tag, e.a) for e in r.e] for r in els.collect()}
        import json

        for r in pages.select("page_id", "raw_html").collect():
            parser = Tags()
            parser.feed(r.raw_html)
            mine = [(t, json.loads(a)) for t, a in got[r.page_id]]
            assert mine == parser.found


def test_container_marks_are_looked_for_once():
    inside = {"picture": ("source",), "video": ("video", "source"), "audio": ("audio", "source")}
    places = re.findall(r"named_struct\('tag', \w+\.tag, 'i', \w+\)", document_sql("html", (), inside))
    assert len(places) == 1
