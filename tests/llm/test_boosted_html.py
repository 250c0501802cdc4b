import random
import time

import pytest

from pageloom.llm import boosted_html as bh


def pages(n):
    rng = random.Random(2)
    text = lambda k: " ".join(rng.choice("alpha beta gamma, delta. Epsilon zeta eta".split()) for _ in range(k))
    for k in range(n):
        body = "".join(f"<p>{text(rng.randint(3, 60))}</p>" for _ in range(rng.randint(1, 9)))
        yield (f"<html><body><nav><ul><li><a href=/>{text(2)}</a></ul></nav><div class=ad>{text(9)}</div>"
               f"<article><h1>{text(5)}</h1>{body}</article><footer>{text(8)}</footer></body></html>")  # fmt: skip


@pytest.fixture(scope="module")
def model():
    return bh.fit(list(pages(60)))


def read(model, html):
    page = bh.parse(html)
    return bh.main_text(page, model.odds(bh.features(page)))


def test_page(model):
    got = read(model, """<!DOCTYPE html><head><title>No</title><style>p{}</style></head><body><header><h2>Site name</h2></header>
      <nav class=top><a href=/>Home</a></nav><div class="cookie-notice">We use cookies.</div>
      <main><article><h1>The  title &amp; more</h1><p><b>First</b> part&nbsp;here, wor<i>ld</i>.<br>Next line<p>Second paragraph
      with text.<script>var a = "</p>";</script><div class=advert>Buy now, it is cheap.</div>
      <form><label>Mail</label><input name=q><button>Send</button></form><p>Last &lt;one&gt;.</article>
      <section class=comments><h3>Comments</h3><p>I do not agree with this, it is wrong, all of it.</p></section></main>
      <aside class=sidebar><p>Other texts that may be read here.</p></aside><footer>&copy; Me</footer>""")  # fmt: skip
    assert got == "The title & more First part here, world. Next line Second paragraph with text. Last <one>."


def test_held_out_variants(model):
    rng = random.Random(11)
    sample = list(pages(200))[60:]
    texts = [t for h in sample for t in bh.parse(h).text if t]
    right = total = 0
    for h in sample:
        html = bh._variant(rng, bh._MAIN.search(h)[2], texts)
        marked = bh.parse(bh._ROLE.sub(lambda r: f" role=xrole{r[1]}", html))
        roles = ["main" if "xrolemain" in w else "other" if "xroleother" in w else "" for w in marked.words]
        page = bh.parse(bh._ROLE.sub("", html))
        kept = bh.decode(page, model.odds(bh.features(page)))
        for y, k, t in zip(bh._labels(marked, roles), kept, page.text, strict=True):
            right += (bool(y) == k) * len(t)
            total += len(t)
    assert right / total > 0.97


def test_no_contradiction(model):
    rng = random.Random(4)
    for h in list(pages(20)):
        page = bh.parse(h)
        kept = bh.decode(page, [rng.gauss(0, 1) for _ in page.tag] and bh.np.array([rng.gauss(0, 1) for _ in page.tag]))
        assert all(kept[p] or not k for k, p in list(zip(kept, page.parent, strict=True))[1:])


@pytest.mark.parametrize("piece", ["<a ", "<p ", '<a b="', "<!--", "<script", "<div>", "<", "&", "<p><b>", "</p>", "<a b='>", "<x>", "<x><li>", "<div></x>"])
def test_broken_markup_is_linear(piece):
    def spent(n):
        start = time.process_time()
        bh.features(bh.parse(piece * n))
        return time.process_time() - start

    spent(1000)
    assert spent(80_000) < 8 * max(spent(20_000), 0.02)


def test_pages(spark, model):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain text only"), (3, "u", "plain text only"), (None, "u", "<p>a" * 3),
            (4, "u", "<nav>" + "x " * 200_000 + "</nav><article><p>" + "long text. " * 50_000)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url): r for r in bh.extracted(df, model).collect()}
    assert bh.extracted(df, model).count() == 6
    assert got[1, "u"].text == got[2, None].text == "" and got[2, None].n_chars == 0
    assert got[4, "u"].text == ("long text. " * 50_000).strip() and got[4, "u"].n_chars == 11 * 50_000 - 1
    assert bh.extracted(df.limit(0), model).count() == 0
    assert bh.trained(df.limit(0)) is None and bh.trained(df.where("page_id < 3")) is None
    assert {r.text for r in bh.extracted(df.where("page_id = 3"), None).collect()} == {"plain text only"}


@pytest.mark.parametrize("piece", ["<li></li>", "<td></td>", "</y>", "<dd><option>"])
def test_depth_is_no_square(piece):
    """Many open elements first, then many tags that look for one to close."""

    def spent(n):
        html = "<x>" * n + piece * n
        start = time.process_time()
        bh.parse(html)
        return time.process_time() - start

    spent(1000)
    assert spent(40_000) < 8 * max(spent(10_000), 0.02)


def test_decode_is_the_best_labelling():
    """Against every labelling of small trees in which a dropped node keeps nothing."""
    rng = random.Random(8)
    for _ in range(60):
        page = bh.Page()
        for _ in range(rng.randint(1, 8)):
            page.add("div", rng.randrange(len(page.tag)))
        n = len(page.tag)
        odds = bh.np.array([rng.gauss(0, 1) for _ in range(n)])

        def total(kept, odds=odds, page=page, n=n):
            if not kept[0] or any(kept[k] and not kept[page.parent[k]] for k in range(1, n)):
                return -1e9
            return sum(o if k else -o for o, k in zip(odds[1:], kept[1:], strict=True))

        best = max(total([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert abs(total(bh.decode(page, odds)) - best) < 1e-9


def test_copies_and_unmarked_pages_take_no_place_in_the_sample(spark):
    """100 article pages are learned from, whatever the number of copies of a page without one."""
    marked = [(k, "u", h) for k, h in enumerate(pages(100))]
    one = "<nav><a href=/>home</a></nav><div>This is some other text.</div>"
    rest = spark.range(100_000).selectExpr("id + 1000 AS page_id", "'u' AS url", f"concat('{one}', IF(id % 3 = 0, CAST(id AS STRING), '')) AS html")
    df = spark.createDataFrame(marked, "page_id long, url string, html string").unionByName(rest)
    learned = bh.trained(df)
    assert learned is not None
    got = {r.page_id: r.text for r in bh.extracted(df.where("page_id < 5"), learned).collect()}
    assert all(got[k] == read(bh.fit([h for _, _, h in marked]), h) for k, _, h in marked[:5])
    assert bh.trained(df, page_chars=10) is None
