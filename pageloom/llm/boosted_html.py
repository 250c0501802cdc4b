"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page becomes a tree of its block elements, with the runs of text between them as
leaves. Each node has features: its tag and attribute words, those of its ancestors,
density of text, links and punctuation in its subtree, depth, and its place among its
siblings. Boosted trees give each node the log-odds that it holds main text. Decoding
chooses the best labelling in which nothing below a dropped node is kept, so no
ancestor and descendant contradict each other.

The model is fitted here, on a bounded sample of pages that mark their main text
themselves; variants of these pages teach it other ways to mark up the same."""

from __future__ import annotations

import html as entities
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.tables import hash_share, plain_columns

#: pages the model is fitted on, about, and variants made of each
SAMPLE_PAGES, VARIANTS = 200, 6
#: characters of the longest page to learn from; longer ones are extracted like any other
SAMPLE_CHARS = 1 << 20
TREES, DEPTH, RATE, BINS, LEAST = 40, 4, 0.3, 32, 20

RAW = frozenset("script style template noscript iframe svg math object canvas title textarea noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
CONTROLS = frozenset("input button select option textarea label".split())
#: a start tag of the key ends an open element of these, up to the scope
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPES = frozenset("table ul ol dl html body article section div td th select".split())

AGAINST_TAGS = frozenset("nav header footer aside form button select menu dialog fieldset".split())
FOR_TAGS = frozenset("article main".split())
AGAINST_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs header masthead footer sidebar side aside widget cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe signup login search share sharing social related recommended "
    "recommendations comment comments commentlist reply replies respond disqus discussion form pagination pager copyright "
    "legal disclaimer toolbar topbar skip".split()
)
FOR_WORDS = frozenset("article content main post entry story body text prose".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_MARK = re.compile(r"[.,;!?]")
FEATURES = 20


class Page:
    """Nodes in page order; a parent comes before its children. kind '' is a run of text."""

    def __init__(self):
        self.tag, self.parent, self.words = ["#root"], [-1], [frozenset()]
        self.text, self.links, self.controls = [""], [0], [0]

    def add(self, tag: str, parent: int, words=frozenset(), text: str = "", links: int = 0) -> int:
        for column, value in (
            (self.tag, tag), (self.parent, parent), (self.words, words), (self.text, text),
            (self.links, links), (self.controls, 0),
        ):
            column.append(value)
        return len(self.tag) - 1


def parse(html: str) -> Page:
    """One pass, linear in the page also where markup is broken: behind the last '>'
    there are no tags, and after a quote that never closes quotes count as text."""
    page, open_, run, links, in_link = Page(), [0], [], 0, 0
    end, at, broken = html.rfind(">") + 1, 0, False
    low = None
    places: dict[str, list[int]] = defaultdict(list)  # where the open elements of each name are

    def close(k: int) -> None:
        for n in open_[k:]:
            places[page.tag[n]].pop()
        del open_[k:]

    def text(piece: str) -> None:
        nonlocal links
        if piece:
            piece = entities.unescape(piece) if "&" in piece else piece
            run.append(piece)
            if in_link:
                links += len(piece)

    def flush() -> None:
        nonlocal links
        if run:
            whole = " ".join("".join(run).split())
            run.clear()
            if whole:
                page.add("", open_[-1], text=whole, links=min(links, len(whole)))
        links = 0

    while True:
        lt = html.find("<", at, end)
        if lt < 0:
            text(html[at:])
            break
        if lt > at:
            text(html[at:lt])
        if html.startswith("<!--", lt):
            stop = html.find("-->", lt + 4)
            at = len(html) if stop < 0 else stop + 3
            continue
        if html[lt + 1] in "!?":
            at = html.find(">", lt) + 1 or len(html)
            continue
        tag = None if broken else _TAG.match(html, lt, end)
        if tag is None:
            tag = _PLAIN_TAG.match(html, lt, end)
            broken = broken or tag is not None
        if tag is None:
            text("<")
            at = lt + 1
            continue
        at, name = tag.end(), tag[2].lower()
        if name in RAW:
            if not tag[1]:
                low = html.lower() if low is None else low
                stop = low.find(f"</{name}", at) if len(low) == len(html) else html.find(f"</{name}", at)
                stop = len(html) if stop < 0 else html.find(">", stop) + 1
                at = stop or len(html)
            continue
        if name in INLINE:
            if name in ("a", "label"):
                in_link = 0 if tag[1] else 1
            elif name in ("br", "img", "wbr"):
                run.append("" if name == "wbr" else " ")
            if name in CONTROLS and not tag[1]:
                page.controls[open_[-1]] += 1
            continue
        flush()
        if name in VOID:
            if name in CONTROLS:
                page.controls[open_[-1]] += 1
            continue
        in_link = 0
        if tag[1]:
            if places[name]:
                close(places[name][-1])
            continue
        if page.tag[open_[-1]] == "p":  # any block ends a paragraph
            close(len(open_) - 1)
        closes = CLOSES.get(name)
        if closes:
            k = max((places[t][-1] for t in (*closes, *SCOPES) if places[t]), default=0)
            if page.tag[open_[k]] in closes:
                close(k)
        words = set()
        for m in _ATTR.finditer(tag[3]):
            words.update(_WORD.findall(_CAMEL.sub(" ", m[1] or m[2] or m[3] or "").lower()))
        node = page.add(name, open_[-1], frozenset(words))
        if "hidden" in tag[3]:
            page.words[node] |= {"hidden"}
        places[name].append(len(open_))
        open_.append(node)
    flush()
    return page


def features(page: Page) -> np.ndarray:
    n = len(page.tag)
    parent = page.parent
    chars, links, marks, spaces, runs, below, controls = (np.zeros(n) for _ in range(7))
    for k in range(n):
        if t := page.text[k]:
            chars[k], links[k], marks[k], spaces[k], runs[k] = len(t), page.links[k], len(_MARK.findall(t)), t.count(" ") + 1, 1
        controls[k] = page.controls[k]
    children: list[list[int]] = [[] for _ in range(n)]
    start = np.cumsum(chars) - chars
    for k in range(n - 1, 0, -1):
        p = parent[k]
        chars[p] += chars[k]
        links[p] += links[k]
        marks[p] += marks[k]
        spaces[p] += spaces[k]
        runs[p] += runs[k]
        controls[p] += controls[k]
        below[p] += below[k] + 1
        children[p].append(k)
    out = np.zeros((n, FEATURES))
    total = max(chars[0], 1)
    against, in_favour, depth = [0] * n, [0] * n, [0] * n
    for k in range(1, n):
        tag, words, p = page.tag[k], page.words[k], parent[k]
        no = len(words & AGAINST_WORDS) + (tag in AGAINST_TAGS)
        yes = len(words & FOR_WORDS) + (tag in FOR_TAGS)
        against[k], in_favour[k], depth[k] = against[p] + no, in_favour[p] + yes, depth[p] + 1
        kin = children[p]
        row = out[k]
        row[0], row[1], row[2], row[3] = no, yes, against[p], in_favour[p]
        row[4], row[5] = tag == "", tag == "p"
        row[6] = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        row[7] = tag in ("li", "ul", "ol", "dl", "dt", "dd")
        row[8] = depth[k]
        row[18] = len(kin)
        row[19] = "hidden" in words
    safe = np.maximum(chars, 1)
    out[:, 9] = np.log1p(chars)
    out[:, 10] = links / safe
    out[:, 11] = chars / (below + 1)
    out[:, 12] = marks / np.maximum(spaces, 1)
    out[:, 13] = spaces / np.maximum(runs, 1)
    out[:, 14] = chars / total
    out[:, 15] = start / total
    out[:, 16] = controls
    at = np.array([0, *parent[1:]])
    out[:, 17] = chars / np.maximum(chars[at], 1)
    return out


def decode(page: Page, odds: np.ndarray) -> list[bool]:
    """The labelling with the largest sum of odds in which a dropped node keeps nothing.

    A run of text counts as its length asks: all nodes have one vote."""
    n = len(odds)
    keep, drop = odds.copy(), -odds
    keep[0] = 1e9  # the root holds the page
    for k in range(n - 1, 0, -1):
        p = page.parent[k]
        keep[p] += max(keep[k], drop[k])
        drop[p] += drop[k]
    kept = [True] * n
    for k in range(1, n):
        kept[k] = kept[page.parent[k]] and bool(keep[k] > drop[k])
    return kept


class Boosted:
    """Trees of fixed depth over binned features, fitted to logistic loss by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        bins = self.binned(x)
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, self.trees = float(np.log(mean / (1 - mean))), []
        score = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(bins, p - y, np.maximum(p * (1 - p), 1e-6))
            self.trees.append(tree)
            score += self._walk(tree, bins)

    def binned(self, x: np.ndarray) -> np.ndarray:
        # <= an edge is left of it
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1).astype("u1")

    def _grow(self, bins, g, h) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        feature, cut = np.zeros(2**DEPTH - 1, "i8"), np.full(2**DEPTH - 1, 255)
        at = np.zeros(len(g), "i8")
        for node in range(2**DEPTH - 1):
            here = np.flatnonzero(at == node)
            best = 1e-9
            if len(here) >= 2 * LEAST:
                gn, hn = g[here], h[here]
                whole = gn.sum() ** 2 / (hn.sum() + 1)
                for f, edges in enumerate(self.edges):
                    size = len(edges) + 1
                    if size < 2:
                        continue
                    b = bins[here, f]
                    gl, hl, nl = (np.bincount(b, w, size).cumsum()[:-1] for w in (gn, hn, np.ones(len(here))))
                    gain = gl**2 / (hl + 1) + (gn.sum() - gl) ** 2 / (hn.sum() - hl + 1) - whole
                    gain[(nl < LEAST) | (len(here) - nl < LEAST)] = -1
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, feature[node], cut[node] = gain[k], f, k
            at[here] = 2 * node + 1 + (bins[here, feature[node]] > cut[node])
        leaf = at - (2**DEPTH - 1)
        gs, hs = (np.bincount(leaf, w, 2**DEPTH) for w in (g, h))
        return feature, cut, -RATE * gs / (hs + 1)

    def _walk(self, tree, bins) -> np.ndarray:
        feature, cut, value = tree
        at, rows = np.zeros(len(bins), "i8"), np.arange(len(bins))
        for _ in range(DEPTH):
            at = 2 * at + 1 + (bins[rows, feature[at]] > cut[at])
        return value[at - (2**DEPTH - 1)]

    def odds(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        return self.base + sum(self._walk(t, bins) for t in self.trees)


# what variants are made of: (tag, attribute words) that hold main text or something else
_GOOD = ["article", "main", "article class=post", "div class=content", "div id=main-content", "div class='entry-content'",
         "section class=story", "div class=article-body", "div", "section"]
_BAD = ["nav", "ul class=menu", "div class=navbar", "header", "header class=masthead", "footer", "div class=footer", "aside",
        "aside class=sidebar", "div class=sidebar", "div class=notice", "div class=cookie-consent", "div id=banner",
        "div class=ad", "div class=advert", "div class=sponsored", "section class=comments", "div id=comments",
        "form", "form class=newsletter", "div class=related", "div class=share", "div class=breadcrumb", "div role=alert"]
_INSIDE = ["aside", "div class=ad", "div class=advert", "section class=comments", "div class=comments", "form",
           "div class=share", "div class=related", "nav class=breadcrumb", "header", "footer", "div class=notice"]
#: a page that may mark its main text
_MARKED = r"(?i)<(article|main)\b"
_MAIN = re.compile(r"(?is)<(article|main)\b[^>]*>(.*?)(?:</\1\s*>|\Z)")


def _block(rng: random.Random, kind: str, texts: list[str]) -> str:
    name = kind.split()[0]
    some = [rng.choice(texts) for _ in range(rng.randint(1, 5))]
    look = rng.random()
    if name == "form":
        inner = "".join(f"<label>{t[:40]}</label><input>" for t in some) + "<button>" + some[0][:20] + "</button>"
    elif name in ("nav", "ul") or "menu" in kind or look < 0.25:
        inner = "<ul>" + "".join(f"<li><a href=/x>{t[:24]}</a></li>" for t in some) + "</ul>"
    elif look < 0.55:
        inner = some[0]
    elif "comment" in kind:
        inner = "".join(f"<article class=comment><p>{t}</p></article>" if look < 0.8 else f"<div class=reply><p>{t}</p></div>" for t in some)
    else:
        inner = "".join(f"<p>{t}</p>" for t in some)
    return f"<{kind} data-role-other=1>{inner}</{name}>"


def _variant(rng: random.Random, main: str, texts: list[str]) -> str:
    good = rng.choice(_GOOD)
    around = lambda: "".join(_block(rng, rng.choice(_BAD), texts) for _ in range(rng.randint(0, 3)))
    inside = lambda: "".join(_block(rng, rng.choice(_INSIDE), texts) for _ in range(rng.choice((0, 0, 1))))
    body = f"{around()}<{good} data-role-main=1>{inside()}{main}{inside()}</{good.split()[0]}>{around()}"
    for _ in range(rng.choice((0, 0, 1, 2))):
        body = f"<div{rng.choice(('', ' class=wrapper', ' id=page'))}>{body}</div>"
    return f"<html><body>{body}</body></html>"


def _labels(page: Page, tags: list[str]) -> np.ndarray:
    """Whether a node holds main text: the mark of the nearest marked element at or above."""
    n = len(page.tag)
    inside = [False] * n
    for k in range(1, n):
        inside[k] = {"main": True, "other": False}.get(tags[k], inside[page.parent[k]])
    holds = [inside[k] and page.tag[k] == "" for k in range(n)]
    for k in range(n - 1, 0, -1):
        holds[page.parent[k]] = holds[page.parent[k]] or holds[k]
    return np.array(holds, "f8")


_ROLE = re.compile(r" data-role-(main|other)=1")


def fit(sample: list[str]) -> Boosted | None:
    """From pages that mark their main text by an article or main element; None if there are none."""
    rng = random.Random(7)
    found = [m[2] for h in sample if (m := _MAIN.search(h))]
    texts = [t for m in found for t in parse(m).text if t]
    if not texts:
        return None
    xs, ys = [], []
    for h in sample:
        m = _MAIN.search(h)
        if m is None:
            continue
        name = m[1]
        marked = h[: m.start()] + f"<{name} data-role-main=1>" + m[2] + h[m.end() - len(f"</{name}>") :]
        for page_html in (marked, *(_variant(rng, m[2], texts) for _ in range(VARIANTS))):
            # the marks are for the labels only: roles of nodes in order, then parsed without
            roles: list[str] = []
            numbered = _ROLE.sub(lambda r: f" role=xrole{r[1]}", page_html)
            with_roles = parse(numbered)
            for words in with_roles.words:
                roles.append("main" if "xrolemain" in words else "other" if "xroleother" in words else "")
            page = parse(_ROLE.sub("", page_html))
            xs.append(features(page)[1:])
            ys.append(_labels(with_roles, roles)[1:])
    return Boosted(np.concatenate(xs), np.concatenate(ys))


def main_text(page: Page, odds: np.ndarray) -> str:
    kept = decode(page, odds)
    return " ".join(t for t, k in zip(page.text, kept, strict=True) if k and t)


def trained(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, page_chars: int = SAMPLE_CHARS) -> Boosted | None:
    """Fitted on about ``sample_pages`` different pages that name an article or main element,
    of at most ``page_chars`` characters, chosen by a hash of their HTML; on all of them where
    there are fewer. None if no page names one.

    The different pages of that kind are counted before, so that only the sample travels,
    and neither copies nor pages without a mark take a place in it."""
    rows = plain_columns(pages, "html").where(F.col("html").rlike(_MARKED) & (F.length("html") <= page_chars))
    # by a sketch, which is exact or nearly so where there are few
    share = sample_pages / max(1, rows.agg(F.approx_count_distinct(F.xxhash64("html"), 0.02)).first()[0])
    chosen = rows.where(hash_share("html") <= share).groupBy(F.xxhash64("html").alias("h")).agg(F.min("html").alias("html"))
    return fit([r.html for r in chosen.orderBy("h").limit(2 * sample_pages).collect()])


def extracted(pages: DataFrame, model: Boosted | None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``, from its whole HTML.

    Null and empty pages, and pages without main text, give the empty text. Without a
    model (nothing to learn from) all text of the page is kept. Repeated rows stay
    repeated; an empty table gives no rows."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            texts: list[str] = []
            for first in range(0, b.num_rows, 256):
                dom = [parse(h.as_py() or "") for h in b.column(2).slice(first, 256)]
                rows = [features(p) for p in dom]
                if model is None:
                    odds = np.ones(sum(map(len, rows)))
                else:
                    odds = model.odds(np.concatenate(rows))
                ends = np.cumsum([len(r) for r in rows])
                texts += [main_text(p, odds[e - len(r) : e]) for p, r, e in zip(dom, rows, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, "string"), pa.array(map(len, texts), "int64")],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return plain_columns(pages, "page_id", "url", "html").mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars long"
    )
