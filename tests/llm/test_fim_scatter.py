import hashlib

import numpy as np
import pytest

from pageloom.llm import fim_scatter, queries


def plainly(doc_id, text):
    """The rule, one text at a time."""
    text = text or ""
    n = len(text)
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, q = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < 20:
        return n, "spm", p, q - p, f"<S>{text[q:]}<P>{text[:p]}<M>{text[p:q]}"
    return n, "psm", p, q - p, f"<P>{text[:p]}<S>{text[q:]}<M>{text[p:q]}"


ODD = [None, "", "<P>", "a<S>b", "<M", "M>", "<P", "S>x", "ü", "漢字", "a😀b" * 7, "<" * 50, "<P<S<M>" * 3, ">P<" * 9, "é" * 300_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, ODD[k % len(ODD)], "x", 1) for k in range(len(ODD) * 40)] + [(None, "no number", "x", 2), (3, "ab", "y", 3), (3, "ab", "y", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, output string, n long").repartition(3)


def test_against_plain_rule(docs):
    want = sorted((str((r.doc_id, *plainly(r.doc_id, r.text))) for r in docs.collect()))
    got = fim_scatter.transformed(docs)
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    forms = {r.form for r in got.select("form").distinct().collect()}
    assert forms == {"plain", "psm", "spm"}


def test_round_trip(docs, odd_docs, no_docs):
    for table in (docs, odd_docs):
        back = fim_scatter.restored(fim_scatter.transformed(table))
        got = sorted((str(r.doc_id), r.restored) for r in back.select("doc_id", "restored").collect())
        assert got == sorted((str(r.doc_id), r.text or "") for r in table.collect())
    assert fim_scatter.restored(fim_scatter.transformed(no_docs)).count() == 0


def test_restores_from_output_and_form_alone(spark):
    rows = [("psm", "<P>a<S>c<M>b"), ("spm", "<S>c<P>a<M>b"), ("plain", "x<P>y<S><M>"), ("psm", "<P><S><M>"), ("plain", None)]
    got = fim_scatter.restored(spark.createDataFrame(rows, "form string, output string")).collect()
    assert [r.restored for r in got] == ["abc", "abc", "x<P>y<S><M>", "", ""]
    bad = spark.createDataFrame([("psm", "<P>a<S>b")], "form string, output string")
    with pytest.raises(Exception, match="exactly one mark"):
        fim_scatter.restored(bad).collect()


@pytest.mark.parametrize("window", [1, 2, 3, 7, 1000])
def test_windows(window):
    rng = np.random.default_rng(window)
    data = np.frombuffer("aé漢😀<".encode() * 30, np.uint8)
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    ranks = np.sort(rng.integers(0, len(heads) + 1, 40))
    assert fim_scatter.nth_heads(data, ranks, window).tolist() == np.append(heads, len(data))[ranks].tolist()
    # stretches, empty ones too, dealt out in another order
    cut = np.sort(rng.integers(0, len(data) + 1, 9))
    begins, ends = np.append(0, cut), np.append(cut, len(data))
    size, order = ends - begins, rng.permutation(len(begins))
    to = np.empty(len(begins), np.int64)
    to[order] = np.cumsum(size[order]) - size[order]
    places = [p for _, p in fim_scatter.displacements(len(data), begins, to - begins, window)]
    want = np.concatenate([np.arange(t, t + s) for t, s in zip(to, size, strict=True)])
    assert np.concatenate(places).tolist() == want.tolist()


def test_query_reads_whole_texts(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in queries.op12_fill_in_middle(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        n, form, p, m, out = plainly(d.doc_id, d.text)
        r = rows[d.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, p, m)
        assert r.output_sha256 == hashlib.sha256(out.encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
