import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import tokenizers

from pageloom.llm import diagonal_align, queries, transducer_bpe

ODD = [
    None, "", " ", "plain words, and some more of them", "a▁b", "▁", "x<|endoftext|>y<s></s><unk>", "漢字 हिन्दी 😀 \x00\x01", "  two  spaces\n\n\ttab",
    "=" * 3000, "ab" * 2000, "Zwölf große Bären", "the the the the the", "՘࢏",
]


@pytest.fixture(scope="module")
def libraries():
    a = tokenizers.Tokenizer.from_file(diagonal_align.BYTE_MODEL)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=diagonal_align.PIECE_MODEL)


def plainly(libraries, texts):
    """Every result the slow way: all pairs of a text's tokens whose byte ranges overlap."""
    a, b = libraries
    byte = {c: k for k, c in enumerate(transducer_bpe.byte_letters())}
    out = []
    for text in texts:
        whole = " " + (text or "")
        ids_a = a.encode(whole, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = []
        for i in ids_b:
            p = b.id_to_piece(i)
            bytes_b.append(bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
        if not text or b"".join(bytes_a) != whole.encode() or b"".join(bytes_b) != whole.encode():
            out.append((0, 0, [], []))
            continue
        end_a, end_b = (np.cumsum([len(x) for x in y]).tolist() for y in (bytes_a, bytes_b))
        common = sorted(set(end_a) & set(end_b))
        groups, lo = [], 0
        for hi in common:
            groups.append(tuple(",".join(str(i) for i, e in zip(ids, ends) if lo < e <= hi) for ids, ends in ((ids_a, end_a), (ids_b, end_b))))
            lo = hi
        links = []
        for i, ea in enumerate(end_a):
            sa = ea - len(bytes_a[i])
            links += [(ids_a[i], ids_b[j]) for j, eb in enumerate(end_b) if sa < eb and eb - len(bytes_b[j]) < ea]
        out.append((len(ids_a), len(ids_b), groups, links))
    counts = Counter(link for *_, links in out for link in links)
    most = {}
    for (_, b_id), n in counts.items():
        most[b_id] = max(most.get(b_id, 0), n)
    return [
        (na, nb, len(groups), len(links), sum(counts[k] == most[k[1]] for k in links), sum(counts[k] for k in links),
         hashlib.sha256(";".join("|".join(g) for g in groups).encode()).hexdigest() if na else "")
        for na, nb, groups, links in out
    ]


def query(docs):
    """What the registered query does, on a table of the test's."""
    from pyspark.sql import functions as F

    rows = diagonal_align.aligned(docs)
    digest = F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise("")
    return diagonal_align.scored(rows.select("doc_id", "n_a", "n_b", "n_groups", digest.alias("groups_sha256"), "pairs"))


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("broadcast", [True, False])
def test_against_all_pairs(spark, libraries, odd_texts, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(diagonal_align, "COUNTS_BYTES", 0)
    texts = [*ODD, *(t for t in odd_texts if t is None or len(t) < 3000)]
    rows = [(k, t, "x", k) for k, t in enumerate(texts)] + [(None, texts[3], "y", 0), (1, texts[3], "y", 0), (1, texts[3], "y", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, groups string, a long").repartition(3)
    want = plainly(libraries, [r[1] for r in rows])
    got = [(str(r.doc_id), *(r[f] for f in FIELDS)) for r in query(docs).collect()]
    assert sorted(got) == sorted((str(r[0]), *w) for r, w in zip(rows, want, strict=True))


def test_stretches_and_groups():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 60)
        ea, eb = (sorted(set(rng.sample(range(1, n + 1), rng.randint(0, n)) + [n])) for _ in range(2))
        runs, odd = diagonal_align.runs_and_links(ea, eb)
        links = [(i + k, j + k) for i, j, size in runs.tolist() for k in range(size)] + [tuple(x) for x in odd.tolist()]
        start = lambda e, k: e[k - 1] if k else 0
        want = [(i, j) for i in range(len(ea)) for j in range(len(eb)) if start(ea, i) < eb[j] and start(eb, j) < ea[i]]
        assert sorted(links) == want
        for i, j, size in runs.tolist():
            assert ea[i : i + size] == eb[j : j + size]
            assert (i + size == len(ea)) or ea[i + size] != eb[j + size]


def test_byte_side_splits_as_the_library(libraries):
    side = diagonal_align.ByteSide(diagonal_align.Sides.read().byte_json)
    assert side.fast is not None
    points = [c for c in range(0, 0x110000, 37) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}b1{chr(c)}? {chr(c)}{chr(c)} 5" for c in points]
    for text, want in zip(texts, libraries[0].encode_batch([" " + t for t in texts], add_special_tokens=False), strict=True):
        assert side(text) == want.ids, ascii(text)


def test_slices_do_not_matter(spark, monkeypatch, odd_texts):
    sides = diagonal_align.Sides.read()
    pair = (diagonal_align.ByteSide(sides.byte_json), diagonal_align.PieceSide(sides.piece_model))
    tables = [diagonal_align._table(s.bytes) for s in pair]
    texts = [t or "" for t in [*ODD, *odd_texts]]
    whole = [c.to_pylist() for c in diagonal_align._slice_columns(texts, pair, tables)]
    single = [[c.to_pylist()[0] for c in diagonal_align._slice_columns([t], pair, tables)] for t in texts]
    assert [list(x) for x in zip(*whole, strict=True)] == single


def test_no_documents(no_docs):
    assert query(no_docs).count() == 0


def test_query(spark, libraries):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op13_alignment(spark, sf).collect()}
    assert len(got) == len(docs)
    a, b = libraries
    for d in docs:
        r = got[d.doc_id]
        if r.n_a:
            assert r.n_a == len(a.encode(" " + d.text, add_special_tokens=False).ids)
            assert r.n_b == len(b.encode(d.text))
            assert r.n_links == r.n_a + r.n_b - r.n_groups
            assert 0 < r.n_best <= r.n_links <= r.count_sum


def test_short_stretches_are_not_probed(monkeypatch):
    probed = []
    stretch = diagonal_align.stretch
    monkeypatch.setattr(diagonal_align, "stretch", lambda *a: probed.append(a[2]) or stretch(*a))
    for length in range(1, 80):
        # a stretch, a group of one token against two, a stretch
        ea = [*range(1, length + 1), length + 2, *range(length + 3, 2 * length + 3)]
        eb = [*range(1, 2 * length + 3)]
        runs, odd = diagonal_align.runs_and_links(ea, eb)
        found = {(i + k, j + k) for i, j, n in runs.tolist() for k in range(n)} | set(map(tuple, odd.tolist()))
        assert found == {(i, j) for i, a in enumerate(ea) for j, b in enumerate(eb) if a == b or (a, b) == (length + 2, length + 1)}
        assert len(odd) == 2
        assert bool(probed) == (length > diagonal_align.NEAR), length
        probed.clear()


def test_bytes_of_a_slice_are_joined_at_once():
    table = diagonal_align._table({0: b"", 1: b" the", 3: "ü".encode()})
    ids = np.array([1, 3, 0, 1])
    data, ends = diagonal_align._joined(ids, table)
    assert data.tobytes() == " theü the".encode() and ends.tolist() == [4, 6, 6, 10]
