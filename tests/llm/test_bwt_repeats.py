import hashlib
import random

import numpy as np
import pytest

from pageloom.llm import bwt_repeats as bw
from tests.llm.conftest import sentence


def brute(rows):
    """(n_bytes, n_removed, n_spans, kept) of each (doc_id, text)."""
    first = {}
    data = [(10**18 if d is None else d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(d, first.get(b[k : k + 50], d))
    for d, b in data:
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < d:
                gone[k + 1 : k + 51] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        kept = bytes(x for x, g in zip(b, gone[1:-1], strict=True) if not g)
        yield len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()


def compare(spark, rows, buckets):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, did long, kept string").repartition(4)
    got = bw.without_repeats(docs, buckets).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = [(d, *x) for (d, _), x in zip(rows, brute(rows), strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("seed,buckets", [(1, 3), (2, 7)])
def test_against_brute_force(spark, seed, buckets):
    rng = random.Random(seed)
    passages = [sentence(rng, 30) for _ in range(4)]
    rows = []
    for k in range(50):
        parts = [sentence(rng, rng.randint(0, 40)) for _ in range(rng.randint(1, 4))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a = rng.randint(0, 40)
            parts.insert(rng.randint(0, len(parts)), p[a : a + rng.randint(30, 140)])
        rows.append((rng.randint(0, 10**6), "".join(parts)))
    rows += [(5, None), (6, ""), (7, "ab" * 100), (8, "ab" * 60), (9, "a" * 49), (10, "a" * 49), (11, "a" * 50), (12, "a" * 51)]
    rows += [(4, "ß" * 40), (3, "ß" * 40 + "x"), (None, rows[0][1]), (None, rows[1][1]), rows[2], rows[2], (rows[3][0], rows[4][1])]
    rows += [(2_000_000, "".join(r[1] for r in rows[:20]))]
    compare(spark, rows, buckets)


def test_a_hot_passage_and_copies(spark):
    rng = random.Random(4)
    hot = sentence(rng, 25)
    rows = [(k, sentence(rng, 12) + hot + sentence(rng, 12)) for k in range(120)] + [(1000 + k, hot) for k in range(30)]
    compare(spark, rows, None)


def test_empty(spark):
    assert bw.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("depth", [1, 3, 50])
def test_merged_transforms(depth):
    rng = random.Random(depth)
    strings = [bytes(rng.choices(b"ab\x00\xff", k=rng.randint(0, 70))) for _ in range(40)] + [b"ab" * 40] * 3
    shards = [strings[:10], strings[10:11], strings[11:]]
    classes = bw.merged_classes(shards, depth)
    suffixes = [(k, p) for k, s in enumerate(strings) for p in range(len(s) + 1)]
    keys = [strings[k][p : p + depth] if len(strings[k]) - p >= depth else (k, p) for k, p in suffixes]
    number = {}
    same = [number.setdefault(k, len(number)) for k in keys]
    pairs = set(zip(classes.tolist(), same, strict=True))
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(number)


def test_anchors_across_pieces(monkeypatch):
    data = random.Random(1).randbytes(5000)
    whole = bw.anchors(data)[0].tolist()
    monkeypatch.setattr(bw, "PIECE", 130)
    assert bw.anchors(data)[0].tolist() == whole
    gaps = np.diff([0, *whole])
    assert gaps.max() <= bw.LENGTH - bw.ANCHOR + 1
