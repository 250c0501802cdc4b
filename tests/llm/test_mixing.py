import math
from collections import Counter

import pytest

from pageloom.llm import mixing


def tokens(rows):
    out = Counter()
    for r in rows:
        out[r.source] += len((r.text or "").split())
    return out


def test_repeats_bound(odd_docs, no_docs):
    rows = mixing.drawn(odd_docs, mixing.Target(entropy=1.0, repeats=2.0)).collect()
    assert len(rows) == odd_docs.count()
    whole = tokens(odd_docs.collect())
    drawn = Counter()
    for r in rows:
        assert 0 <= r.block < mixing.BLOCKS
        drawn[r.source] += r.n_tokens * r.copies
    for s, n in whole.items():
        assert n <= drawn[s] <= 2 * n, s  # no document less than once, none of a source over twice
    assert mixing.drawn(no_docs).count() == 0
    assert mixing.mixed(no_docs).count() == 0


@pytest.mark.parametrize("entropy", [0.6, 0.9, 1.0])
def test_entropy_is_met(spark, entropy):
    docs = spark.createDataFrame(
        [(k, "w " * 10, s) for s, n in (("a", 600), ("b", 80), ("c", 30), (None, 10)) for k in range(n)], "doc_id long, text string, source string"
    )
    totals = mixing.plan(docs, mixing.Target(entropy=entropy, repeats=None, budget=40_000)).groupBy("key").agg(
        mixing.F.sum(mixing.F.expr("tokens * copies")).alias("n")
    )
    p = [r.n / 40_000 for r in totals.collect()]
    assert 0.97 < sum(p) <= 1.0
    h = -sum(x * math.log(x) for x in p) / math.log(4)
    found = max(entropy, -sum(x / 720 * math.log(x / 720) for x in (600, 80, 30, 10)) / math.log(4))
    assert abs(h - found) < 0.02


def test_mixed_rows_and_schedule(spark, odd_docs):
    target = mixing.Target(entropy=0.9, repeats=3.0)
    copies = Counter()
    for r in mixing.drawn(odd_docs, target).collect():
        copies[r.doc_id, r.n_tokens] += r.copies
    out = mixing.mixed(odd_docs, target)
    assert out.columns == odd_docs.columns
    got = Counter((r.doc_id, len((r.text or "").split())) for r in out.collect())
    assert got == +copies
    plan = mixing.plan(odd_docs, target)
    steps = mixing.schedule(plan).collect()
    assert Counter((r.key, r.block) for r in steps) == +Counter({(r.key, r.block): r.copies for r in plan.collect()})
    passes = {}
    for r in steps:
        passes.setdefault((r.key, r["pass"]), []).append((r.position, r.block))
    for v in passes.values():
        assert sorted(p for p, _ in v) == list(range(1, len(v) + 1)) and len({b for _, b in v}) == len(v)


def test_no_tokens(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [r.copies for r in mixing.drawn(docs).collect()] == [0, 0]
    assert mixing.mixed(docs).count() == 0
