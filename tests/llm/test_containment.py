import math
import random

from pageloom.llm import containment


def test_against_brute_force(spark, odd_docs, no_docs):
    rng = random.Random(9)
    rows = odd_docs.collect()
    long = max((r.text for r in rows if r.text), key=len).split()
    items = [(k, " ".join(long[s : s + n])) for k, (s, n) in enumerate([(50, 8), (900, 40), (5000, 6), (7000, 5), (100, 300)])]
    broken = long[2000:2060]
    for p in (20, 21, 40):
        broken[p] = "wrong"
    items += [(10, " ".join(broken)), (11, None), (12, ""), (13, "ONE"), (14, "not there at all in any text"), (None, items[0][1]), (0, items[0][1])]
    table = spark.createDataFrame([(*i, 7) for i in items], "item_id long, text string, doc_id long")
    want = []
    for r in rows:
        own = containment.shingles((r.text or "").encode())
        for i, t in items:
            s = containment.shingles((t or "").encode())
            if s and len(s & own) >= math.ceil(0.8 * len(s) - 1e-9):
                want.append((r.doc_id, i, len(s & own), len(s)))
    for block_bytes in (1 << 20, 200):
        got = containment.contained(odd_docs, table, block_bytes=block_bytes).collect()
        assert sorted((tuple(r)[:4] for r in got), key=str) == sorted(want, key=str)
        clean = containment.without_items(odd_docs, table, block_bytes=block_bytes)
        assert clean.columns == odd_docs.columns
        hit = {d for d, *_ in want}
        assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in rows} - hit | ({8} if 8 in hit else set())
    assert any(n < s for *_, n, s in want)
    assert containment.contained(no_docs, table).count() == 0
    assert containment.without_items(odd_docs, table.limit(0)).count() == len(rows)
