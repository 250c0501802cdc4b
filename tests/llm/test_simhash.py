import random

import numpy as np
import xxhash

from pageloom.llm import simhash


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, n):
    w = words(text)
    return [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


def fingerprint(text, n):
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles(text, n)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(nodes, linked):
    """node -> smallest node it reaches."""
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if linked(a, b) and least[a] != least[b]:
                    least[a] = least[b] = min(least[a], least[b])
                    changed = True
    return least


def test_documents(odd_docs, no_docs):
    rows = odd_docs.collect()
    got = simhash.near_duplicates(odd_docs, 3).collect()
    assert len(got) == len(rows)
    ids = {}
    for r in rows:
        ids.setdefault(fingerprint(r.text, 3), []).append(r.doc_id)
    least = classes(sorted(ids), lambda a, b: (a ^ b).bit_count() <= 2)
    first = {}
    for fp, ds in ids.items():
        known = [d for d in ds if d is not None]
        first[least[fp]] = min([*known, first.get(least[fp], 10**9)])
    want = sorted(((d, first[least[fp]]) for fp, ds in ids.items() for d in ds), key=str)
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == want
    assert {r.fp % 2**64 for r in got} == set(ids)
    assert simhash.near_duplicates(no_docs, 3).count() == 0


def test_links_in_crowds(spark):
    """A tight crowd around one fingerprint, chains at distance two, and strangers, by both paths."""
    rng = np.random.default_rng(1)
    base = int(rng.integers(2**63))
    crowd = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (60, 2))}
    chain = [int(rng.integers(2**63))]
    for k in range(10):
        chain.append(chain[-1] ^ (3 << (2 * k + 1)))
    fps = sorted({x - 2**64 if x >= 2**63 else x for x in [*crowd, *chain, *map(int, rng.integers(0, 2**63, 50))]})
    want = classes(fps, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    for dense in (2, 8, 1000):
        links = [(r.a, r.b) for r in simhash.links(table, dense=dense).collect()]
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in links)
        have = {*links, *((b, a) for a, b in links)}
        assert classes(fps, lambda a, b: (a, b) in have) == want


def test_similar(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    sets = {t: set(shingles(t, 5)) for t in {r.text for r in rows}}

    def linked(a, b):
        a, b = sets[a], sets[b]
        return bool(a and b) and len(a & b) >= 0.8 * len(a | b)

    texts = list(sets)
    least = {t: k for k, t in enumerate(texts)}
    for _ in texts:
        for a in texts:
            for b in texts:
                if linked(a, b):
                    least[a] = least[b] = min(least[a], least[b])
    first = {}
    for r in rows:
        if r.doc_id is not None:
            first[least[r.text]] = min(r.doc_id, first.get(least[r.text], 10**9))
    got = simhash.similar(odd_docs).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(((r.doc_id, first[least[r.text]]) for r in rows), key=str)
    kept = simhash.without_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    want = [r for r in rows if r.doc_id is None or first[least[r.text]] == r.doc_id]
    assert sorted(map(str, kept.collect())) == sorted(map(str, want))
    assert simhash.without_copies(no_docs).count() == 0


def test_large_buckets(spark):
    """Many near copies of one text share their buckets; one of them stays."""
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(base[:k] + ["new"] + base[k + 1 :])) for k in range(0, 120, 2)] + [(999, "quite another text of some words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.without_copies(docs).collect()) == [0, 999]


def test_a_star_of_edits(spark):
    """An original and 1000 edits that are similar to it, but not to each other."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(150)]
    rows = [(5000, " ".join(base))]
    for k in range(1000):
        at = {5 + rng.randrange(40), 55 + rng.randrange(40), 105 + rng.randrange(40)}
        rows.append((k, " ".join(f"e{k}x{j}" if j in at else w for j, w in enumerate(base))))
    sets = [set(shingles(t, 5)) for _, t in rows]
    alike = lambda a, b: len(a & b) / len(a | b)
    assert all(alike(sets[0], s) >= 0.8 for s in sets[1:])
    assert sum(alike(sets[1], s) < 0.8 for s in sets[2:]) > 900
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in simhash.similar(docs).collect()} == {0}


def test_unlike_texts_in_a_crowd(spark, monkeypatch):
    """Texts of one bucket that fall into many classes, in long and in short lists."""
    rng = random.Random(7)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for group in range(12):
        own = base[:80] + [f"g{group}x{j}" for j in range(rng.choice([5, 20, 30]))]
        for _ in range(6):
            at = {rng.randrange(len(own)) for _ in range(rng.randint(1, 4))}
            rows.append((len(rows), " ".join(f"e{len(rows)}" if j in at else w for j, w in enumerate(own))))
    sets = [set(shingles(t, 5)) for _, t in rows]
    want = classes(range(len(rows)), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert len(set(want.values())) > 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(simhash, "bands", lambda hashes: [0] * simhash.BANDS if len(hashes) else None)
    for crowd in (16, 2):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        assert {r.doc_id: r.component_id for r in simhash.similar(docs).collect()} == want


def test_a_repeated_phrase(spark):
    """A run of one word changes the fingerprint by many bits, the set of shingles hardly."""
    rng = random.Random(8)
    rows = []
    for k in range(20):
        text = " ".join(f"v{rng.randrange(10**6)}" for _ in range(400))
        rows += [(2 * k, text), (2 * k + 1, text + " la" * 60)]
    far = [(fingerprint(rows[k][1], 5) ^ fingerprint(rows[k + 1][1], 5)).bit_count() > 24 for k in range(0, 40, 2)]
    assert sum(far) > 10
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k - k % 2 for k in range(40)}


def test_fingerprints_link_similar_texts_without_bands(spark, monkeypatch):
    """The method's own links are candidates: texts that share no band are found by them."""
    base = [f"w{k}" for k in range(400)]
    edits = [base, [*base, "more"], [*base[:200], "other", *base[201:]]]
    rows = [(k, " ".join(t)) for k, t in enumerate(edits)] + [(9, "quite another text of some words"), (10, ""), (11, None)]
    fps = [fingerprint(t, 5) for _, t in rows[:3]]
    linked = [k for k in (1, 2) if (fps[0] ^ fps[k]).bit_count() <= simhash.MAX_BITS]
    assert linked
    monkeypatch.setattr(simhash, "bands", lambda hashes: [int(h) >> 1 for h in hashes[:1] ^ np.uint64(len(hashes))] if len(hashes) else None)
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == 0 for k in linked) and [got[k] for k in (9, 10, 11)] == [9, 10, 11]


def brute(rows):
    """doc_id -> smallest doc_id it reaches over texts of a similarity of 0.8 and more."""
    sets = {k: set(shingles(t, 5)) for k, t in rows}
    return classes(sorted(sets), lambda a, b: a == b or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0)


def edited(rng, text, n):
    at = {rng.randrange(len(text)) for _ in range(n)}
    return [f"e{rng.randrange(10**9)}" if j in at else w for j, w in enumerate(text)]


def test_similar_texts_without_a_shared_band(spark):
    """About one pair in 600 at 0.8 shares no band, nor do its fingerprints lie near each other."""
    rng = random.Random(9)
    rows = []
    while len(rows) < 6:
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        pair = [" ".join(base), " ".join(edited(rng, base, 1) + ["more"])]
        a, b = (simhash.shingle_hashes(t.encode(), 5) for t in pair)
        apart = not any(x == y for x, y in zip(simhash.bands(a), simhash.bands(b), strict=True))
        if apart and len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) and (simhash.simhash(a) ^ simhash.simhash(b)).bit_count() > 2:
            rows += [(len(rows) + k, t) for k, t in enumerate(pair)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar(docs).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}
    assert sorted(r.doc_id for r in simhash.without_copies(docs).collect()) == [0, 2, 4]


def test_lists_alone_find_all_similar_texts(spark, monkeypatch):
    """No text shares a band: short and long lists, texts of every length, lines that many have."""
    rng = random.Random(10)
    line = [f"l{j}" for j in range(14)]
    rows = []
    for _ in range(30):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([1, 3, 6, 9, 15, 40, 90, 200]))]
        base = base + line if rng.random() < 0.7 else base
        for _ in range(rng.randint(1, 5)):
            text = edited(rng, base, rng.randint(0, max(1, len(base) // 45)))
            rows.append((len(rows), " ".join(text + [f"x{j}" for j in range(rng.choice([0, 0, 1, len(base) // 20]))])))
    want = brute(rows)
    assert 20 < len(set(want.values())) < len(rows) - 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(simhash, "bands", lambda hashes: [int(hashes.sum()) >> 1] if len(hashes) else None)
    for listed in (32, 3):
        monkeypatch.setattr(simhash, "LISTED", listed)
        assert {r.doc_id: r.component_id for r in simhash.similar(docs).collect()} == want
