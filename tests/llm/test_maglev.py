import hashlib
from collections import Counter

import pytest

from pageloom.llm import maglev


def number(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def filled(shards, size):
    owner, order = [None] * size, [0] * len(shards)
    for n in range(size):
        s = n % len(shards)
        offset, skip = number(shards[s] + ":offset") % size, number(shards[s] + ":skip") % (size - 1) + 1
        while owner[(offset + order[s] * skip) % size] is not None:
            order[s] += 1
        owner[(offset + order[s] * skip) % size] = shards[s]
    return owner


@pytest.mark.parametrize("n,size", [(1, 2), (3, 7), (5, 101)])
def test_table(spark, n, size):
    shards = tuple(f"s{k}" for k in range(n))
    got = {r.slot: r.shard for r in maglev.lookup(spark, shards, size).collect()}
    assert [got[k] for k in range(size)] == filled(shards, size)
    counts = Counter(got.values())
    assert max(counts.values()) - min(counts.values()) <= 1


def test_few_rows_move(spark):
    a = {r.slot: r.shard for r in maglev.lookup(spark, ("a", "b", "c", "d"), 401).collect()}
    b = {r.slot: r.shard for r in maglev.lookup(spark, ("a", "b", "c"), 401).collect()}
    assert sum(a[k] != b[k] for k in a if a[k] != "d") < 401 * 0.15


def test_placed(spark, odd_docs, no_docs):
    out = maglev.placed(odd_docs.withColumnRenamed("n_words", "shard"), "doc_id").collect()
    assert len(out) == odd_docs.count()
    owner = filled(maglev.SHARDS, maglev.TABLE_SIZE)
    for r in out:
        assert r.slot == number("" if r.doc_id is None else str(r.doc_id)) % maglev.TABLE_SIZE
        assert r.shard == owner[r.slot]
    assert maglev.placed(no_docs, "doc_id").count() == 0


def test_bad_tables(spark):
    for shards, size in ((("a", "a"), 7), ((), 7), (("a", "b"), 9), (("a", "b"), 2)):
        with pytest.raises(ValueError):
            maglev.lookup(spark, shards, size)
