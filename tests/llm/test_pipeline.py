import duckdb
import pytest

import corpus_pipeline
from pageloom.llm import containment, mixing, rule_ledger, simhash

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "sharding":
            assert out.columns == names and out.dtypes == docs.dtypes
            docs = corpus_pipeline.stored(out)
    assert {"slot", "shard"} <= set(out.columns)


def test_against_brute_force(spark):
    """What is in the result, by plain loops over a small table."""
    rows = duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()
    kept = {r.doc_id for r in rule_ledger.ledger(spark.read.parquet(f"{SF}/documents.parquet")).where("fail_bits = 0").collect()}
    docs = [(i, t, s) for i, t, s in rows if i in kept]
    sets = {i: containment.shingles(t.encode()) for i, t, _ in docs}
    least = {i: i for i in sets}
    for _ in range(5):
        for a in sets:
            for b in sets:
                if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    tests = [containment.shingles(t.encode()) for (t,) in items]
    clean = {i for i in sets if least[i] == i and not any(s and len(s & sets[i]) >= 0.8 * len(s) for s in tests)}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == clean
    whole, drawn = {}, {}
    for i, t, s in docs:
        if i in clean:
            whole[s] = whole.get(s, 0) + len(t.split())
    for r in got:
        drawn[r.source] = drawn.get(r.source, 0) + len(r.text.split())
    assert all(whole[s] <= drawn[s] <= 2 * whole[s] for s in whole)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, odd_docs, no_docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    stage(spark, odd_docs, SF).collect()
    assert stage(spark, no_docs, SF).count() == 0
    assert mixing.BLOCKS and simhash.SEGMENTS
