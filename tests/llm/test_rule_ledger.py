import re

from pyspark.sql import functions as F

from pageloom.llm import rule_ledger


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines),
            len(lines) - len(set(lines)), len(inside), len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z]", text)))


def test_measurements(odd_docs):
    short = odd_docs.where("text IS NULL OR length(text) < 5000")
    got = rule_ledger.measured(short).select(F.col("_doc.text").alias("text"), *rule_ledger.MEASURES).collect()
    assert len(got) == short.count()
    for r in got:
        assert tuple(r)[1:] == plain(r.text), r.text


def test_repeats_at_either_end_and_everywhere(spark):
    texts = ["a b c d e f a b c d e", "a " * 30, "a b c d e", "a b c d", "a b c d e a b c d e", "x a b c d e y a b c d e z"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for r in rule_ledger.measured(docs).collect():
        assert r.n_repeat_words == plain(texts[r.doc_id])[5], texts[r.doc_id]


def test_policies_and_ablations(odd_docs, no_docs):
    entries = rule_ledger.ledger(odd_docs)
    rows = entries.collect()
    base = rule_ledger.mask(rule_ledger.POLICIES["base"])
    for r in rows:
        assert bool(r.fail_bits & 1) == (r.n_words < 10)
        assert bool(r.fail_bits & base) == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    assert rule_ledger.kept(odd_docs).columns == odd_docs.columns
    assert rule_ledger.kept(odd_docs).count() == sum(not r.fail_bits for r in rows)
    found = {r.rule: r for r in rule_ledger.ablations(entries).collect()}
    for k, rule in enumerate(rule_ledger.RULES):
        bit = 1 << k
        assert found[rule].failed == sum(bool(r.fail_bits & bit) for r in rows)
        assert found[rule].only_this == sum(r.fail_bits == bit for r in rows)
        assert found[rule].kept_without == sum(not r.fail_bits & ~bit for r in rows)
    assert rule_ledger.ledger(no_docs).count() == 0
