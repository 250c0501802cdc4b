import random

from pageloom.llm import wordpiece


def greedy(word, initial, continuing):
    at, n, pieces = 0, 0, initial
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, n, pieces = end, n + 1, continuing
    return n


def test_against_longest_match():
    rng = random.Random(5)
    for _ in range(60):
        some = lambda k: {bytes(rng.choices(b"abc", k=rng.randint(1, 5))) for _ in range(k)}
        initial, continuing = some(12), some(12)
        count = wordpiece.Automaton(initial, continuing).count
        for _ in range(200):
            word = bytes(rng.choices(b"abcd", (5, 5, 5, 1), k=rng.randint(0, 14)))
            assert count(word) == greedy(word, initial, continuing), (word, initial, continuing)


def test_documents(odd_docs, no_docs):
    initial, continuing = map(set, wordpiece.vocabulary())
    rows = {(r.doc_id, r.n_bytes): r for r in wordpiece.token_counts(odd_docs).collect()}
    for r in odd_docs.collect():
        text = (r.text or "").encode()
        got = rows[r.doc_id, len(text)]
        if len(text) < 3000:
            assert got.n_words == len(text.split())
            assert got.n_tokens == sum(greedy(w, initial, continuing) for w in text.split())
    assert wordpiece.token_counts(odd_docs).count() == odd_docs.count()
    assert wordpiece.token_counts(no_docs).count() == 0
