import hashlib
import random
import sys

import numpy as np
import pytest
import tokenizers

from pageloom.llm import queries, transducer_bpe

ODD = [
    None, "", " \n\t ", "Hello, WORLD's 'LL don't!", "x<|endoftext|>y <|startoftext|><|endoftext|>", "<|endoftext|", "ΑΣ ΣΣ Σ",
    "é Å ﬁ ﷺ İ", "a\u0085b c\x1cd\x1fe f", "漢字かな 한글 हिन्दी ไทย", "😀😃👩‍👩‍👧", "=" * 5000 + " " + "ab" * 4000, "1234 56٣",
    "a̸≯ <|endoftext|≯", "՘࢏\U0001e6c0 q", "Ā</w> <w>",
]


@pytest.fixture(scope="module")
def model():
    return transducer_bpe.Model.read()


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(transducer_bpe.MODEL)
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(model, text):
    merge = transducer_bpe.Merger(model)
    return [i for w in transducer_bpe.Splitter(model)(text) for i in merge(w)]


def test_splits_and_merges_as_the_library(model, library, odd_texts):
    for text in [*ODD, *odd_texts]:
        assert ids_of(model, text or "") == library.encode(text or "", add_special_tokens=False).ids, text
    rng = random.Random(11)
    for _ in range(400):
        word = "".join(rng.choices("aeinorstlhm'-éß1.", k=rng.randint(1, 40)))
        assert ids_of(model, word) == library.encode(word, add_special_tokens=False).ids, word


def test_code_points(model, library):
    """Every 37th code point, in and at the end of words, next to digits and signs."""
    points = [c for c in range(0, sys.maxunicode + 1, 37) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}b1{chr(c)}?{chr(c)}" for c in points]
    split, merge = transducer_bpe.Splitter(model), transducer_bpe.Merger(model)
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert [i for w in split(text) for i in merge(w)] == want.ids, ascii(text)


def test_transducer_is_a_minimal_map():
    rng = random.Random(2)
    for alphabet, longest in ((b"ab", 7), (b"abc", 5), (bytes(range(256)), 3)):
        words = sorted({bytes(rng.choices(alphabet, k=rng.randint(1, longest))) for _ in range(80)})
        entries = [(w, [rng.randrange(9) for _ in range(rng.randint(0, 3))]) for w in words]
        lexicon = transducer_bpe.Lexicon(transducer_bpe.compiled(entries))
        others = [bytes(rng.choices(alphabet, k=rng.randint(0, longest + 2))) for _ in range(200)]
        number = lexicon.numbers_of([*words, *others])
        assert number[: len(words)].tolist() == list(range(len(words)))
        assert [n >= 0 for n in number[len(words) :]] == [o in words for o in others]
        assert [lexicon.ids[lexicon.where[n] : lexicon.where[n + 1]].tolist() for n in range(len(words))] == [i for _, i in entries]
        # as many states as there are different sets of endings
        prefixes = {w[:k] for w in words for k in range(len(w) + 1)}
        endings = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes}
        assert len(lexicon.final) == len(endings)
    none = transducer_bpe.Lexicon(transducer_bpe.compiled([]))
    assert none.numbers_of([b"a", b""]).tolist() == [-1, -1]


@pytest.mark.parametrize("words", [0, 5, 50_000])
def test_documents(spark, odd_docs, library, words):
    rows = [(k, t, "clash") for k, t in enumerate(ODD)] + [(None, "no number", ""), (1, "again", ""), (1, "again", "")]
    own = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    for docs in (own, odd_docs):
        out = transducer_bpe.decoded(transducer_bpe.encoded(docs, words=words)).collect()
        want = []
        for r in docs.collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            want.append((str(r.doc_id), ids, library.decode(ids, skip_special_tokens=False)))
        assert sorted((str(r.doc_id), r.ids, r.decoded) for r in out) == sorted(want)


def test_no_documents(spark, no_docs):
    assert transducer_bpe.decoded(transducer_bpe.encoded(no_docs)).count() == 0
    nulls = spark.createDataFrame([(1, None, "x"), (2, [], "y")], "doc_id long, ids array<int>, decoded string")
    assert [r.decoded for r in transducer_bpe.decoded(nulls).collect()] == ["", ""]


def test_counts_cover_all_texts(spark, model, odd_docs):
    split, want = transducer_bpe.Splitter(model), {}
    for r in odd_docs.collect():
        for w in split(r.text or ""):
            want[w] = want.get(w, 0) + 1
    assert {r.word: r.n for r in transducer_bpe.word_counts(odd_docs, model).collect()} == want


def test_frequent_words_fit(spark):
    counts = spark.range(1, 300).selectExpr("concat('w', id) AS word", "1000 DIV id AS n").where("n > 1")
    by_count = [f"w{i}" for i in range(1, 300)]
    for words in (0, 1, 3, 50, 1000):
        got = transducer_bpe.frequent(counts, words)
        assert len(got) <= words and sorted(got) == sorted(by_count[: len(got)])
    assert len(transducer_bpe.frequent(counts, 50)) > 40


def test_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in queries.op11_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        assert rows[d.doc_id].n_tokens == len(ids)
        assert rows[d.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        text = library.decode(ids, skip_special_tokens=False)
        assert rows[d.doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_batches_of_bytes():
    import pyarrow as pa

    from pageloom.llm.arrow_texts import list_array, slices, text_array, text_bytes

    column = pa.array(["xx", "", "äb", "c" * 10, "d"]).slice(1)
    data, ends = text_bytes(column)
    assert bytes(data[ends[0] : ends[-1]]) == "äb".encode() + b"c" * 10 + b"d"
    assert list(slices(ends, 4)) == [(0, 2), (2, 3), (3, 4)]
    assert text_array(data[ends[0] :], ends - ends[0]).to_pylist() == column.to_pylist()
    assert list_array(np.arange(3), np.array([0, 2, 1])).to_pylist() == [[], [0, 1], [2]]
