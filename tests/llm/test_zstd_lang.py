import random

from pyspark.sql import functions as F

from pageloom.llm import zstd_lang

ENGLISH = "the house and the people of this old town were always there when it was raining and nobody thought about leaving".split()
GERMAN = "das haus und die leute dieser alten stadt waren immer dort wenn es regnete und niemand dachte an das weggehen".split()


def text(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_accuracy_and_odd_rows(spark, no_docs):
    rng = random.Random(1)
    rows = [(k, text(rng, (ENGLISH, GERMAN)[k % 2], rng.randint(8, 60)), ("en", "de")[k % 2]) for k in range(300)]
    train = spark.createDataFrame(rows[:200], "doc_id long, text string, lang string")
    samples = zstd_lang.dictionaries(train)
    assert list(samples) == ["de", "en"]
    odd = [(None, "12 34 !?", "en"), (1000, None, "de"), (1001, "", None), (1002, "é", None), (1002, "é", None), (1003, rows[0][1] * 3000, None)]
    docs = spark.createDataFrame([(*r, 9) for r in rows[200:] + odd], "doc_id long, text string, lang string, score long")
    got = zstd_lang.identified(docs, samples).collect()
    assert len(got) == len(rows[200:] + odd)
    by = {r.doc_id: r for r in got}
    assert sum(by[i].lang_pred == lang for i, _, lang in rows[200:]) >= 98
    assert by[None].lang_pred == by[1000].lang_pred == by[1001].lang_pred == "und"
    assert by[1002].lang_pred in samples and by[1003].lang_pred == "en" and not by[1003].rejected
    assert all(0 <= r.score <= 1 for r in got)
    assert zstd_lang.identified(no_docs, samples).count() == 0
    assert zstd_lang.dictionaries(no_docs) == {}
    assert {r.lang_pred for r in zstd_lang.identified(docs, {}).collect()} == {"und"}


def test_dictionary_is_bounded(spark):
    rows = spark.range(500).select(F.expr("concat('text number ', translate(CAST(id AS STRING), '0123456789', 'abcdefghij'))").alias("text"), F.lit("en").alias("lang"))
    assert len(zstd_lang.dictionaries(rows, 1000)["en"]) == 1000
    few = zstd_lang.dictionaries(rows, 1 << 20, sample_texts=20)["en"]
    assert 5 <= few.count(b"text number") <= 50


def test_a_language_of_many_copies_is_learned(spark):
    """380,000 rows of 19 texts beside 20,000 texts: both languages get a dictionary."""
    rng = random.Random(3)
    german = [text(rng, GERMAN, 12) for _ in range(19)]
    few = spark.createDataFrame(list(enumerate(german)), "k long, text string")
    many = spark.range(380_000).selectExpr("id % 19 AS k").join(F.broadcast(few), "k").select("text", F.lit("de").alias("lang"))
    words = F.array(*map(F.lit, ENGLISH))
    other = spark.range(20_000).select(
        F.array_join(F.expr("transform(sequence(1, 12), i -> xxhash64(id, i))").alias("h").cast("array<string>"), " ").alias("h"), words.alias("w")
    ).selectExpr("array_join(transform(split(h, ' '), x -> w[CAST(pmod(CAST(x AS BIGINT), size(w)) AS INT)]), ' ') AS text", "'en' AS lang")
    samples = zstd_lang.dictionaries(many.unionByName(other))
    assert list(samples) == ["de", "en"]
    assert sorted(samples["de"].decode().split()) == sorted(" ".join(german).split())


def test_against_zstandard_directly():
    """Label, score and rejection from sizes that are got one piece at a time."""
    import zstandard

    rng = random.Random(9)
    samples = {lang: text(rng, words, 400).encode() for lang, words in (("de", GERMAN), ("en", ENGLISH))}
    predict = zstd_lang.Classifier(samples).predict

    def size(sample, data):
        content = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(
            zstd_lang.LEVEL, dict_size=len(sample), source_size=zstd_lang.PIECE_BYTES, min_match=zstd_lang.MIN_MATCH,
            write_content_size=False, write_dict_id=False,
        )
        coder = zstandard.ZstdCompressor(dict_data=content, compression_params=how)
        n = zstd_lang.PIECE_BYTES
        return sum(len(coder.compress(data[k : k + n])) for k in range(0, len(data), n))

    for _ in range(60):
        mixed = text(rng, rng.choice([ENGLISH, GERMAN, ENGLISH + GERMAN]), rng.randint(1, 400))
        sizes = {lang: size(sample, zstd_lang.letters(mixed)) for lang, sample in samples.items()}
        small, large = sorted(sizes.values())
        lang, score, rejected = predict(mixed, 0.01)
        assert sizes[lang] == small and rejected == (large - small < 0.01 * small)
        assert abs(score - 1 / (1 + 2 ** (-100 * (large - small) / small))) < 1e-9
