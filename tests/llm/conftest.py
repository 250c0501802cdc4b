import random

import pytest

WORDS = "the of and to in is for on with as by at from this that was are be or an it not but you all can her has one our out day get".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, short, long, repeated and nearly repeated texts."""
    rng = random.Random(3)
    base = sentence(rng, 80)
    texts = [None, "", " \t\n ", "one", "one", "Zwölf große Bären", base, base, base + " end", "x " + base]
    texts += [sentence(rng, rng.randint(1, 120)) for _ in range(40)]
    texts += [sentence(rng, 20_000), texts[12], "a\nb\na\n\na", base.upper(), "### $$$ %%% && a b c d e f g h i j"]
    return texts


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """documents with every odd text, null ids, repeated rows and columns that clash with internal names."""
    rows = [(k, t, ["en", "de", None][k % 3], None if k % 7 == 0 else f"src{k % 3}", len(t or ""), k, "x") for k, t in enumerate(odd_texts)]
    rows += [(None, odd_texts[6], None, None, None, None, None), (None, None, None, None, None, None, None)]
    rows += [rows[8], rows[8], (8, "another text under the same number", "en", "src1", 1, 1, "y")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp long, n_words string"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
