import random
import re

from pyspark.sql import functions as F

from pageloom.functions import text as X
from pageloom.operators import emails, phones


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "s string").select(column.alias("o")).first().o


def without_tags(s):
    """What stands between '>' and the next '<'."""
    return " ".join(part.split("<", 1)[0] for part in s.split(">"))


def random_texts(alphabet, n=400, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_strip_tags(spark):
    texts = random_texts("<> ab\n\"'é") + ["a > b", 'x <i title="q>r">t</i>', "1 < 2", ""]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for r in df.select("s", X.strip_tags("s").alias("o")).collect():
        assert r.o == without_tags(r.s)


def test_email_pattern_finds_what_the_plain_one_finds(spark):
    plain = re.compile(r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}")
    texts = random_texts("ab.@@_-+ é9", 800) + ["a@b.co_x@d.com", "x" * 3000 + " a@b.co", "a@b.coXY@d.com"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for r in df.select("s", F.expr(emails.addresses_sql("s")).alias("o")).collect():
        assert r.o == plain.findall(r.s)


def test_phone_patterns(spark):
    plain = re.compile(r"\+?1?[\s.-]?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}", re.A)
    texts = random_texts("0123456789() .-+a", 800)
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for r in df.select("s", X.find_all("s", phones.PATTERNS[0]).alias("o")).collect():
        assert r.o == plain.findall(r.s)


def test_trim_space(spark):
    assert one(spark, " \x85　 a b\xa0\n", X.trim_space("s")) == "a b"
    assert one(spark, " ", X.trim_space("s")) == ""
    assert one(spark, "x", X.trim_space("s")) == "x"


def test_truncate_text(spark):
    assert one(spark, "a" * 201, X.truncate_text("s", 200)) == "a" * 200 + "..."
    assert one(spark, "a" * 200, X.truncate_text("s", 200)) == "a" * 200
    # never half a character
    assert one(spark, "aé" * 3, X.truncate_text("s", 5)) == "aéa..."
    assert one(spark, "😀😀", X.truncate_text("s", 7)) == "😀..."


def test_decode_entities(spark):
    coded = "a &amp; &lt;&copy;&#233;&#x1F600;&#128;&#0;&unknown; &ampx &hearts; &NewLine;&notit; &"
    assert one(spark, coded, X.decode_entities("s")) == (
        "a & <©é😀€�&unknown; &x ♥ \n¬it; &"
    ).replace("¬it;", "&notit;")
    assert one(spark, "?a=1&copy=2&amp;b&lt", X.decode_entities("s", True)) == "?a=1&copy=2&b<"


def test_format_duration(spark):
    cases = {
        0: "0ms", 999_999_999: "999ms", 1_000_000_000: "1.0s", 1_150_000_000: "1.1s",
        1_250_000_000: "1.2s", 59_960_000_000: "60.0s", 60_000_000_000: "1m0s", 3_661_000_000_000: "61m1s",
    }
    df = spark.createDataFrame([(k,) for k in cases], "ns long")
    got = {r.ns: r.d for r in df.select("ns", X.format_duration("ns").alias("d")).collect()}
    assert got == cases


def test_normalize_phone(spark):
    assert one(spark, "+1 (555) 010-0000x", X.normalize_phone("s")) == "+15550100000"
