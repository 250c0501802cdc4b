"""Quality rules kept as a ledger of bits.

Every rule is evaluated once per document; the ledger keeps the measurements and
one bit per failed rule. Policies are masks over these bits, so a new policy, or
the question what a rule costs, never reads a text again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.core import each_indexed, let

SPACE = "[\\\\x20\\\\x09-\\\\x0D]"
BLANKS = "' \\t\\n\\u000b\\u000c\\r'"
WINDOW = 5

#: rule -> condition under which a document fails it. The place is the bit:
#: append only, so that stored ledgers keep their meaning.
RULES = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "capitals": "2 * n_upper > n_latin AND n_latin >= 10",
    "word_length": "2 * word_chars < 3 * n_words OR word_chars > 100 * n_words",
}

#: version -> rules that count
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(RULES),
}

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
    "n_upper", "n_latin",
)


def mask(rules: tuple[str, ...]) -> int:
    order = list(RULES)
    return sum(1 << order.index(r) for r in rules)


def _repeat_words(words: str) -> str:
    """How many words lie in a window of five that the text has twice or more.

    Windows are compared by a 64-bit hash. Texts without a repeat, the usual case,
    are told by one hash set; else windows are sorted: n log n in the words."""

    def hashes(w: str) -> str:
        five = ", ".join(f"get({w}, p + {k})" for k in range(WINDOW))
        return f"transform(sequence(0, size({w}) - {WINDOW}), p -> xxhash64({five}))"

    def repeated(h: str) -> str:
        pairs = f"sort_array({each_indexed(h, lambda x, i: f'struct({x} AS h, {i} AS i)')})"

        def starts(p: str) -> str:
            twin = (
                f"coalesce(get({p}, k - 1).h = x.h, false) OR coalesce(get({p}, k + 1).h = x.h, false)"
            )
            return f"sort_array(transform(filter({p}, (x, k) -> {twin}), x -> x.i))"

        def covered(s: str) -> str:
            steps = f"transform({s}, (x, k) -> least({WINDOW}, coalesce(get({s}, k + 1) - x, {WINDOW})))"
            return f"aggregate({steps}, 0, (a, x) -> a + x)"

        return f"IF(size(array_distinct({h})) = size({h}), 0, {let(let(pairs, starts), covered)})"

    return f"IF(size({words}) <= {WINDOW}, 0, {let(hashes(words), repeated)})"


def _without(chars: str) -> str:
    return f"length(text) - length(translate(text, {chars}, ''))"


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and the row itself as ``_doc``, one row per row of ``docs``.
    A null text has none of anything."""
    text = docs.select(
        docs["doc_id"], F.coalesce(docs["text"], F.lit("")).alias("text"),
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_doc"),
    )
    trimmed = f"trim(BOTH {BLANKS} FROM text)"
    words = f"IF({trimmed} = '', array(), split({trimmed}, '{SPACE}+'))"
    lines = f"filter(split(text, '\\n'), l -> l RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')"
    upper = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
    both = "'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz'"
    out = {
        "n_words": let(words, lambda w: f"struct(size({w}) AS n, {_repeat_words(w)} AS r)"),
        "word_chars": f"length(translate(text, {BLANKS}, ''))",
        "n_symbols": _without("'#*$%&|<>'"),
        "lines": let(lines, lambda l: f"struct(size({l}) AS n, size({l}) - size(array_distinct({l})) AS d)"),
        "n_upper": _without(upper),
        "n_latin": _without(both),
    }
    raw = text.select("doc_id", "_doc", *[F.expr(e).alias(n) for n, e in out.items()])
    cols = {n: F.col(n) for n in MEASURES if n in out} | {
        "n_words": F.col("n_words.n"),
        "n_repeat_words": F.col("n_words.r"),
        "n_lines": F.col("lines.n"),
        "n_dup_lines": F.col("lines.d"),
    }
    return raw.select("doc_id", "_doc", *[cols[n].cast("long").alias(n) for n in MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``fail_bits`` (bit k: failed the k-th rule).

    One narrow stage over the texts; nothing is shuffled, repeated rows stay
    repeated, an empty table gives an empty ledger."""
    return _judged(docs).drop("_doc")


def _judged(docs: DataFrame) -> DataFrame:
    bits = " | ".join(f"IF({cond}, {1 << k}, 0)" for k, cond in enumerate(RULES.values()))
    return measured(docs).withColumn("fail_bits", F.expr(bits))


def kept(docs: DataFrame, version: str = "v1") -> DataFrame:
    """The rows of ``docs`` that pass a policy, with their columns; no shuffle."""
    return _judged(docs).where(passes(version)).select("_doc.*")


def passes(version: str) -> Column:
    """True where no rule of the policy failed."""
    return F.col("fail_bits").bitwiseAND(mask(POLICIES[version])) == 0


def ablations(entries: DataFrame, version: str = "v1") -> DataFrame:
    """Per rule of a policy: documents failing it, documents only it rejects, and
    documents kept if it were left out. One pass over the stored bits."""
    whole = mask(POLICIES[version])
    by_bits = entries.groupBy(F.expr(f"fail_bits & {whole}").alias("bits")).agg(
        F.count("*").alias("n")
    )
    bit = {r: 1 << list(RULES).index(r) for r in POLICIES[version]}
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(b).alias("bit")) for r, b in bit.items()]))
    return (
        by_bits.select("bits", "n", rules.alias("x"))
        .groupBy(F.col("x.rule").alias("rule"))
        .agg(
            F.sum(F.expr("IF(bits & x.bit <> 0, n, 0)")).alias("failed"),
            F.sum(F.expr("IF(bits = x.bit, n, 0)")).alias("only_this"),
            F.sum(F.expr("IF(bits & ~x.bit = 0, n, 0)")).alias("kept_without"),
        )
    )
