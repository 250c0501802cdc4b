"""One query per operator, over the whole of its table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import (
    boosted_html, bwt_repeats, containment, diagonal_align, fim_scatter, maglev, mixing, rule_ledger, simhash,
    transducer_bpe, url_blocks, wordpiece, zstd_lang,
)
from pageloom.llm.tables import table


def op1_url_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_blocks.judged(pages).select("page_id", "host", "path", "rule", "verdict")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return maglev.placed(docs, "doc_id")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_repeats.without_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.drawn(table(spark, sf_dir, "documents"), mixing.Target(entropy=0.99, repeats=4.0))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return boosted_html.extracted(pages, boosted_html.trained(pages))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    samples = zstd_lang.dictionaries(docs.where(~held_out))
    return zstd_lang.identified(docs, samples).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected"
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = rule_ledger.ledger(table(spark, sf_dir, "documents"))
    failed = ~rule_ledger.passes("base")
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & rule_ledger.passes("v1")).alias("kept"),
        "n_lines", "n_upper", "n_latin", F.col("fail_bits").cast("int").alias("fail_bits"),
    )


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transducer_bpe.decoded(transducer_bpe.encoded(table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim_scatter.restored(fim_scatter.transformed(table(spark, sf_dir, "documents")))
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diagonal_align.aligned(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise("")
    rows = rows.select("doc_id", "n_a", "n_b", "n_groups", digest.alias("groups_sha256"), "pairs")
    return diagonal_align.scored(rows)


QUERIES = {
    "op1_url_blocks": op1_url_blocks,
    "op2_sharding": op2_sharding,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_simhash": op5_simhash,
    "op6_decontamination": op6_decontamination,
    "op7_mixing": op7_mixing,
    "op8_html_extraction": op8_html_extraction,
    "op9_language": op9_language,
    "op10_quality_rules": op10_quality_rules,
    "op11_bpe": op11_bpe,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_alignment": op13_alignment,
}
