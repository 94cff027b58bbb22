"""One thin query per operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import language, licenses, lzprint, mixing, neardup, packing, quality, substrings, toxicity, warc
from .oracles import ORACLE_SQL


def op1_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = substrings.remove_repeats(docs, width=50)
    return cut.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2(F.col("_kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.CaptureIndex.build(table(spark, sf_dir, "pages"), least_bytes=0)
    return captures.records().select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    at, base = F.col("places.at"), F.array_sort(F.array_distinct(F.col("places.label")))
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), F.array_join(base, ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_ids(table(spark, sf_dir, "documents"), max_repeats=1.5)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language.train(docs.where(~language.held_out()))
    return language.predict(docs.select("doc_id", language.held_out().alias("held_out"), "text"), profiles).drop("text")


def op7_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    models = toxicity.train(docs, labels, [1 - F.col("quality"), F.col("toxic")])
    return toxicity.predict(docs, models, ["low_quality", "toxic"])


def op10_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprint.edited_likeness(table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


QUERIES = {
    f.__name__: f
    for f in (
        op1_pack_sequences,
        op2_substring_dedup,
        op3_warc_captures,
        op4_license_scan,
        op5_quality_rules,
        op6_language_id,
        op7_toxicity_chain,
        op8_source_mixing,
        op9_near_duplicates,
        op10_lz_fingerprint,
    )
}

__all__ = ["ORACLE_SQL", "QUERIES"]
