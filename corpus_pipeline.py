"""Corpus pipeline over ``documents``: language ID, near duplicates, substrings, mixing, packing.

Each stage takes all that its predecessor kept and returns a DataFrame that is written as Parquet and
reread. Columns of ``documents`` that are missing from the input come back as nulls; other columns
are dropped at the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hammerline.llm import language, mixing, neardup, packing, substrings
from hammerline.llm.common import written
from hammerline.session import table

COLUMNS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


def columns_of_documents(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(c).cast(t) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in COLUMNS.items()])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letters, or nothing learnt) go; ``lang`` becomes the prediction."""
    docs = columns_of_documents(docs)
    found = language.predict(docs, language.train(docs.where(~language.held_out())))
    return found.where(F.col("lang_pred") != language.UNKNOWN).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each near-duplicate group stays (five-word shingles, 0.8)."""
    gone = neardup.near_duplicates(docs, width=5, percent=80).where("not kept").select("doc_id").distinct()
    return columns_of_documents(docs.join(gone, "doc_id", "left_anti"))


def cut_repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that an earlier document holds are cut; a document left without words goes."""
    cut = substrings.remove_repeats(columns_of_documents(docs), width=50)
    changed = F.col("_n_removed") > 0
    text = F.when(changed, F.col("_kept_text")).otherwise(F.col("text"))
    kept = cut.where(F.coalesce(F.col("_n_removed") < F.col("_n_words"), F.lit(True)) | ~changed)
    return columns_of_documents(kept.withColumn("text", text).withColumn("n_chars", F.when(changed, F.char_length("_kept_text").cast("bigint")).otherwise(F.col("n_chars"))))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; smaller sources are repeated up to 1.5 times."""
    return mixing.mix(columns_of_documents(docs), max_repeats=1.5).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents placed in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeated_substrings),
    ("mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The first stages learn profiles and cluster by iteration, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{at}")
    return docs
