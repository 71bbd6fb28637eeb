"""Training-data pipeline: documents to packed token windows, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet in the shared folder and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataleaf.llm import decontaminate, jaccard_join, language_id, packing, pii
from strataleaf.llm.frames import forget, written
from strataleaf.session import table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told (no text, or no letter in it)."""
    return language_id.accept(docs, language_id.fit(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each group of near-duplicates (five words, Jaccard 0.8)."""
    return jaccard_join.representatives(docs, width=5, percent=80)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item within its error budget."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks identifiers, disguised ones too; no document goes."""
    return pii.redact(docs)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of at most 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", one_of_each),
    ("decontaminate", no_benchmark),
    ("pii", no_personal_data),
    ("packing", windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; the last one's rows."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        forget(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)


#: Neither the classifier nor the tokenizer can be said in SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None
