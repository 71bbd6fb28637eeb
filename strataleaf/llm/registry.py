"""Queries of this subpackage and the SQL that some of them are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataleaf.llm import chat_format, decontaminate, html_extract, jaccard_join, language_id, license_scan, packing, pii, substring_dedup, vptree
from strataleaf.session import table


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_format.with_probe(table(spark, sf_dir, "conversations"))
    return chat_format.read_back(chat_format.format_turns(turns))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_nearest": op1_nearest,
        "op2_html_extract": op2_html_extract,
        "op3_language_id": op3_language_id,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_chat_format": op5_chat_format,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_packing": op7_packing,
        "op8_pii": op8_pii,
        "op9_decontaminate": op9_decontaminate,
        "op10_license_scan": op10_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_format": chat_format.oracle(), "op10_license_scan": license_scan.oracle()}
