"""Which documents need text recognition, and the recognition step itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataleaf.functions.text import strip

#: Fixed value: below this share of pages with text a document is recognised.
MIN_COVERAGE = 0.25
DPI = 300


def page_has_text(blocks: Column) -> Column:
    """Whether a page (array of blocks) holds a text block with a span that is not blank."""

    def block(b):
        return (b["type"] == 0) & F.exists(b["lines"], lambda x: F.exists(x["spans"], lambda s: strip(F.coalesce(s["text"], F.lit(""))) != ""))

    return F.coalesce(F.exists(blocks, lambda b: F.coalesce(block(b), F.lit(False))), F.lit(False))


def needs_ocr(docs: DataFrame, pages: DataFrame, min_coverage: float = MIN_COVERAGE, sample_pages: int | None = None) -> DataFrame:
    """doc_id, pages, with_text, needs_ocr for every document; pages has doc_id, page_number, has_text.

    No pages or no page with text needs recognition, else a share below min_coverage does.
    """
    if sample_pages is not None:
        pages = pages.where(F.col("page_number") <= sample_pages)
    counted = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(F.col("has_text")).alias("with_text"))
    known = docs.select("doc_id").distinct().join(counted, "doc_id", "left").fillna(0, ["pages", "with_text"])
    share = F.col("with_text") / F.nullif(F.col("pages"), F.lit(0))
    return known.withColumn("needs_ocr", (F.col("pages") == 0) | (F.col("with_text") == 0) | F.coalesce(share < min_coverage, F.lit(True)))


class Detection(Protocol):
    """Decides which documents need recognition; needs_ocr() is the one used by default."""

    def __call__(self, docs: DataFrame, pages: DataFrame) -> DataFrame:
        """A row with doc_id and needs_ocr for each document."""
        ...


class OcrProvider(Protocol):
    """Recognises one rendered page; language and resolution are its own settings."""

    def __call__(self, content: bytes | None) -> str: ...


def recognise(pages: DataFrame, provider: Callable[[bytes | None], str]) -> DataFrame:
    """doc_id, page_number, text for pages (doc_id, page_number, image); order is in the page number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"doc_id": part["doc_id"], "page_number": part["page_number"], "text": [provider(x) for x in part["image"]]})

    return pages.select("doc_id", "page_number", "image").mapInPandas(run, "doc_id long, page_number int, text string")


def extract_text(
    docs: DataFrame,
    pages: DataFrame,
    images: DataFrame,
    provider: Callable[[bytes | None], str],
    force: bool = False,
    min_coverage: float = MIN_COVERAGE,
    detect: Detection | None = None,
) -> DataFrame:
    """Recognised pages of the documents that need it (all with force); other documents have no row."""
    found = detect(docs, pages) if detect else needs_ocr(docs, pages, min_coverage)
    wanted = docs.select("doc_id") if force else found.where("needs_ocr").select("doc_id")
    return recognise(images.join(wanted, "doc_id", "left_semi"), provider)
