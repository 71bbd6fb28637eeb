"""Entries of a table of contents: dedup, order, merge, hierarchy, strings.

An entry table has doc_id, ordinal, title, page_number, level, confidence; the
ordinal says the order within a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataleaf.functions.text import format_confidence


def deduplicate(entries: DataFrame) -> DataFrame:
    """The first entry of each (page, title) of a document."""
    first = Window.partitionBy("doc_id", "page_number", "title").orderBy("ordinal")
    return entries.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def sort_by_page(entries: DataFrame) -> DataFrame:
    """New ordinals by page and level; ties keep their order."""
    order = Window.partitionBy("doc_id").orderBy("page_number", "level", "ordinal")
    return entries.withColumn("ordinal", F.row_number().over(order).cast("long"))


def merge(batched: DataFrame) -> DataFrame:
    """Union of the batches of a document (column batch_ix): the earliest of equal entries, by page and level."""
    first = Window.partitionBy("doc_id", "page_number", "title").orderBy("batch_ix", "ordinal")
    order = Window.partitionBy("doc_id").orderBy("page_number", "level", "batch_ix", "ordinal")
    kept = batched.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return kept.withColumn("ordinal", F.row_number().over(order).cast("long")).drop("_n", "batch_ix")


def sanitize_hierarchy(entries: DataFrame) -> DataFrame:
    """Levels that start at 1 and never rise by more than one.

    The recurrence new = min(level, previous new + 1) is a running minimum of level - position.
    """
    order = Window.partitionBy("doc_id").orderBy("ordinal")
    place = F.row_number().over(order)
    wanted = F.when(place == 1, 1).otherwise(F.greatest(F.lit(1), F.col("level")))
    numbered = entries.withColumn("_i", place).withColumn("_d", wanted - place)
    running = F.min("_d").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("level", (F.col("_i") + running).cast("int")).drop("_i", "_d")


def finish(entries: DataFrame) -> DataFrame:
    """Dedup, sort and hierarchy, in this order."""
    return sanitize_hierarchy(sort_by_page(deduplicate(entries)))


def to_rows(entries: DataFrame) -> DataFrame:
    """Bookmark rows: level, title, page; the confidence goes."""
    return entries.select("doc_id", "ordinal", "level", "title", "page_number")


def from_rows(bookmarks: DataFrame) -> DataFrame:
    """Entries of existing bookmark rows, with full confidence."""
    return bookmarks.withColumn("confidence", F.lit(1.0))


def check_no_existing(bookmarks: DataFrame, force: bool = False) -> DataFrame:
    """Documents that may be written: all with force, else those without bookmarks (existing_toc is an array)."""
    return bookmarks if force else bookmarks.where(F.coalesce(F.size("existing_toc"), F.lit(0)) <= 0)


def transplant(entries: DataFrame, copies: DataFrame) -> DataFrame:
    """Entries found in copies (copy_id, doc_id), as with recognised text, as entries of the documents they are copies of."""
    moved = entries.withColumnRenamed("doc_id", "copy_id").join(copies.select("copy_id", "doc_id"), "copy_id")
    return moved.select(entries.columns)


def entry_string() -> Column:
    """An entry as inference logs count it."""
    return F.format_string("TOCEntry(level=%d, title='%s', page_number=%d, confidence=%s)", "level", "title", "page_number", F.col("confidence").cast("string"))


def entry_bullet() -> Column:
    """An entry as a line of a prompt."""
    return F.format_string("- %s (page %d, level %d, confidence %s)", "title", "page_number", "level", format_confidence(F.col("confidence")))
