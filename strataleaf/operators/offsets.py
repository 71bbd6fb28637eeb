"""Printed page numbers: parse them, and find how far they lie behind physical ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataleaf.functions.text import (
    FUZZY_MIN,
    PRINTED_LINE_MAX,
    has_trailing_number,
    is_front_matter,
    is_main_start,
    normalize_front,
    normalize_snippet,
    normalize_title,
    strip,
    titles_match,
    toc_like_lines,
)
from strataleaf.operators.matching import containment_join

#: Fixed values.
REFERENCE_PAGES, UNFILTERED_PAGES = 20, 3
SIGNIFICANT, MIN_MATCHES, MIN_SHARE = 3, 3, 0.6
FIRST_MAIN_PAGE = 5


def reference_text(pages: DataFrame, max_pages: int = REFERENCE_PAGES, unfiltered: int = UNFILTERED_PAGES) -> DataFrame:
    """doc_id, text: the first pages, from the fourth on only lines like those of a table of contents."""
    text = F.when(F.col("page_number") <= unfiltered, F.col("text")).otherwise(toc_like_lines(F.col("text")))
    kept = pages.where((F.col("page_number") <= max_pages) & (strip(F.col("text")) != "")).select("doc_id", "page_number", text.alias("t")).where(strip(F.col("t")) != "")
    said = F.struct("page_number", F.concat(F.format_string("--- Page %d ---\n", "page_number"), F.col("t")).alias("t"))
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(said)), lambda x: x["t"]), "\n\n").alias("text"))


def printed_entries(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, title, printed_page of the lines (doc_id, line_no, line) with a trailing page number."""
    stripped = strip(F.col("line"))
    numbered = lines.withColumn("s", stripped).where((F.col("s") != "") & (F.length("s") <= PRINTED_LINE_MAX) & has_trailing_number(F.col("s")))
    title = F.regexp_replace(F.regexp_replace("s", r"(?U)\d+\s*$", ""), r"^[ .·…\t]+|[ .·…\t]+$", "")
    page = F.expr("try_cast(regexp_extract(s, '(?U)(\\\\d+)\\\\s*$', 1) AS BIGINT)")
    parsed = numbered.select("doc_id", "line_no", title.alias("title"), page.alias("printed_page"))
    return parsed.withColumn("norm", normalize_snippet(F.col("title"))).where(F.length("norm") >= FUZZY_MIN)


def reference_offset(printed: DataFrame, entries: DataFrame) -> DataFrame:
    """doc_id, reference_offset: the offset that enough printed lines agree on.

    Each line takes its first matching entry, and counts if that lies three pages behind or more.
    """
    normal = entries.select("doc_id", F.col("ordinal").alias("entry_no"), "page_number", normalize_snippet(F.col("title")).alias("e_norm"))
    # Matching titles are equal or one within the other; titles_match() then asks for enough of it.
    near = containment_join(printed.select("doc_id", "line_no", "printed_page", "norm"), normal, ["doc_id"], "norm", "e_norm")
    pairs = near.where(titles_match(F.col("norm"), F.col("e_norm")))
    taken = pairs.groupBy("doc_id", "line_no", "printed_page").agg(F.min_by("page_number", "entry_no").alias("page_number"))
    offsets = taken.withColumn("offset", F.col("page_number") - F.col("printed_page")).where(F.col("offset") >= SIGNIFICANT)
    counted = offsets.groupBy("doc_id", "offset").agg(F.count("*").alias("n"), F.min("line_no").alias("met"))
    best = counted.groupBy("doc_id").agg(F.sum("n").alias("all"), F.min(F.struct((-F.col("n")).alias("n"), "met", "offset")).alias("b"))
    enough = (-F.col("b.n") >= MIN_MATCHES) & (-F.col("b.n") / F.col("all") >= MIN_SHARE)
    return best.where(enough).select("doc_id", F.col("b.offset").alias("reference_offset"))


def anchor_offset(entries: DataFrame) -> DataFrame:
    """doc_id, anchor_offset: from the first main-content entry behind the last front-matter one."""
    roots = entries.where((F.col("level") == 1) & (F.col("page_number") > FIRST_MAIN_PAGE))
    roots = roots.withColumn("front", is_front_matter(normalize_front(F.col("title")))).withColumn("main", is_main_start(normalize_title(F.col("title"))))
    last = F.max(F.when(F.col("front"), F.col("page_number"))).over(Window.partitionBy("doc_id"))
    behind = roots.withColumn("last", last).where(F.col("last").isNull() | (F.col("page_number") > F.col("last")))
    return behind.groupBy("doc_id").agg(
        F.coalesce(
            F.min_by("page_number", F.when(F.col("main"), F.col("ordinal"))) - 1,
            F.min_by("page_number", F.when(~F.col("front"), F.col("ordinal"))) - 1,
            F.lit(0),
        ).alias("anchor_offset")
    )


def front_matter_offset(entries: DataFrame, printed: DataFrame | None = None) -> DataFrame:
    """doc_id, offset for every document that has entries."""
    docs = entries.select("doc_id").distinct().join(anchor_offset(entries), "doc_id", "left")
    if printed is None:
        return docs.select("doc_id", F.coalesce("anchor_offset", F.lit(0)).cast("long").alias("offset"))
    docs = docs.join(reference_offset(printed, entries), "doc_id", "left")
    return docs.select("doc_id", F.coalesce(F.nullif("reference_offset", F.lit(0)), "anchor_offset", F.lit(0)).cast("long").alias("offset"))


def offset_note(offset: Column) -> Column:
    """Advice on page numbers for a prompt; empty where the offset is not significant."""
    said = F.format_string(
        "This document has about %d pages before its main text. Printed page 1 is PDF page %d: keep the page numbers of existing entries, and for printed ones use PDF page N + %d (by adding %d).",
        offset,
        offset + 1,
        offset,
        offset,
    )
    return F.when(offset >= SIGNIFICANT, said).otherwise(F.lit(""))
