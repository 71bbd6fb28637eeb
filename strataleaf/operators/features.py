"""Spans to features: quotas, heading candidates, body font, merge.

A span table has doc_id, page_number (from 1), page_height, block_ix, block_type
(0 text, 1 image), line_ix, span_ix (from 0), font, size, text, y0, flags.
Rows of blocks or lines without spans have a null span_ix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataleaf.functions.text import is_bold, is_heading, round_exact, squeeze, strip

#: Quotas and thresholds.
BLOCKS_PER_PAGE, LINES_PER_BLOCK, SNIPPET = 3, 5, 50
CANDIDATES_PER_PAGE = 3
RATIO, STRICT_RATIO = 1.15, 1.2
BOTTOM_Y = 0.6
ORDER = ("page_number", "phase", "block_ix", "line_ix", "span_ix")
COLUMNS = ("doc_id", *ORDER, "font_name", "font_size", "text_length", "text_snippet", "y_position", "is_bold")


def y_position(y0: Column, height: Column) -> Column:
    return F.when(y0.isNotNull() & (height > 0), round_exact(y0 / height, 2))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def first_blocks(spans: DataFrame, max_blocks: int = BLOCKS_PER_PAGE, max_lines: int = LINES_PER_BLOCK, snippet: int = SNIPPET) -> DataFrame:
    """Features of the first blocks of each page; image blocks use up the quota and give none."""
    kept = spans.where((F.col("block_ix") < max_blocks) & (F.col("line_ix") < max_lines) & (F.col("block_type") == 0) & F.col("span_ix").isNotNull())
    return kept.select(
        "doc_id",
        "page_number",
        F.lit(1).alias("phase"),
        "block_ix",
        "line_ix",
        "span_ix",
        _text("font").alias("font_name"),
        F.coalesce("size", F.lit(0.0)).alias("font_size"),
        F.length(_text("text")).alias("text_length"),
        F.substring(_text("text"), 1, snippet).alias("text_snippet"),
        y_position(F.col("y0"), F.col("page_height")).alias("y_position"),
        is_bold(F.col("font"), F.col("flags")).alias("is_bold"),
    )


def merged_lines(spans: DataFrame, snippet: int = SNIPPET) -> DataFrame:
    """One synthetic span for each line: texts joined, style of the first span, first known position."""
    parts = F.sort_array(F.collect_list(F.struct("span_ix", "font", "size", "text", "y0", "flags")))
    lines = spans.where("span_ix IS NOT NULL").groupBy("doc_id", "page_number", "page_height", "block_ix", "line_ix").agg(parts.alias("p"))
    said = F.transform("p", lambda s: strip(F.coalesce(s["text"], F.lit(""))))
    text = squeeze(strip(F.array_join(said, " ")))
    first = F.element_at("p", 1)
    return lines.select(
        "doc_id",
        "page_number",
        "page_height",
        "block_ix",
        "line_ix",
        F.coalesce(first["font"], F.lit("")).alias("font"),
        F.coalesce(first["size"], F.lit(0.0)).alias("size"),
        F.coalesce(first["flags"], F.lit(0)).alias("flags"),
        F.get(F.filter("p", lambda s: s["y0"].isNotNull()), F.lit(0))["y0"].alias("y0"),
        F.length(text).alias("text_length"),
        F.substring(text, 1, snippet).alias("text"),
        F.exists("p", lambda s: is_bold(s["font"], s["flags"])).alias("any_bold"),
    )


def body_font(features: DataFrame) -> DataFrame:
    """doc_id, body_font, body_size: the most frequent (font, size); of equals, the one met first."""
    place = F.struct(*ORDER)
    counted = features.groupBy("doc_id", "font_name", "font_size").agg(F.count("*").alias("n"), F.min(place).alias("met"))
    best = counted.groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "met", "font_name", "font_size")).alias("b"))
    return best.select("doc_id", F.col("b.font_name").alias("body_font"), F.col("b.font_size").alias("body_size"))


def with_body_font(features: DataFrame) -> DataFrame:
    """The features with their document's body_font and body_size.

    Dealt by document once; further windows by document need no other exchange.
    """
    style = Window.partitionBy("doc_id", "font_name", "font_size")
    counted = features.repartition("doc_id").withColumn("_n", F.count("*").over(style)).withColumn("_met", F.min(F.struct(*ORDER)).over(style))
    first = Window.partitionBy("doc_id").orderBy(F.col("_n").desc(), "_met").rowsBetween(Window.unboundedPreceding, 0)
    found = counted.withColumn("body_font", F.first("font_name").over(first)).withColumn("body_size", F.first("font_size").over(first))
    return found.drop("_n", "_met")


def late_candidates(spans: DataFrame, body: DataFrame, max_blocks: int = BLOCKS_PER_PAGE, cap: int = CANDIDATES_PER_PAGE, snippet: int = SNIPPET) -> DataFrame:
    """Features of heading-like first lines of the blocks beyond the quota, so many a page."""
    beyond = spans.where((F.col("block_ix") >= max_blocks) & (F.col("block_type") == 0) & (F.col("line_ix") == 0))
    lines = merged_lines(beyond, snippet).join(body, "doc_id", "left")
    lines = lines.withColumn("y_position", y_position(F.col("y0"), F.col("page_height")))
    ratio = F.when(F.col("y_position") > BOTTOM_Y, RATIO).otherwise(STRICT_RATIO)
    # The first span's own style decides here, not that of the whole line.
    passing = lines.where(is_heading(F.col("text"), F.col("size"), is_bold(F.col("font"), F.col("flags")), F.col("body_size"), ratio))
    nth = Window.partitionBy("doc_id", "page_number").orderBy("block_ix")
    return passing.withColumn("_n", F.row_number().over(nth)).where(F.col("_n") <= cap).select(
        "doc_id",
        "page_number",
        F.lit(2).alias("phase"),
        "block_ix",
        "line_ix",
        F.lit(0).alias("span_ix"),
        F.col("font").alias("font_name"),
        F.col("size").alias("font_size"),
        "text_length",
        F.col("text").alias("text_snippet"),
        "y_position",
        F.col("any_bold").alias("is_bold"),
    )


def extract(spans: DataFrame, max_pages: int | None = None, max_blocks: int = BLOCKS_PER_PAGE, max_lines: int = LINES_PER_BLOCK, snippet: int = SNIPPET) -> DataFrame:
    """All features of the documents; (page, phase, block, line, span) is their order."""
    if max_pages is not None:
        spans = spans.where(F.col("page_number") <= max_pages)
    early = first_blocks(spans, max_blocks, max_lines, snippet)
    late = late_candidates(spans, body_font(early), max_blocks, CANDIDATES_PER_PAGE, snippet)
    return early.select(*COLUMNS).unionByName(late.select(*COLUMNS))


def heading_entries(features: DataFrame) -> DataFrame:
    """Entries of the heading-like features: the deterministic stand-in for inference.

    Levels are ranks of font size, largest first.
    """
    found = with_body_font(features).where(
        is_heading(F.col("text_snippet"), F.col("font_size"), F.col("is_bold"), F.col("body_size"), RATIO)
    )
    order = Window.partitionBy("doc_id").orderBy(*ORDER)
    rank = Window.partitionBy("doc_id").orderBy(F.col("font_size").desc())
    return found.select(
        "doc_id",
        F.row_number().over(order).cast("long").alias("ordinal"),
        strip(F.col("text_snippet")).alias("title"),
        "page_number",
        F.dense_rank().over(rank).alias("level"),
        F.lit(1.0).alias("confidence"),
    )


def page_ranges(pages: DataFrame, parts: int) -> DataFrame:
    """part of each page (page_ix from 0, page_count): equal ranges, the last with the remainder."""
    width = F.expr(f"page_count div {parts}")
    return pages.withColumn("part", F.when(width == 0, F.lit(parts - 1)).otherwise(F.least(F.expr(f"page_ix div greatest(1, page_count div {parts})"), F.lit(parts - 1))).cast("int"))
