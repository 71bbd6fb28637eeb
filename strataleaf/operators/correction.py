"""Page-number corrections: running headers, restored pages, nearest headings.

A feature table has doc_id, page_number, text_snippet, y_position and an order
column `ordinal`; a block table has doc_id, page_number, block_ix, y (unrounded
position of the first span) and text (all spans joined by blanks). Every join has
doc_id and a page or level as equi-keys; normal forms are computed before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataleaf.functions.text import (
    FUZZY_MIN,
    FUZZY_RATIO,
    HEADING_MIN,
    heading_matches,
    normalize_for_restore,
    normalize_snippet,
    normalize_title,
    strip,
    without_appendix,
)
from strataleaf.operators.matching import containment_join

#: Zones of a page, from its top at 0 to its bottom at 1.
PAGES_TOGETHER = 16
HEADER_Y, SEARCH_TOP, SEARCH_BOTTOM, LOWER_HALF = 0.05, 0.06, 0.95, 0.5


def zone_text(features: DataFrame) -> DataFrame:
    """doc_id, page_number, header, body: normal forms of the features of each zone, in order, each after a blank."""
    normal = features.where("y_position IS NOT NULL").select("doc_id", "page_number", "ordinal", (F.col("y_position") < HEADER_Y).alias("top"), normalize_snippet(F.col("text_snippet")).alias("norm"))
    normal = normal.where("norm != ''")

    def joined(wanted: Column) -> Column:
        parts = F.sort_array(F.collect_list(F.when(wanted, F.struct("ordinal", "norm"))))
        return F.array_join(F.transform(parts, lambda x: F.concat(F.lit(" "), x["norm"])), "")

    return normal.groupBy("doc_id", "page_number").agg(joined(F.col("top")).alias("header"), joined(~F.col("top")).alias("body"))


def _either_way(title: Column, zone: Column) -> Column:
    zone = F.coalesce(zone, F.lit(""))
    return (zone != "") & (zone.contains(title) | title.contains(strip(zone)))


def candidate_forms(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("cand_norm", normalize_snippet(F.col("text"))).withColumn("cand_title", normalize_title(F.col("text")))


def _title_forms(entries: DataFrame) -> DataFrame:
    return entries.withColumn("norm", normalize_snippet(F.col("title"))).withColumn("norm_without", normalize_snippet(without_appendix(F.col("title"))))


def _matches() -> Column:
    return heading_matches(F.col("title"), F.col("norm"), F.col("norm_without"), F.col("cand_norm"), F.col("cand_title"))


def heading_in_lower_half(entries: DataFrame, blocks: DataFrame, threshold: float = LOWER_HALF) -> DataFrame:
    """The entries whose title heads a block in the lower part of their page."""
    low = candidate_forms(blocks.where(F.col("y") > threshold)).select("doc_id", "page_number", "cand_norm", "cand_title")
    titled = _title_forms(entries).where(F.length("norm") >= HEADING_MIN)
    return titled.join(low, ["doc_id", "page_number"]).where(_matches()).select(entries.columns).distinct()


def page_contains_heading(entries: DataFrame, pages: DataFrame, window: int = 1) -> DataFrame:
    """The entries whose title is found in the text of their page or of its neighbours."""
    near = _title_forms(entries).where(F.length("norm") >= HEADING_MIN)
    near = near.withColumn("_page", F.explode(F.sequence(F.col("page_number") - window, F.col("page_number") + window)))
    text = candidate_forms(pages).select("doc_id", F.col("page_number").alias("_page"), "cand_norm", "cand_title")
    return near.join(text, ["doc_id", "_page"]).where(_matches()).select(entries.columns).distinct()


def correct_running_headers(entries: DataFrame, features: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Entries that only a running header names move to the page before, if their heading stands there."""
    zones = zone_text(features)
    here = zones.select("doc_id", "page_number", "header", "body")
    prev = zones.select("doc_id", (F.col("page_number") + 1).alias("page_number"), F.col("body").alias("prev_body"))
    title = F.col("norm")
    judged = (
        entries.withColumn("norm", normalize_snippet(F.col("title")))
        .join(here, ["doc_id", "page_number"], "left")
        .join(prev, ["doc_id", "page_number"], "left")
        .withColumn(
            "header_only",
            (F.length(title) >= HEADING_MIN) & (F.col("page_number") > 1) & (strip(F.coalesce("header", F.lit(""))) != "") & _either_way(title, F.col("header")) & ~_either_way(title, F.col("body")),
        )
        .withColumn("found", _either_way(title, F.col("prev_body")))
    )
    if blocks is not None:
        doubtful = judged.where(F.col("header_only") & ~F.col("found")).select("doc_id", "ordinal", "title", (F.col("page_number") - 1).alias("page_number"))
        low = heading_in_lower_half(doubtful, blocks).select("doc_id", "ordinal", F.lit(True).alias("low"))
        judged = judged.join(low, ["doc_id", "ordinal"], "left").withColumn("found", F.col("found") | F.coalesce("low", F.lit(False)))
    page = F.when(F.col("header_only") & F.col("found"), F.col("page_number") - 1).otherwise(F.col("page_number"))
    return judged.withColumn("page_number", page).select(entries.columns)


def restore_pages(refined: DataFrame, original: DataFrame) -> DataFrame:
    """Refined entries with the page of the original entry that they go back to.

    An equal normal form on the same level decides, the first one; else the best
    containment, ties to the form met first; else the entry's own page stays.
    """
    keyed = original.withColumn("key", normalize_for_restore(F.col("title")))
    met = keyed.groupBy("doc_id", "key").agg(F.min("ordinal").alias("met"))
    first = keyed.groupBy("doc_id", "level", "key").agg(F.min_by("page_number", "ordinal").alias("orig_page"), F.min("ordinal").alias("first")).join(met, ["doc_id", "key"])
    wanted = refined.withColumn("r_key", normalize_for_restore(F.col("title")))
    exact = first.select("doc_id", "level", F.col("key").alias("r_key"), F.col("orig_page").alias("exact_page"))
    wanted = wanted.join(exact, ["doc_id", "level", "r_key"], "left")
    short, long = F.least(F.length("key"), F.length("r_key")), F.greatest(F.length("key"), F.length("r_key"))
    fits = (short >= FUZZY_MIN) & (short / long >= FUZZY_RATIO)
    open_ = wanted.where("exact_page IS NULL").select("doc_id", "level", "r_key").distinct()
    fuzzy = (
        containment_join(open_, first.select("doc_id", "level", "key", "orig_page", "met", "first"), ["doc_id", "level"], "r_key", "key")
        .where(fits)
        .groupBy("doc_id", "level", "r_key")
        .agg(F.min_by("orig_page", F.struct((-(short / long)).alias("r"), "met", "first")).alias("fuzzy_page"))
    )
    out = wanted.join(fuzzy, ["doc_id", "level", "r_key"], "left")
    return out.withColumn("page_number", F.coalesce("exact_page", "fuzzy_page", "page_number")).select(refined.columns)


def nearest_heading(wanted: DataFrame, blocks: DataFrame) -> DataFrame:
    """ordinal and found_page: the page in [start_page, end_page) nearest to hint_page where the title heads a block.

    Of two pages equally near the later one; running headers and footers do not count.
    """
    body = candidate_forms(blocks.where(F.col("y").between(SEARCH_TOP, SEARCH_BOTTOM))).select("doc_id", F.col("page_number").alias("_page"), "cand_norm", "cand_title")
    titled = _title_forms(wanted).where(F.length("norm") >= HEADING_MIN)
    reach = F.abs(F.col("_page") - F.col("hint_page"))
    inside = (F.col("_page") >= F.col("start_page")) & (F.col("_page") < F.col("end_page")) & (reach <= F.col("end_page") - F.col("start_page"))
    # Pages and windows meet in stretches of so many pages, not all of a document with all.
    stretch = lambda c: F.floor(c / PAGES_TOGETHER)
    windows = titled.where("end_page > start_page").withColumn("_s", F.explode(F.sequence(stretch(F.col("start_page")), stretch(F.col("end_page") - 1))))
    hits = windows.join(body.withColumn("_s", stretch(F.col("_page"))), ["doc_id", "_s"]).where(inside & _matches())
    return hits.groupBy("doc_id", "ordinal").agg(F.min_by("_page", F.struct(reach.alias("d"), (F.col("_page") < F.col("hint_page")).alias("before"))).alias("found_page"))


def verify_pages(entries: DataFrame, offsets: DataFrame, blocks: DataFrame, page_counts: DataFrame, least: int = 3) -> DataFrame:
    """Entries moved to where their heading is found within the offset of their page; only where that is significant."""
    windowed = (
        entries.join(offsets, "doc_id")
        .join(page_counts, "doc_id")
        .where((F.col("offset") >= least) & (F.length(normalize_snippet(F.col("title"))) >= FUZZY_MIN))
        .select(
            "doc_id",
            "ordinal",
            "title",
            F.greatest(F.lit(1), F.col("page_number") - F.col("offset")).alias("start_page"),
            (F.least("page_count", F.col("page_number") + F.col("offset")) + 1).alias("end_page"),
            F.col("page_number").alias("hint_page"),
        )
    )
    found = nearest_heading(windowed, blocks)
    moved = entries.join(found, ["doc_id", "ordinal"], "left")
    return moved.withColumn("page_number", F.coalesce("found_page", "page_number").cast(entries.schema["page_number"].dataType)).select(entries.columns)


def correction_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, entries, corrected: how many entries of each document a correction moved to another page."""
    old = before.select("doc_id", "ordinal", F.col("page_number").alias("was"))
    both = after.select("doc_id", "ordinal", "page_number").join(old, ["doc_id", "ordinal"], "left")
    return both.groupBy("doc_id").agg(F.count("*").alias("entries"), F.count_if(~F.col("page_number").eqNullSafe(F.col("was"))).alias("corrected"))


def correct_refined(original: DataFrame, refined: DataFrame, printed: DataFrame, blocks: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Restores pages of known entries and verifies all by heading search."""
    from strataleaf.operators.offsets import front_matter_offset

    return verify_pages(restore_pages(refined, original), front_matter_offset(original, printed), blocks, page_counts)
