"""Compact text forms of features for prompts: font table, page groups, summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataleaf.functions.text import format_size, format_y, is_section_number, proxy_tokens, strip, strip_subset_prefix
from strataleaf.operators.features import ORDER, with_body_font

#: Fixed values of the summary.
SUMMARY_ROWS, SUMMARY_RATIO, HEADING_SHARE = 80, 1.1, 0.8
EMPTY_SUMMARY = "(No features available)"


def font_table(features: DataFrame) -> DataFrame:
    """doc_id, font, font_no: fonts without subset prefix, numbered as they are met."""
    met = features.groupBy("doc_id", strip_subset_prefix(F.col("font_name")).alias("font")).agg(F.min(F.struct(*ORDER)).alias("met"))
    return met.select("doc_id", "font", (F.row_number().over(Window.partitionBy("doc_id").orderBy("met")) - 1).alias("font_no"))


def feature_lines(features: DataFrame) -> DataFrame:
    """Each feature with its font, the font's number and its line of the compact form.

    Features are dealt by document once; the windows below and the groups of serialize() stay there.
    """
    met = F.min(F.struct(*ORDER)).over(Window.partitionBy("doc_id", "font"))
    known = features.repartition("doc_id").withColumn("font", strip_subset_prefix(F.col("font_name"))).withColumn("_met", met)
    known = known.withColumn("font_no", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("_met")) - 1).drop("_met")
    parts = F.array_compact(
        F.array(
            F.concat(F.lit("F"), F.col("font_no").cast("string")),
            format_size(F.col("font_size")),
            F.col("text_snippet"),
            format_y(F.col("y_position")),
            F.when(F.col("is_bold"), F.lit("B")),
        )
    )
    return known.withColumn("line", F.array_join(parts, "|"))


def serialize(features: DataFrame) -> DataFrame:
    """doc_id, text: font table, then the features of each page."""
    said = F.struct(*ORDER, "line")
    whole = feature_lines(features).groupBy("doc_id").agg(
        F.sort_array(F.collect_list(said)).alias("p"), F.sort_array(F.collect_set(F.struct("font_no", "font"))).alias("f")
    )
    head = F.array_join(F.transform("f", lambda x: F.concat(F.lit("F"), x["font_no"].cast("string"), F.lit("="), x["font"])), "\n")
    before = lambda i: F.get(F.col("p"), i - 1)["page_number"]
    # A page's first line is led by the page's name.
    lines = F.transform(
        "p", lambda x, i: F.when((i > 0) & (before(i) == x["page_number"]), x["line"]).otherwise(F.concat(F.lit("P"), x["page_number"].cast("string"), F.lit(":\n"), x["line"]))
    )
    return whole.select("doc_id", F.concat(F.lit("FONTS:\n"), head, F.lit("\n\n"), F.array_join(lines, "\n")).alias("text"))


def feature_string() -> Column:
    """A feature as (page, 'font', size, length, 'snippet', y=..., bold=...), unknown parts left out."""
    head = F.format_string("(%d, '%s', %s, %d, '%s'", "page_number", "font_name", F.col("font_size").cast("string"), "text_length", "text_snippet")
    y = F.concat(F.lit(", y="), F.col("y_position").cast("string"))
    bold = F.when(F.col("is_bold"), ", bold=True").when(~F.col("is_bold"), ", bold=False")
    return F.concat(head, F.coalesce(y, F.lit("")), F.coalesce(bold, F.lit("")), F.lit(")"))


def _nested(rows: DataFrame, keys: list[str], below: str) -> DataFrame:
    """The texts of the rows of each key as one bracketed list, in the order of the column below."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct(below, "t"))), lambda x: x["t"])
    return rows.groupBy(*keys).agg(F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]")).alias("t"))


def feature_list_text(features: DataFrame) -> DataFrame:
    """doc_id, text: a document's features as nested lists of blocks, lines and spans."""
    spans = features.select("doc_id", F.struct("page_number", "phase", "block_ix").alias("block"), "line_ix", "span_ix", feature_string().alias("t"))
    lines = _nested(spans, ["doc_id", "block", "line_ix"], "span_ix")
    return _nested(_nested(lines, ["doc_id", "block"], "line_ix"), ["doc_id"], "block").withColumnRenamed("t", "text")


def feature_list_tokens(features: DataFrame, tokens: Callable[[Column], Column] = proxy_tokens) -> DataFrame:
    """doc_id, tokens of feature_list_text(); the proxy needs lengths only and makes no text."""
    if tokens is not proxy_tokens:
        return feature_list_text(features).select("doc_id", tokens(F.col("text")).alias("tokens"))
    spans = features.select("doc_id", "page_number", "phase", "block_ix", "line_ix", F.length(feature_string()).alias("n"))
    # Brackets around each list and a comma and a blank between neighbours.
    lines = spans.groupBy("doc_id", "page_number", "phase", "block_ix", "line_ix").agg((F.sum("n") + F.count("*") * 2).alias("n"))
    blocks = lines.groupBy("doc_id", "page_number", "phase", "block_ix").agg((F.sum("n") + F.count("*") * 2).alias("n"))
    return blocks.groupBy("doc_id").agg(F.ceil((F.sum("n") + F.count("*") * 2) / F.lit(4.0)).cast("long").alias("tokens"))


def block_tokens(features: DataFrame, tokens: Callable[[Column], Column] = proxy_tokens) -> DataFrame:
    """Estimated tokens of each feature block, at least one."""
    line = F.concat(F.lit("F0|12|"), F.col("text_snippet"), F.lit("|.12|B"))
    blocks = features.groupBy("doc_id", "page_number", "phase", "block_ix").agg(F.sort_array(F.collect_list(F.struct("line_ix", "span_ix", line.alias("line")))).alias("p"))
    text = F.concat(F.lit("P1:\n"), F.array_join(F.transform("p", lambda x: x["line"]), "\n"))
    return blocks.select("doc_id", "page_number", "phase", "block_ix", F.greatest(F.lit(1).cast("long"), tokens(text)).alias("tokens"))


def even_sample(rows: DataFrame, keys: list[str], order: list[str], n) -> DataFrame:
    """Rows of each group at places floor(i * (len / n)); all of them where there are no more than n."""
    w = Window.partitionBy(*keys)
    n = n if not isinstance(n, int) else F.lit(n)
    placed = rows.withColumn("_n", n).withColumn("_len", F.count("*").over(w)).withColumn("_at", F.row_number().over(w.orderBy(*order)) - 1)
    step = F.col("_len") / F.col("_n")
    # A place is drawn if some whole i below n has floor(i * step) equal to it; the candidates lie next to place / step.
    near = F.floor(F.col("_at") / step)
    hit = F.lit(False)
    for d in (-1, 0, 1, 2):
        i = near + d
        hit = hit | ((i >= 0) & (i < F.col("_n")) & (F.floor(i * step) == F.col("_at")))
    return placed.where((F.col("_len") <= F.col("_n")) | ((F.col("_n") > 0) & hit)).drop("_n", "_len", "_at")


def summary(features: DataFrame, max_rows: int = SUMMARY_ROWS) -> DataFrame:
    """doc_id, text: a sample of heading-like features and, for the rest, of others, in page order."""
    marked = with_body_font(features).withColumn(
        "stratum",
        F.when(
            F.coalesce("is_bold", F.lit(False))
            | ((F.col("body_size") > 0) & (F.col("font_size") > F.col("body_size") * SUMMARY_RATIO))
            | is_section_number(strip(F.col("text_snippet"))),
            0,
        ).otherwise(1),
    )
    w = Window.partitionBy("doc_id")
    heads = F.sum((F.col("stratum") == 0).cast("int")).over(w)
    marked = marked.withColumn("_heads", F.least(heads, F.lit(int(max_rows * HEADING_SHARE)))).withColumn(
        "_budget", F.when(F.col("stratum") == 0, F.col("_heads")).otherwise(F.lit(max_rows) - F.col("_heads"))
    )
    drawn = even_sample(marked, ["doc_id", "stratum"], list(ORDER), F.col("_budget"))
    y = format_y(F.col("y_position"))
    parts = F.array_compact(
        F.array(
            F.concat(F.format_string("P%d", "page_number"), F.coalesce(F.concat(F.lit("@"), y), F.lit(""))),
            F.concat(strip_subset_prefix(F.col("font_name")), F.lit(" "), format_size(F.col("font_size"))),
            F.when(F.col("is_bold"), F.lit("B")),
            F.concat(F.lit('"'), F.col("text_snippet"), F.lit('"')),
        )
    )
    place = F.struct("page_number", F.coalesce("y_position", F.lit(0.0)).alias("y"), "stratum", *[F.col(c).alias(f"o_{c}") for c in ORDER], F.array_join(parts, " ").alias("line"))
    return drawn.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(place)), lambda x: x["line"]), "\n").alias("text"))
