"""The three jobs end to end: contents, text recognition, renames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataleaf.functions.text import proxy_tokens
from strataleaf.operators import batching, correction, features, inference, ocr, offsets, rename, serialize, toc
from strataleaf.sources import pages as source


def contents_without_inference(spans: DataFrame) -> DataFrame:
    """Entries straight from heading-like features: one lazy plan, no provider."""
    found = features.extract(spans)
    return toc.finish(features.heading_entries(found))


def batch_texts(feats: DataFrame, max_tokens: int, overlap: int, count: Callable[[str], int] = batching.proxy_count) -> DataFrame:
    """doc_id, batch_ix, batches, text: compact form of each batch of features."""
    lines = serialize.feature_lines(feats)
    block = Window.partitionBy("doc_id").orderBy("page_number", "phase", "block_ix")
    numbered = feats.withColumn("block_no", (F.dense_rank().over(block) - 1).cast("long"))
    ranges = batching.feature_batches(lines, max_tokens, overlap, count)
    parts = numbered.join(ranges, "doc_id").where((F.col("block_no") >= F.col("first")) & (F.col("block_no") < F.col("end")))
    # A batch is serialised as a document of its own.
    keyed = parts.withColumn("key", F.struct("doc_id", "batch_ix")).drop("batch_ix", "first", "end", "block_no")
    text = serialize.serialize(keyed.withColumn("doc_id", F.col("key")).drop("key"))
    count = Window.partitionBy("doc_id")
    return text.select(F.col("doc_id.doc_id").alias("id"), F.col("doc_id.batch_ix").alias("batch_ix"), "text").withColumnRenamed("id", "doc_id").withColumn("batches", F.count("*").over(count))


def generate_contents(
    spans: DataFrame,
    provider: inference.Provider,
    work_path: str,
    refine: inference.Provider | None = None,
    max_tokens: int = batching.FEATURE_TOKENS,
    overlap: int = batching.OVERLAP_BLOCKS,
    delay: float = 0.0,
    count: Callable[[str], int] = batching.proxy_count,
) -> DataFrame:
    """Entries of each document: features, batches, inference, merge, corrections, hierarchy.

    Inference is written below work_path before anything reads it.
    """
    feats = features.extract(spans)
    wanted = inference.requests(batch_texts(feats, max_tokens, overlap, count))
    rows = inference.infer(wanted, provider, inference.ENTRY_SCHEMA, f"{work_path}/entries", delay)
    entries = toc.merge(rows)
    order = Window.partitionBy("doc_id").orderBy(*features.ORDER)
    numbered = feats.withColumn("ordinal", F.row_number().over(order).cast("long"))
    blocks = source.block_table(spans)
    entries = correction.correct_running_headers(entries, numbered, blocks)
    if refine is not None:
        entries = refined_contents(entries, feats, spans, blocks, refine, f"{work_path}/refined")
    return toc.finish(entries)


def refined_contents(entries: DataFrame, feats: DataFrame, spans: DataFrame, blocks: DataFrame, provider: inference.Provider, path: str) -> DataFrame:
    """Entries that a second pass refined, their page numbers corrected."""
    pages = source.plain_text(spans)
    printed_text = offsets.reference_text(pages)
    lines = printed_text.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    printed = offsets.printed_entries(lines)
    shift = offsets.front_matter_offset(entries, printed)
    listed = entries.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", toc.entry_bullet().alias("t")))), lambda x: x["t"]), "\n").alias("listed"))
    prompt = (
        listed.join(shift, "doc_id")
        .join(printed_text.withColumnRenamed("text", "printed"), "doc_id", "left")
        .join(serialize.summary(feats).withColumnRenamed("text", "summary"), "doc_id", "left")
    )
    text = F.concat_ws("\n\n", "listed", F.nullif(offsets.offset_note(F.col("offset")), F.lit("")), F.coalesce("printed", F.lit("(No printed contents)")), F.coalesce("summary", F.lit(serialize.EMPTY_SUMMARY)))
    wanted = prompt.select("doc_id", F.lit(1).cast("long").alias("batch_ix"), F.lit(inference.REFINE_PROMPT).alias("system"), text.alias("text"))
    refined = inference.infer(wanted, provider, inference.ENTRY_SCHEMA, path).drop("batch_ix")
    counts = spans.groupBy("doc_id").agg(F.max("page_number").alias("page_count"))
    corrected = correction.correct_refined(entries, refined, printed, blocks, counts)
    # A document whose refinement came back empty keeps none, as asked.
    return corrected.select(entries.columns)


def recognised_text(docs: DataFrame, pages: DataFrame, images: DataFrame, provider: Callable, force: bool = False, detect: ocr.Detection | None = None) -> DataFrame:
    return ocr.extract_text(docs, pages, images, provider, force, detect=detect)


def plan_renames(paths: DataFrame, instruction: str, provider: inference.Provider, work_path: str, max_tokens: int = batching.NAME_TOKENS, delay: float = 0.0, tokens: Callable = proxy_tokens) -> DataFrame:
    """ordinal, source, target, confidence, colour, reasoning of proposed renames for paths (ordinal, path); names are unique or the plan fails."""
    named = rename.checked_paths(paths).withColumn("doc_id", F.lit(0).cast("long")).withColumn("name", F.col("filename"))
    batched = batching.name_batches(named, "doc_id", "ordinal", max_tokens, tokens)
    before = batching.files_before(batched, "doc_id")
    text = batched.groupBy("doc_id", "batch_ix").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "name"))), lambda x: F.concat(F.lit("- "), x["name"])), "\n").alias("names"))
    asked = text.join(before, ["doc_id", "batch_ix"]).select(
        "doc_id",
        "batch_ix",
        F.lit(inference.RENAME_PROMPT).alias("system"),
        F.concat(F.lit(instruction), F.format_string("\n(%d files before)\n", "files_before"), F.col("names")).alias("text"),
    )
    rows = inference.infer(asked, provider, inference.RENAME_SCHEMA, f"{work_path}/renames", delay, retryable=lambda _: True)
    order = Window.partitionBy("doc_id").orderBy("batch_ix", "ordinal")
    merged = rename.merge(rows).withColumn("ordinal", F.row_number().over(order).cast("long"))
    ops = rename.valid_operations(merged)
    return rename.display(rename.resolve(ops, named), ops)
