"""Documents as span tables: from nested page rows, from HTML, from files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = T.StructType(
    [
        T.StructField("font", T.StringType()),
        T.StructField("size", T.DoubleType()),
        T.StructField("text", T.StringType()),
        T.StructField("bbox", T.StructType([T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")])),
        T.StructField("flags", T.IntegerType()),
    ]
)
LINE = T.StructType([T.StructField("spans", T.ArrayType(SPAN))])
BLOCK = T.StructType([T.StructField("type", T.IntegerType()), T.StructField("lines", T.ArrayType(LINE))])
PAGE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("height", T.DoubleType()),
        T.StructField("blocks", T.ArrayType(BLOCK)),
    ]
)
#: Styles that tags stand for, and how spans are found in a page.
TAG_SIZES = {"h1": 24.0, "title": 20.0, "p": 12.0, "b": 12.0, "li": 10.0, "footer": 8.0}
TAG_SPAN = r"<(h1|title|p|b|li|footer)(?:\s[^>]*)?>([^<]*)"


def pages_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Page rows of JSON files (one page a line), with a fixed schema."""
    return spark.read.schema(PAGE).json(path)


def files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """doc_id, path, content of the files below a folder; the id is a hash of the path."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select(F.xxhash64("path").alias("doc_id"), "path", "length", "modificationTime", "content")


def parse_files(documents: DataFrame, parser: Callable[[bytes], Iterator[dict]], first_page: int = 1, last_page: int | None = None) -> DataFrame:
    """Page rows of documents through a parser: bytes to dicts of height and blocks, in page order."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for doc_id, content in zip(part["doc_id"], part["content"], strict=True):
                rows = [
                    {"doc_id": doc_id, "page_number": n, "height": p.get("height"), "blocks": p.get("blocks", [])}
                    for n, p in enumerate(parser(content), 1)
                    if n >= first_page and (last_page is None or n <= last_page)
                ]
                if rows:
                    yield pd.DataFrame(rows)

    return documents.select("doc_id", "content").mapInPandas(run, PAGE)


def existing_contents(documents: DataFrame, reader: Callable[[bytes], list]) -> DataFrame:
    """doc_id, path, existing_toc: the bookmark rows (level, title, page) that each file already has."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [[{"level": a, "title": b, "page_number": c} for a, b, c in reader(x)] for x in part["content"]]
            yield pd.DataFrame({"doc_id": part["doc_id"], "path": part["path"], "existing_toc": found})

    return documents.select("doc_id", "path", "content").mapInPandas(run, "doc_id long, path string, existing_toc array<struct<level:int,title:string,page_number:int>>")


def with_contents(documents: DataFrame, entries: DataFrame, writer: Callable[[bytes, list], bytes]) -> DataFrame:
    """doc_id, path, content of each document with its entries as bookmarks, through a writer of files.

    The writer takes the file and its rows (level, title, page) in order; a document without entries gets none.
    """
    listed = entries.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "level", "title", "page_number"))).alias("rows"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [[] if x is None else [[r["level"], r["title"], r["page_number"]] for r in x] for x in part["rows"]]
            made = [writer(c, r) for c, r in zip(part["content"], rows, strict=True)]
            yield pd.DataFrame({"doc_id": part["doc_id"], "path": part["path"], "content": made})

    return documents.select("doc_id", "path", "content").join(listed, "doc_id", "left").mapInPandas(run, "doc_id long, path string, content binary")


def concatenated(parts: DataFrame) -> DataFrame:
    """Pages of the parts of a document (doc_id, part, page_number from 1 in each) as one run of pages, parts in order."""
    sizes = parts.groupBy("doc_id", "part").agg(F.max("page_number").alias("_pages"))
    before = Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("doc_id", "part", F.coalesce(F.sum("_pages").over(before), F.lit(0)).alias("_before"))
    joined = parts.join(starts, ["doc_id", "part"])
    return joined.withColumn("page_number", (F.col("page_number") + F.col("_before")).cast("long")).select(parts.columns)


def page_images(documents: DataFrame, renderer: Callable[[bytes, int], Iterator[bytes]], dpi: int) -> DataFrame:
    """doc_id, page_number, image of every page, in the resolution asked for; a page at a time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for doc_id, content in zip(part["doc_id"], part["content"], strict=True):
                for n, image in enumerate(renderer(content, dpi), 1):
                    yield pd.DataFrame({"doc_id": [doc_id], "page_number": [n], "image": [image]})

    return documents.select("doc_id", "content").mapInPandas(run, "doc_id long, page_number int, image binary")


def spans_from_pages(pages: DataFrame) -> DataFrame:
    """Span rows of page rows; blocks and lines without spans keep a row with null span_ix, so quotas count them."""
    blocks = pages.select("doc_id", "page_number", F.coalesce("height", F.lit(0.0)).alias("page_height"), F.posexplode("blocks").alias("block_ix", "block"))
    lines = blocks.select("doc_id", "page_number", "page_height", "block_ix", F.col("block.type").alias("block_type"), F.posexplode_outer("block.lines").alias("line_ix", "line"))
    spans = lines.select("doc_id", "page_number", "page_height", "block_ix", "block_type", F.coalesce("line_ix", F.lit(0)).alias("line_ix"), F.posexplode_outer("line.spans").alias("span_ix", "s"))
    return spans.select("doc_id", "page_number", "page_height", "block_ix", "block_type", "line_ix", "span_ix", "s.font", "s.size", "s.text", F.col("s.bbox.y0").alias("y0"), "s.flags")


def spans_from_html(pages: DataFrame) -> DataFrame:
    """Span rows of HTML pages: each tag of interest with text is a block of one span; one page a document.

    Blocks are numbered inside the page's own row, so nothing is shuffled.
    """
    found = F.regexp_extract_all("html", F.lit(TAG_SPAN), F.lit(0))
    said = F.transform(found, lambda m: F.struct(F.regexp_extract(m, TAG_SPAN, 1).alias("font"), F.trim(F.regexp_extract(m, TAG_SPAN, 2)).alias("text")))
    blocks = pages.select(F.col("page_id").alias("doc_id"), F.filter(said, lambda s: s["text"] != "").alias("s"))
    spans = blocks.select("doc_id", F.size("s").cast("double").alias("page_height"), F.posexplode("s").alias("block_ix", "span"))
    font = F.col("span.font")
    return spans.select(
        "doc_id",
        F.lit(1).alias("page_number"),
        "page_height",
        "block_ix",
        F.lit(0).alias("block_type"),
        F.lit(0).alias("line_ix"),
        F.lit(0).alias("span_ix"),
        font.alias("font"),
        F.coalesce(*[F.when(font == k, v) for k, v in TAG_SIZES.items()]).alias("size"),
        F.col("span.text").alias("text"),
        F.col("block_ix").cast("double").alias("y0"),
        F.when(font.isin("h1", "b"), 16).otherwise(0).alias("flags"),
    )


def lines_from_documents(documents: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line."""
    return documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def plain_text(spans: DataFrame) -> DataFrame:
    """doc_id, page_number, text: lines of a page, their spans joined."""
    lines = spans.where("span_ix IS NOT NULL").groupBy("doc_id", "page_number", "block_ix", "line_ix").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("span_ix", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "").alias("t"))
    pages = lines.groupBy("doc_id", "page_number").agg(F.sort_array(F.collect_list(F.struct("block_ix", "line_ix", "t"))).alias("p"))
    return pages.select("doc_id", "page_number", F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("text"))


def block_table(spans: DataFrame) -> DataFrame:
    """doc_id, page_number, block_ix, y, text of text blocks: all spans joined by blanks, position of the first."""
    kept = spans.where((F.col("block_type") == 0) & F.col("span_ix").isNotNull())
    blocks = kept.groupBy("doc_id", "page_number", "page_height", "block_ix").agg(F.sort_array(F.collect_list(F.struct("line_ix", "span_ix", "y0", F.coalesce("text", F.lit("")).alias("t")))).alias("p"))
    y = F.when(F.col("page_height") > 0, F.element_at("p", 1)["y0"] / F.col("page_height"))
    return blocks.select("doc_id", "page_number", "block_ix", y.alias("y"), F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("text")).where("y IS NOT NULL")
