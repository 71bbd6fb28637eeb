"""Commands: generate-toc, extract-text, rename.

Files are read and recognised by parser, recogniser and inference callables named
as module:function, since none of these is part of the library.
"""

from __future__ import annotations

import argparse
import importlib
import os
import shutil
import stat
import sys
import tempfile
from pathlib import Path

from strataleaf import config


def load_callable(name: str):
    module, _, attribute = name.partition(":")
    if not attribute:
        raise SystemExit(f"{name}: give a callable as module:function")
    return getattr(importlib.import_module(module), attribute)


def replace_file(made: str, target: str) -> None:
    """Moves a file over another, whose permissions stay."""
    mode = stat.S_IMODE(os.stat(target).st_mode)
    shutil.move(made, target)
    os.chmod(target, mode)


def output_of(output: str | None, inplace: bool) -> str | None:
    """The output path, or None for in place; exactly one must be asked for."""
    if bool(output) == bool(inplace):
        raise SystemExit("give either an output path or --inplace")
    return output


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strataleaf")
    p.add_argument("-c", "--config", type=Path)
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("generate-toc", "extract-text"):
        c = commands.add_parser(name)
        c.add_argument("input")
        c.add_argument("output", nargs="?")
        c.add_argument("--inplace", action="store_true", default=None)
        c.add_argument("--force", action="store_true", default=None)
        c.add_argument("--parser", required=True, help="bytes to pages, as module:function")
        c.add_argument("--ocr-language")
        c.add_argument("--ocr-dpi", type=int)
        c.add_argument("--recogniser", help="page image to text, as module:function")
        c.add_argument("--renderer", help="bytes and resolution to page images, as module:function")
        c.add_argument("--detector", help="documents and pages to doc_id and needs_ocr, as module:function")
        if name == "generate-toc":
            c.add_argument("--provider", help="inference, as module:function")
            c.add_argument("--bookmarks", help="bytes to bookmark rows (level, title, page), as module:function")
            c.add_argument("--refiner", help="second inference pass, as module:function")
            c.add_argument("--writer", help="bytes and bookmark rows to the document with them, as module:function; without it entries are written as JSON lines")
            c.add_argument("--vocabulary", help="tokenizers file or encoding that prompts are counted in; without it a quarter of the characters")
            c.add_argument("--postprocess", action="store_true", default=None)
            c.add_argument("--request-delay", type=float)
            c.add_argument("--show-token-usage", action="store_true", default=None)
    c = commands.add_parser("rename")
    c.add_argument("paths", nargs="*")
    c.add_argument("-f", "--input-file")
    c.add_argument("-q", "--query")
    c.add_argument("-y", "--yes", action="store_true", default=None)
    c.add_argument("--provider", required=True)
    c.add_argument("--vocabulary")
    c.add_argument("--request-delay", type=float)
    return p


def _spans(spark, path: str, page_parser: str):
    from strataleaf.sources import pages as source

    found = source.files(spark, path, "*")
    return found, source.spans_from_pages(source.parse_files(found, load_callable(page_parser)))


def _write(df, output: str | None, source_path: str) -> None:
    """Entries as JSON lines: to a folder, or beside the input by staging and moving."""
    if output:
        df.write.mode("overwrite").json(output)
        return
    target, staged = f"{source_path}.toc.json", tempfile.mkdtemp(prefix="strataleaf-")
    try:
        rows = df.orderBy("doc_id", "ordinal").toJSON().toLocalIterator()
        made = os.path.join(staged, "entries.json")
        with open(made, "w", encoding="utf-8") as f:
            f.writelines(f"{r}\n" for r in rows)
        if os.path.exists(target):
            replace_file(made, target)
        else:
            shutil.move(made, target)
    finally:
        shutil.rmtree(staged, ignore_errors=True)


def _write_files(df, output: str | None) -> None:
    """Files (path, content) into a folder, or over their sources; one is held at a time, none is left half written."""
    if output:
        os.makedirs(output, exist_ok=True)
    for row in df.select("path", "content").toLocalIterator():
        source_path = row.path.removeprefix("file:")
        target = os.path.join(output, os.path.basename(source_path)) if output else source_path
        made, staged = tempfile.mkstemp(prefix="strataleaf-")
        try:
            with open(made, "wb") as f:
                f.write(row.content)
            if os.path.exists(target):
                replace_file(staged, target)
            else:
                shutil.move(staged, target)
        finally:
            if os.path.exists(staged):
                os.unlink(staged)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    defaults = config.load_defaults(args.config)
    given = vars(args)
    option = lambda name, fallback=None: config.setting(name, args.command, given, defaults, fallback)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from strataleaf.functions.text import proxy_tokens
    from strataleaf.functions.tokens import text_counter, vocabulary_tokens
    from strataleaf.operators import batching, inference, ocr, rename, toc
    from strataleaf.plans import flows
    from strataleaf.session import work_folder
    from strataleaf.sources import pages as source
    from strataleaf.sources import paths as path_source

    if args.command == "rename":
        names = path_source.one_source(args.paths, args.input_file)
        if not option("query"):
            raise SystemExit("rename needs an instruction (--query)")
        spark = SparkSession.builder.getOrCreate()
        counted = vocabulary_tokens(args.vocabulary) if args.vocabulary else proxy_tokens
        listed = spark.createDataFrame(list(enumerate(names, 1)), "ordinal long, path string")
        with work_folder(spark) as work:
            plan = flows.plan_renames(listed, option("query"), load_callable(args.provider), work, delay=float(option("request_delay", inference.RENAME_DELAY)), tokens=counted)
            planned = plan.orderBy("ordinal").collect()
        for r in planned:
            print(f"{r.source} -> {r.target}  [{r.confidence}, {r.colour}] {r.reasoning}")
        if not planned or not (option("yes") or input("apply? [y/N] ").strip().lower() == "y"):
            return 0
        results = rename.apply_renames([(r.source, r.target) for r in planned])
        for source, _, status, error in results:
            if status == "failed":
                print(f"{source}: {error}", file=sys.stderr)
        return int(any(status == "failed" for _, _, status, _ in results))

    output = output_of(args.output, bool(option("inplace", False)))
    spark = SparkSession.builder.getOrCreate()
    documents, spans = _spans(spark, args.input, args.parser)
    if args.command == "extract-text":
        pages = spans.groupBy("doc_id", "page_number").agg(F.max(F.coalesce(F.trim("text") != "", F.lit(False))).alias("has_text"))
        dpi = int(option("ocr_dpi", ocr.DPI))
        if args.renderer:
            images = source.page_images(documents, load_callable(args.renderer), dpi)
        else:  # each file is the image of its one page
            images = documents.select("doc_id", F.lit(1).alias("page_number"), F.col("content").alias("image"))
        found = flows.recognised_text(documents, pages, images, load_callable(args.recogniser), bool(option("force", False)), load_callable(args.detector) if args.detector else None)
        _write(found.withColumnRenamed("page_number", "ordinal"), output, args.input)
        return 0
    provider = load_callable(args.provider) if args.provider else inference.heading_provider
    refiner = load_callable(args.refiner) if option("postprocess") and args.refiner else None
    if args.bookmarks and not option("force", False):
        marked = source.existing_contents(documents, load_callable(args.bookmarks))
        refused = marked.join(toc.check_no_existing(marked).select("doc_id"), "doc_id", "left_anti").select("path").limit(20).collect()
        if refused:
            raise SystemExit("these have a table of contents already (--force replaces it): " + ", ".join(r.path for r in refused))
    with work_folder(spark) as work:
        delay = float(option("request_delay", inference.TOC_DELAY if args.provider else 0.0))
        count = text_counter(args.vocabulary) if args.vocabulary else batching.proxy_count
        entries = flows.generate_contents(spans, provider, work, refiner, delay=delay, count=count)
        if args.writer:
            _write_files(source.with_contents(documents, entries, load_callable(args.writer)), output)
        else:
            _write(entries, output, args.input)
    return 0


if __name__ == "__main__":
    sys.exit(main())
