import json
import os
import random

import pytest
from pyspark.sql import functions as F

from strataleaf import cli, config
from strataleaf.operators import batching, inference, ocr, rename, toc, usage
from strataleaf.plans import flows
from strataleaf.sources import pages as source
from strataleaf.session import work_folder
from strataleaf.sources import paths
from strataleaf.streaming import pages as streams
from test_features import block, span


def test_name_batches(spark):
    names = spark.createDataFrame([(0, i, "n" * 100) for i in range(100)], "g long, o long, name string")
    got = batching.name_batches(names, "g", "o", batching.NAME_OVERHEAD + 100).orderBy("o").collect()
    assert [r.batch_ix for r in got] == [i // 3 + 1 for i in range(100)]
    before = batching.files_before(spark.createDataFrame(got), "g").orderBy("batch_ix").collect()
    assert [r.files_before for r in before] == [3 * i for i in range(34)]


def test_overlapping_batches():
    assert batching.overlapping_batches([], lambda a, b: 0, 10, 5) == [(0, 0)]
    assert batching.overlapping_batches([4, 4, 4, 4], lambda a, b: 4 * (b - a), 8, 1) == [(0, 2), (1, 3), (2, 4)]
    assert batching.overlapping_batches([9], lambda a, b: 0, -1, 5) == [(0, 1)]


def test_coverage(spark):
    cases = [(24, 100, 0.25, True), (25, 100, 0.25, False), (1, 10, 0.0, False), (0, 10, 0.0, True), (9, 10, 0.9, False), (8, 10, 0.9, True)]
    for hits, n, least, want in cases:
        pages = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") + 1).alias("page_number"), (F.col("id") < hits).alias("has_text"))
        assert ocr.needs_ocr(pages, pages, least).first().needs_ocr is want
    docs = spark.createDataFrame([(7,)], "doc_id long")
    assert ocr.needs_ocr(docs, pages.where("false")).first().needs_ocr is True
    late = spark.range(100).select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") + 1).alias("page_number"), (F.col("id") > 0).alias("has_text"))
    assert [ocr.needs_ocr(late, late, sample_pages=s).first().needs_ocr for s in (1, 5)] == [True, False]


def test_page_has_text_and_recognition(spark):
    rows = [{"doc_id": 1, "page_number": n, "height": 800.0, "blocks": b} for n, b in enumerate([[block([span("a")])], [block([span("  ")])], [{"type": 1, "lines": None}], [{"type": 0, "lines": None}]], 1)]
    pages = spark.createDataFrame(rows, source.PAGE).withColumn("has_text", ocr.page_has_text(F.col("blocks")))
    assert [r.has_text for r in pages.orderBy("page_number").collect()] == [True, False, False, False]
    images = pages.select("doc_id", "page_number", F.lit(None).cast("binary").alias("image"))
    docs = pages.select("doc_id").distinct()
    seen = ocr.extract_text(docs, pages.where("page_number > 1"), images, lambda _: "seen")
    assert [r.page_number for r in seen.orderBy("page_number").collect()] == [1, 2, 3, 4]
    assert ocr.extract_text(docs, pages, images, lambda _: "seen").count() == 0
    assert ocr.extract_text(docs, pages, images, lambda _: "seen", force=True).count() == 4


def test_renames(spark, tmp_path):
    listed = rename.paths_with_names(spark.createDataFrame([("/a/x.pdf",), ("/b/y.pdf",)], "path string"))
    ops = spark.createDataFrame([(1, "x.pdf", "new.pdf", 0.9), (2, "y.pdf", "y.pdf", 0.9), (3, "z.pdf", "q.pdf", 0.9)], "ordinal int, input_filename string, output_filename string, confidence double")
    assert [tuple(r) for r in rename.resolve(ops, listed).collect()] == [(1, "/a/x.pdf", "/a/new.pdf")]
    with pytest.raises(Exception, match="duplicate filename"):
        rename.checked_paths(spark.createDataFrame([("/a/x",), ("/b/x",)], "path string")).collect()
    with pytest.raises(Exception, match="confidence"):
        rename.valid_operations(ops.withColumn("confidence", F.lit(1.5))).collect()
    a, b, c = (str(tmp_path / n) for n in "abc")
    for p in (a, c):
        open(p, "w").close()
    got = rename.apply_renames([(b, a), (a, c), (a, b)])
    assert [r[2] for r in got] == ["failed", "failed", "ok"] and os.path.exists(b)


def test_retry():
    class Status(Exception):
        def __init__(self, code):
            self.status_code = code

    assert [inference.is_retryable(Status(c)) for c in (429, 500, 502, 503, 400, 401, 403, 404, 422)] == [True] * 4 + [False] * 5
    assert not inference.is_retryable(type("ContextOverflowError", (Exception,), {})())
    waits, left = [], [3]

    def call():
        left[0] -= 1
        if left[0]:
            raise Status(500)
        return [{}]

    assert inference.with_retry(call, sleep=waits.append) == [{}] and waits == [10.0, 20.0]
    with pytest.raises(Status):
        inference.with_retry(lambda: (_ for _ in ()).throw(Status(400)), sleep=waits.append)


def pages_df(spark):
    docs = []
    for d in (1, 2):
        for n in range(1, 5):
            docs.append({"doc_id": d, "page_number": n, "height": 800.0, "blocks": [block([span(f"Chapter {n} of book {d}", 20.0, "Times-Bold")]), block([span("ordinary words of the text")], [span("and some more of them")])]})
    return spark.createDataFrame(docs, source.PAGE)


def test_generate_contents(spark, tmp_path):
    spans = source.spans_from_pages(pages_df(spark))
    got = flows.generate_contents(spans, inference.heading_provider, str(tmp_path / "w"))
    rows = [(r.doc_id, r.title, r.page_number, r.level) for r in got.orderBy("doc_id", "ordinal").collect()]
    assert rows == [(d, f"Chapter {n} of book {d}", n, 1) for d in (1, 2) for n in range(1, 5)]
    small = flows.generate_contents(spans, inference.heading_provider, str(tmp_path / "s"), max_tokens=batching.FEATURE_OVERHEAD + 40, overlap=1)
    assert {(r.doc_id, r.page_number) for r in small.collect()} == {(d, n) for d in (1, 2) for n in range(1, 5)}


def test_refined_contents(spark, tmp_path):
    def refine(system, text):
        return [{"title": "Chapter 2 of book 1", "page_number": 9, "level": 1, "confidence": 0.5}]

    spans = source.spans_from_pages(pages_df(spark).where("doc_id = 1"))
    got = flows.generate_contents(spans, inference.heading_provider, str(tmp_path / "w"), refine)
    assert [(r.title, r.page_number) for r in got.collect()] == [("Chapter 2 of book 1", 2)]


def test_plan_renames(spark, tmp_path):
    listed = spark.createDataFrame([(i, f"/d/f{i}.pdf") for i in range(5)], "ordinal long, path string")

    def provider(system, text):
        names = [x[2:] for x in text.splitlines() if x.startswith("- ")]
        return [{"input_filename": n, "output_filename": "new_" + n, "confidence": 0.8, "reasoning": ""} for n in names]

    got = flows.plan_renames(listed, "prefix all", provider, str(tmp_path)).orderBy("ordinal").collect()
    assert [r.target for r in got] == [f"/d/new_f{i}.pdf" for i in range(5)]


def test_usage(spark):
    calls = spark.createDataFrame([(1, 1, 1000, 5), (1, 2, 2000, 7)], "k int, ordinal int, input_tokens long, output_tokens long")
    total = usage.total(calls, ["k"])
    assert tuple(total.first()) == (1, 3000, 12, 2, 3012)
    assert usage.report(total, ["k"]).first().line == "calls: 2, input: 3,000, output: 12, total: 3,012"


def test_config(tmp_path):
    f = tmp_path / "strataleaf.toml"
    f.write_text('[global]\nmodel-identifier = "m"\n[rename]\nmodel-identifier = "r"\nyes = true\n[extract-text]\nocr-dpi = 150\n')
    d = config.load_defaults(f)
    assert d == {"generate-toc": {"model_identifier": "m"}, "extract-text": {"ocr_dpi": 150}, "rename": {"model_identifier": "r", "yes": True}}
    assert config.setting("yes", "rename", {"yes": False}, d) is False and config.setting("query", "rename", {}, d, "q") == "q"
    assert config.load_defaults(f, {"rename": {"yes": False}})["rename"]["yes"] is False
    f.write_text("[nonsense]\n")
    with pytest.raises(config.ConfigError):
        config.load_defaults(f)
    assert config.find_config(tmp_path) == f


def test_paths(spark, tmp_path):
    f = tmp_path / "list"
    f.write_text(f"# comment\n\n  {f}  \n")
    assert paths.checked_path_list(str(f)) == [str(f)]
    assert [r.path for r in paths.read_path_list(spark, str(f)).collect()] == [str(f)]
    f.write_text("\n/no/such/file\n")
    with pytest.raises(FileNotFoundError, match="line 2"):
        paths.checked_path_list(str(f))
    with pytest.raises(ValueError, match="either"):
        paths.one_source([], None)
    with pytest.raises(SystemExit):
        cli.output_of("x", True)
    made, target = tmp_path / "m", tmp_path / "t"
    made.write_text("new")
    target.write_text("old")
    os.chmod(target, 0o640)
    cli.replace_file(str(made), str(target))
    assert target.read_text() == "new" and os.stat(target).st_mode & 0o777 == 0o640


def a_book(n_pages):
    span = lambda text, size: {"font": "F", "size": size, "text": text, "bbox": {"x0": 0.0, "y0": 10.0, "x1": 1.0, "y1": 2.0}, "flags": 0}
    return [{"height": 100.0, "blocks": [{"type": 0, "lines": [{"spans": [span(f"Heading of page {n}", 20.0)]}]}] + [{"type": 0, "lines": [{"spans": [span("plain words", 10.0)]}]}] * 2} for n in range(1, n_pages + 1)]


def test_contents_command(spark, tmp_path):
    """Files through a parser (here json.loads) to entries as JSON lines; the work folder is gone afterwards."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_text(json.dumps(a_book(3)))
    out = tmp_path / "out"
    assert cli.main(["generate-toc", str(tmp_path / "in"), str(out), "--parser", "json:loads"]) == 0
    rows = sorted((json.loads(x) for f in out.glob("part-*.json") for x in f.read_text().splitlines()), key=lambda r: r["ordinal"])
    assert [(r["title"], r["page_number"], r["level"]) for r in rows] == [(f"Heading of page {n}", n, 1) for n in (1, 2, 3)]
    with work_folder(spark) as work:
        spark.range(3).write.parquet(f"{work}/x")
        assert os.path.exists(f"{work.removeprefix('file:')}/x")
    assert not os.path.exists(work.removeprefix("file:"))


def test_existing_contents_and_page_images(spark):
    files = spark.createDataFrame([(1, "a", b"x"), (2, "b", b"")], "doc_id long, path string, content binary")
    marked = source.existing_contents(files, lambda content: [(1, "T", 4)] if content else [])
    assert [r.path for r in toc.check_no_existing(marked).collect()] == ["b"]
    assert toc.check_no_existing(marked, force=True).count() == 2
    made = source.page_images(files, lambda content, dpi: [b"%d" % dpi] * 3 if content else [], 150).orderBy("page_number").collect()
    assert [(r.doc_id, r.page_number, bytes(r.image)) for r in made] == [(1, n, b"150") for n in (1, 2, 3)]


def test_batches_equal_the_fold(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.choice([0, 1, 5, 30, 99, 250])) for k in (1, None, 3) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, i long, n long")
    got = {(r.k, r.i): r.batch_ix for r in batching.greedy_batches(df.where("k IS NOT NULL"), "k", "i", F.col("n"), 100).collect()}
    for k in (1, 3):
        batch, used = 1, 0
        for _, i, n in sorted(r for r in rows if r[0] == k):
            if used + n > 100 and used > 0:
                batch, used = batch + 1, 0
            used += n
            assert got[k, i] == batch


def test_stream(spark, tmp_path):
    rows = [r.asDict(recursive=True) for r in pages_df(spark).collect()]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(r) for r in rows))
    stream = streams.page_stream(spark, str(tmp_path / "in"))
    assert streams.feature_stream(stream).isStreaming
    q = streams.write_contents(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8
