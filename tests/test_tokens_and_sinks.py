import json
import os

import pytest
from pyspark.sql import functions as F

from strataleaf import cli, config
from strataleaf.functions import tokens
from strataleaf.operators import batching, correction, inference, ocr, rename, serialize, toc
from strataleaf.sources import pages as source

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
with_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")


def feature_rows(spark):
    rows = [(1, 1, 1, b, n, s, "F", 12.0, 5, f"words {b} {n} {s}", 0.5, s == 0) for b in range(12) for n in range(2) for s in range(2)]
    return spark.createDataFrame(rows, "doc_id long, page_number int, phase int, block_ix int, line_ix int, span_ix int, font_name string, font_size double, text_length int, text_snippet string, y_position double, is_bold boolean")


@with_vocabulary
def test_counts_are_those_of_the_vocabulary(spark):
    from tokenizers import Tokenizer

    held = Tokenizer.from_file(VOCABULARY)
    texts = ["", None, "hello", "a" * 100, "two words\n\tand ½ ä 日本", "x" * 20_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", tokens.vocabulary_tokens(VOCABULARY)(F.col("t")).alias("n")).collect()}
    want = [len(held.encode(t, add_special_tokens=False).ids) if t else 0 for t in texts]
    assert [got[i] for i in range(len(texts))] == want
    assert tokens.text_counter(VOCABULARY)("hello") == 1
    assert tokens.text_counter(VOCABULARY)("<|endoftext|>") > 1


@with_vocabulary
def test_estimates_take_a_vocabulary(spark):
    count, one = tokens.vocabulary_tokens(VOCABULARY), tokens.text_counter(VOCABULARY)
    feats = feature_rows(spark)
    text = serialize.feature_list_text(feats).first().text
    assert text.count("[[(") == 12 and text.index("words 2 0 0") < text.index("words 10 0 0")
    assert serialize.feature_list_tokens(feats, count).first().tokens == one(text)
    assert serialize.feature_list_tokens(feats).first().tokens == -(-len(text) // 4)
    first = serialize.block_tokens(feats, count).where("block_ix = 0").first().tokens
    assert first == one("\n".join(["P1:", *(f"F0|12|words 0 {n} {s}|.12|B" for n in range(2) for s in range(2))]))
    names = spark.createDataFrame([(0, i, f"name {i}.pdf") for i in range(40)], "k long, i long, name string")
    assert batching.name_batches(names, "k", "i", batching.NAME_OVERHEAD + 50, count).agg(F.max("batch_ix")).first()[0] > 1


def test_concatenated_parts(spark):
    rows = [(1, p, n, f"{p}.{n}") for p, k in ((2, 3), (0, 2), (5, 1)) for n in range(1, k + 1)] + [(2, 9, 1, "alone")]
    got = source.concatenated(spark.createDataFrame(rows, "doc_id long, part int, page_number int, text string")).orderBy("doc_id", "page_number").collect()
    assert [(r.page_number, r.text) for r in got] == [(1, "0.1"), (2, "0.2"), (3, "2.1"), (4, "2.2"), (5, "2.3"), (6, "5.1"), (1, "alone")]


def test_transplant_and_writer(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"original")
    (tmp_path / "b.bin").write_bytes(b"bare")
    files = source.files(spark, str(tmp_path), "*.bin")
    target = files.where("path LIKE '%a.bin'").first().doc_id
    entries = spark.createDataFrame([(7, 2, "Second", 4, 1, 0.5), (7, 1, "First", 2, 1, 0.9), (8, 1, "Other", 1, 1, 0.9)], "doc_id long, ordinal long, title string, page_number int, level int, confidence double")
    moved = toc.transplant(entries, spark.createDataFrame([(7, target)], "copy_id long, doc_id long"))
    assert moved.columns == entries.columns and {r.doc_id for r in moved.collect()} == {target}
    made = source.with_contents(files, moved, lambda content, rows: content + json.dumps(rows).encode())
    cli._write_files(made, str(tmp_path / "out"))
    assert (tmp_path / "out" / "a.bin").read_bytes() == b'original[[1, "First", 2], [1, "Second", 4]]'
    assert (tmp_path / "out" / "b.bin").read_bytes() == b"bare[]"
    assert (tmp_path / "a.bin").read_bytes() == b"original"
    cli._write_files(made.where("path LIKE '%a.bin'"), None)
    assert (tmp_path / "a.bin").read_bytes().startswith(b"original[[")


def test_correction_counts(spark):
    kind = "doc_id long, ordinal long, page_number int"
    before = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 3)], kind)
    after = spark.createDataFrame([(1, 1, 4), (1, 2, 6), (2, 1, 3)], kind)
    assert {tuple(r) for r in correction.correction_counts(before, after).collect()} == {(1, 2, 1), (2, 1, 0)}


def test_display(spark):
    resolved = spark.createDataFrame([(1, "/d/a", "/d/b"), (2, "/d/c", "/d/e")], "ordinal long, source string, target string")
    ops = spark.createDataFrame([(1, "a", "b", 0.2, "old"), (3, "a", "b", 0.955, "why " * 20)], "ordinal long, input_filename string, output_filename string, confidence double, reasoning string")
    got = {r.ordinal: r for r in rename.display(resolved, ops).collect()}
    assert (got[1].confidence, got[1].colour) == (f"{0.955:.0%}", "green") and got[1].reasoning.endswith("...") and len(got[1].reasoning) == 53
    assert (got[2].confidence, got[2].colour, got[2].reasoning) == ("N/A", "red", "")


def test_detection_can_be_replaced(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    pages = spark.createDataFrame([(1, 1, True), (2, 1, True)], "doc_id long, page_number int, has_text boolean")
    images = spark.createDataFrame([(1, 1, b"x"), (2, 1, b"y")], "doc_id long, page_number int, image binary")
    second = lambda d, p: d.withColumn("needs_ocr", F.col("doc_id") == 2)
    assert [r.doc_id for r in ocr.extract_text(docs, pages, images, lambda _: "t", detect=second).collect()] == [2]


def test_failed_attempts_are_told(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inference, "FIRST_WAIT", 0.0)
    told = tmp_path / "told"
    wanted = spark.createDataFrame([(1, 1, "s", "t")], "doc_id long, batch_ix long, system string, text string")

    def provider(system, text):
        if not told.exists():
            raise ValueError("busy")
        return [{"title": "T", "page_number": 1, "level": 1, "confidence": 1.0}]

    def log(line):
        with told.open("a") as f:
            f.write(line)

    answer = inference.with_retry(lambda: provider("s", "t"), sleep=lambda _: None, log=log)
    assert answer and told.read_text().startswith("attempt 1/5 failed (busy)")
    assert inference.infer(wanted, provider, inference.ENTRY_SCHEMA, str(tmp_path / "w"), log=log).count() == 1


def test_settings_have_kinds():
    assert config.defaults_of({"generate-toc": {"request-delay": 3, "ocr-dpi": 200}}) == {"generate-toc": {"request_delay": 3, "ocr_dpi": 200}}
    for wrong in ({"generate-toc": {"ocr-dpi": "300"}}, {"rename": {"yes": 1}}, {"global": {"show-token-usage": "no"}}, {"extract-text": {"ocr-dpi": True}}):
        with pytest.raises(config.ConfigError, match="type"):
            config.defaults_of(wrong)
