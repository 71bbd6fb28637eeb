from pyspark.sql import functions as F

from strataleaf.operators import correction, offsets

ENTRY = "doc_id long, ordinal long, title string, page_number long, level int, confidence double"


def entries(spark, rows):
    return spark.createDataFrame([(1, i, t, p, v, 1.0) for i, (t, p, v) in enumerate(rows)], ENTRY)


def offset(spark, rows, printed=None):
    lines = None
    if printed is not None:
        lines = offsets.printed_entries(spark.createDataFrame([(1, i, x) for i, x in enumerate(printed)], "doc_id long, line_no int, line string"))
    return offsets.front_matter_offset(entries(spark, rows), lines).first().offset


def test_anchor_offset(spark):
    assert offset(spark, [("Table of Contents", 3, 1), ("Introduction", 16, 1), ("Chapter I", 17, 1)]) == 16
    assert offset(spark, [("Contents", 10, 1), ("Preface", 12, 1), ("Introduction", 16, 1), ("Chapter I", 18, 1)]) == 17
    assert offset(spark, [("Chapter I", 6, 1)]) == 5
    assert offset(spark, [("Chapter I", 3, 1)]) == 0


def test_reference_offset(spark):
    titles = ["Introduction to Methods", "Foundations of Theory", "Random Variables Here", "Limits and Convergence"]
    rows = list(zip(titles, [25, 27, 30, 55], [1] * 4, strict=True))
    printed = [f"{t} ..... {p}" for t, p in zip(titles, [1, 3, 6, 31], strict=True)]
    assert offset(spark, rows, printed) == 24
    assert offset(spark, rows, printed[:1]) == 24  # one line is not enough; the anchor gives 25 - 1


def test_printed_entries(spark):
    lines = spark.createDataFrame([(1, 0, "  Stochastic Calculus . . . . 12 "), (1, 1, "No number here"), (1, 2, "Tabbed Title Here\t7"), (1, 3, "ab ..... 3")], "doc_id long, line_no int, line string")
    got = [(r.title, r.printed_page) for r in offsets.printed_entries(lines).orderBy("line_no").collect()]
    assert got == [("Stochastic Calculus", 12), ("Tabbed Title Here", 7)]


def test_offset_note(spark):
    a, b = spark.range(1).select(offsets.offset_note(F.lit(2)), offsets.offset_note(F.lit(15))).first()
    assert a == "" and "PDF page 16" in b and "adding 15" in b and "N + 15" in b


def restore(spark, original, refined):
    got = correction.restore_pages(entries(spark, refined), entries(spark, original)).orderBy("ordinal").collect()
    return [r.page_number for r in got]


def test_restore_pages(spark):
    assert restore(spark, [("One", 16, 1), ("Two", 22, 1), ("Three", 41, 1)], [("One", 1, 1), ("Two", 7, 1), ("Three", 26, 1)]) == [16, 22, 41]
    both = [("Introduction", 10, 1), ("2 Introduction to Ito-Calculus", 24, 1)]
    assert restore(spark, both, [("2 Introduction to Ito-Calculus", 9, 1)]) == [24]
    assert restore(spark, [("The Sample Space", 9, 1)], [("The Sample Space Extended", 1, 1)]) == [9]
    assert restore(spark, [("Introduction", 9, 1)], [("2 Introduction to Ito-Calculus", 1, 1)]) == [1]
    assert restore(spark, [("Same Title", 9, 1)], [("Same Title", 2, 2)]) == [2]


FEATURE = "doc_id long, page_number long, ordinal long, y_position double, text_snippet string"
BLOCK = "doc_id long, page_number long, block_ix int, y double, text string"


def test_running_header(spark):
    feats = spark.createDataFrame([(1, 5, 1, 0.82, "Stopping Times"), (1, 6, 2, 0.03, "Stopping Times"), (1, 6, 3, 0.5, "body of text")], FEATURE)
    assert correction.correct_running_headers(entries(spark, [("Stopping Times", 6, 1)]), feats).first().page_number == 5
    header_only = spark.createDataFrame([(1, 8, 2, 0.03, "Stopping Times"), (1, 8, 3, 0.5, "body")], FEATURE)
    e = entries(spark, [("Stopping Times", 8, 1)])
    assert correction.correct_running_headers(e, header_only).first().page_number == 8
    blocks = spark.createDataFrame([(1, 7, 0, 0.7, "Stopping Times")], BLOCK)
    assert correction.correct_running_headers(e, header_only, blocks).first().page_number == 7


def test_nearest_heading(spark):
    rows = [(1, p, 0, 0.02, "Optimal Stopping") for p in range(16, 35)] + [(1, 20, 1, 0.4, "Optimal Stopping"), (1, 32, 1, 0.4, "Optimal Stopping")]
    blocks = spark.createDataFrame(rows, BLOCK)
    wanted = spark.createDataFrame([(1, 0, "Optimal Stopping", 16, 35, 25)], "doc_id long, ordinal long, title string, start_page long, end_page long, hint_page long")
    assert correction.nearest_heading(wanted, blocks).first().found_page == 20
    tie = spark.createDataFrame([(1, 20, 1, 0.4, "Optimal Stopping"), (1, 30, 1, 0.4, "Optimal Stopping")], BLOCK)
    assert correction.nearest_heading(wanted, tie).first().found_page == 30


def test_verify_applies_only_with_an_offset(spark):
    blocks = spark.createDataFrame([(1, 25, 0, 0.3, "Brownian Motion")], BLOCK)
    e = entries(spark, [("Brownian Motion", 10, 1)])
    counts = spark.createDataFrame([(1, 600)], "doc_id long, page_count long")
    for shift, want in [(15, 25), (2, 10)]:
        offs = spark.createDataFrame([(1, shift)], "doc_id long, offset long")
        assert correction.verify_pages(e, offs, blocks, counts).first().page_number == want


def test_section_prefix_and_page_search(spark):
    pages = spark.createDataFrame([(1, 297, "Optimal control of systems"), (1, 321, "6.6 Optimal control of systems")], "doc_id long, page_number long, text string")
    e = entries(spark, [("6.6 Optimal control of systems", 297, 1), ("6.6 Optimal control of systems", 320, 1)])
    assert [r.page_number for r in correction.page_contains_heading(e, pages).collect()] == [320]


def test_reference_text(spark):
    pages = spark.createDataFrame([(1, 1, "Title\npage"), (1, 2, "  "), (1, 4, "Intro .... 3\n" + "long prose " * 20)], "doc_id long, page_number long, text string")
    assert offsets.reference_text(pages).first().text == "--- Page 1 ---\nTitle\npage\n\n--- Page 4 ---\nIntro .... 3"
