from pyspark.sql import functions as F

from strataleaf.operators import features, serialize
from strataleaf.sources import pages as source


def span(text, size=12.0, font="Times-Roman", y=80.0, flags=0):
    return {"font": font, "size": size, "text": text, "bbox": {"x0": 0.0, "y0": y, "x1": 1.0, "y1": 1.0} if y is not None else None, "flags": flags}


def block(*lines, kind=0):
    return {"type": kind, "lines": [{"spans": list(s)} for s in lines]}


def spans(spark, *pages):
    rows = [{"doc_id": 1, "page_number": n, "height": 800.0, "blocks": b} for n, b in enumerate(pages, 1)]
    return source.spans_from_pages(spark.createDataFrame(rows, source.PAGE))


def test_quota_and_projection(spark):
    page = [block([span("one")], [span("x" * 80, y=None)]), {"type": 1, "lines": None}, block([span("three", y=100.0)]), block([span("plain body text")]), block([span("more")])]
    got = features.extract(spans(spark, page)).orderBy(*features.ORDER).collect()
    assert [(r.block_ix, r.text_snippet, r.text_length, r.y_position) for r in got] == [(0, "one", 3, 0.1), (0, "x" * 50, 80, None), (2, "three", 5, 0.12)]


def test_lines_per_block(spark):
    page = [block(*[[span(str(i))] for i in range(8)])]
    assert features.extract(spans(spark, page)).count() == 5


def test_split_heading_is_merged(spark):
    page = [block([span("a")]), block([span("b")]), block([span("c")]), block([span("5.2", 16.0, "Times-Bold"), span("Convexity of Functions", 16.0, "Times-Bold")])]
    got = features.extract(spans(spark, page)).where("phase = 2").collect()
    assert [(r.text_snippet, r.is_bold, r.text_length) for r in got] == [("5.2 Convexity of Functions", True, 26)]


def test_candidate_cap(spark):
    page = [block([span("body text here")]) for _ in range(3)] + [block([span(f"Heading {i}", 20.0)]) for i in range(10)]
    got = features.extract(spans(spark, page)).where("phase = 2").orderBy("block_ix").collect()
    assert [r.text_snippet for r in got] == ["Heading 0", "Heading 1", "Heading 2"]


def test_relaxed_ratio_at_the_bottom(spark):
    base = [block([span("body text here")]) for _ in range(3)]
    low, high = block([span("Low heading", 12 * 1.16, y=600.0)]), block([span("High heading", 12 * 1.16, y=100.0)])
    got = features.extract(spans(spark, [*base, high, low])).where("phase = 2").collect()
    assert [r.text_snippet for r in got] == ["Low heading"]


def test_body_font(spark):
    page = [block([span("a"), span("b"), span("c"), span("d", 16.0, "Times-Bold")])]
    got = features.body_font(features.first_blocks(spans(spark, page))).first()
    assert (got.body_font, got.body_size) == ("Times-Roman", 12.0)
    tie = [block([span("a", 20.0, "F2"), span("b", 10.0, "F1")])]
    assert features.body_font(features.first_blocks(spans(spark, tie))).first().body_font == "F2"


def test_page_ranges(spark):
    want = {(10, 3): [0, 0, 0, 1, 1, 1, 2, 2, 2, 2], (10, 4): [0, 0, 1, 1, 2, 2, 3, 3, 3, 3], (7, 3): [0, 0, 1, 1, 2, 2, 2]}
    for (n, parts), expected in want.items():
        pages = spark.range(n).select(F.col("id").cast("int").alias("page_ix"), F.lit(n).alias("page_count"))
        assert [r.part for r in features.page_ranges(pages, parts).orderBy("page_ix").collect()] == expected


def test_serialize(spark):
    page = [block([span("Chapter 1", 14.0, "ABCDEF+Times-Bold", 96.0), span("text", 12.5, "Times", None)])]
    two = [block([span("next", 12.0, "Times-Bold", 40.0)])]
    got = serialize.serialize(features.extract(spans(spark, page, two))).first().text
    assert got == "FONTS:\nF0=Times-Bold\nF1=Times\n\nP1:\nF0|14|Chapter 1|.12|B\nF1|12.5|text\nP2:\nF0|12|next|.05|B"


def test_summary_samples_all_pages(spark):
    got = serialize.summary(features.extract(spans(spark, *[[block([span(f"page {i} text")])] for i in range(500)])), 50).first().text.split("\n")
    assert len(got) == 50 and got[0].startswith("P1@") and int(got[-1].split("@")[0][1:]) >= 490


def test_even_sample_places(spark):
    for n, k in [(10, 3), (7, 7), (7, 9), (100, 7), (5, 1), (97, 31)]:
        rows = spark.range(n).select(F.lit(0).alias("g"), F.col("id"))
        got = sorted(r.id for r in serialize.even_sample(rows, ["g"], ["id"], k).collect())
        assert got == (list(range(n)) if n <= k else [int(i * (n / k)) for i in range(k)])


def test_plain_text_and_blocks(spark):
    page = [block([span("a"), span("b")], [span("c")])]
    s = spans(spark, page)
    assert source.plain_text(s).first().text == "ab\nc"
    row = source.block_table(s).first()
    assert (row.text, row.y) == ("a b c", 0.1)
