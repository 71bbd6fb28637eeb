import pytest
from pyspark.sql import functions as F

from strataleaf.functions import text as t


def values(spark, inputs, fn):
    df = spark.createDataFrame(list(enumerate(inputs)), "i int, x string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


def check(spark, pairs, fn):
    assert values(spark, [p[0] for p in pairs], fn) == [p[1] for p in pairs]


def test_normalize_snippet(spark):
    check(
        spark,
        [
            ("3.2 Precision and Accuracy", "precision and accuracy"),
            ("  Chapter 1: Overview  ", "chapter 1 overview"),
            ("FLOATING-POINT COMPUTATION", "floatingpoint computation"),
            ("1) First Item", "first item"),
            ("", ""),
            ("  2 lead", "2 lead"),
            ("Éclair – déjà_vu", "éclair déjà_vu"),
        ],
        t.normalize_snippet,
    )


def test_subset_prefix(spark):
    check(spark, [("ABCDEF+TimesNewRomanPS-BoldMT", "TimesNewRomanPS-BoldMT"), ("ABCDEF+", ""), ("abcdef+Times", "abcdef+Times")], t.strip_subset_prefix)


def test_section_number(spark):
    yes = ["I THE SAMPLE SPACE", "XIV RANDOM VARIABLES", "IV. Some Section", "I went to the store", "1. Intro", "1.2 X", "Chapter 3 Overview", "Part of it", ". x", "vi editor", "C H A P T E R  I"]
    assert all(values(spark, yes, t.is_section_number))
    assert not any(values(spark, ["The quick brown fox"], t.is_section_number))
    check(spark, [("P R E F A C E", True), ("The quick", False), ("p r e f a c e", False)], t.is_letterspaced)


def test_front_matter(spark):
    check(
        spark,
        [("preface to first edition", True), ("contents of volume ii", True), ("introduction to probability", False), ("chapter 1", False), ("introduction to the second edition", True)],
        t.is_front_matter,
    )


def test_prefixes(spark):
    check(spark, [("6.6 Title", "6.6"), ("6 Title", None), (" 1.2.3 x", "1.2.3")], t.section_prefix)
    check(spark, [("Appendix 9A Derivation", "Derivation"), ("Derivation", "Derivation")], t.without_appendix)


def test_toc_lines(spark):
    long = "This is an ordinary sentence of prose that is rather long and goes on and on, well beyond one hundred characters."
    check(spark, [(f"Intro ........ 5\n\nChapter\t12\n{long}\nshort", "Intro ........ 5\nChapter\t12\nshort")], t.toc_like_lines)


@pytest.mark.parametrize(
    ("font", "flags", "bold"), [("Times-Bold", 0, True), ("Times-Roman", 16, True), ("Helvetica", 4, False), (None, None, False)]
)
def test_bold(spark, font, flags, bold):
    row = spark.createDataFrame([(font, flags)], "f string, g int").select(t.is_bold(F.col("f"), F.col("g"))).first()
    assert row[0] is bold


@pytest.mark.parametrize(
    ("text", "size", "bold", "is_heading"),
    [
        ("Chapter Title", 16.0, True, True),
        ("Bold body", 12.0, True, True),
        ("1.2 Subsection Title", 10.0, False, True),
        ("Chapter 3 Overview", 10.0, False, True),
        ("Just ordinary body text here", 12.0, False, False),
        ("Ab", 16.0, True, False),
        ("x" * 201, 16.0, True, False),
        ("random words", 10.0, False, False),
    ],
)
def test_heading(spark, text, size, bold, is_heading):
    df = spark.createDataFrame([(text, size, bold)], "t string, s double, b boolean")
    assert df.select(t.is_heading(F.col("t"), F.col("s"), F.col("b"), F.lit(12.0), 1.15)).first()[0] is is_heading


def test_heading_ratio(spark):
    df = spark.createDataFrame([("Heading words", 1.16 * 12)], "t string, s double")
    got = df.select(*[t.is_heading(F.col("t"), F.col("s"), F.lit(False), F.lit(12.0), r) for r in (1.15, 1.2)]).first()
    assert list(got) == [True, False]


def test_round_exact(spark):
    xs = [0.125, 2.675, 0.135, 0.145, 0.285, 0.005, 0.615, 0.375, 0.0, 1.0, 0.995] + [i / 997 for i in range(997)]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(xs)), "i int, x double").orderBy("i").select(t.round_exact(F.col("x"), 2)).collect()]
    assert got == [round(x, 2) for x in xs]


def test_formats(spark):
    df = spark.createDataFrame([(14.0, 0.12), (12.5, 0.0), (9.96, 1.0), (7.25, 0.05)], "s double, y double")
    got = df.select(t.format_size(F.col("s")), t.format_y(F.col("y"))).collect()
    assert [tuple(r) for r in got] == [("14", ".12"), ("12.5", ".00"), ("10.0", "1.00"), ("7.2", ".05")]


@pytest.mark.parametrize(
    ("title", "text", "same"),
    [
        ("Convexity", "5.2 Convexity of Functions", True),
        ("6.6 Risk", "Risk", False),
        ("6.6 Risk", "16.6 Risk", True),
        ("Appendix 9A Derivation of the Result", "Derivation of the Result", True),
        ("Ab", "Ab", False),
        ("The Sample Space", "The Sample", True),
    ],
)
def test_heading_matches(spark, title, text, same):
    df = spark.createDataFrame([(title, text)], "title string, text string")
    got = df.select(
        t.heading_matches(F.col("title"), t.normalize_snippet(F.col("title")), t.normalize_snippet(t.without_appendix(F.col("title"))), t.normalize_snippet(F.col("text")), t.normalize_title(F.col("text")))
    ).first()[0]
    assert got is same
