"""Nulls, repeated rows, ties, long texts, empty tables and clashing columns, for each operator."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strataleaf.llm import chat_format, decontaminate, html_extract, jaccard_join, language_id, license_scan, packing, pii, substring_dedup, vptree
from test_search_and_text import VOCABULARY

#: Names that operators use inside or put out.
CLASHING = ("rep", "key", "n", "point", "lang_pred", "score", "spans", "license_id", "sequence_id", "component_id", "piece", "h", "_h", "_bits", "digest", "r")
LONG = "der lange Text steht hier und wird nie gekappt . " * 8000
TEXTS = [(1, "alpha beta gamma delta epsilon zeta"), (1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, ""), (4, "  \n\t "), (5, "alpha beta gamma delta epsilon zeta"), (6, LONG), (6, LONG), (7, "12 34"), (None, "mail me@example.org")]


def clashing(df):
    for name in CLASHING:
        if name not in df.columns:
            df = df.withColumn(name, F.lit("clash"))
    return df


def docs_of(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    langs = F.when(F.col("doc_id") == 6, "de").when(F.col("doc_id") == 1, "la")
    return clashing(df.withColumn("lang", langs).withColumn("source", F.lit(None).cast("string")))


def plain(rows, *names):
    return Counter(tuple(r[n] for n in names) for r in rows)


RUNS = {
    "language": lambda d: language_id.identify(d, language_id.fit(d)),
    "jaccard": jaccard_join.join,
    "dedup": substring_dedup.dedup,
    "packing": lambda d: packing.pack(d, VOCABULARY),
    "pii": pii.find,
    "licence": license_scan.scan,
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_document_operators_take_empty_tables(spark, name):
    assert RUNS[name](docs_of(spark).where("false")).count() == 0


def test_language(spark):
    got = RUNS["language"](docs_of(spark)).collect()
    assert len(got) == len(TEXTS)
    assert {(r.doc_id, r.lang_pred) for r in got if r.doc_id in (2, 3, 4, 7)} == {(d, "und") for d in (2, 3, 4, 7)}
    assert all(0 <= r.score <= 1 for r in got)


def test_jaccard(spark):
    got = plain(RUNS["jaccard"](docs_of(spark).where("doc_id IS NOT NULL")).collect(), "doc_id", "n_shingles", "component_id")
    assert got == Counter({(1, 3, 1): 2, (2, 0, 2): 1, (3, 0, 3): 1, (4, 0, 4): 1, (5, 3, 1): 1, (6, 10, 6): 2, (7, 1, 7): 1})


def test_packing_of_repeated_rows(spark):
    got = RUNS["packing"](docs_of(spark).where("doc_id IS NOT NULL")).collect()
    ids = packing.encoder(VOCABULARY)
    for d, copies in ((1, 2), (2, 1), (3, 1), (6, 2)):
        text = dict(TEXTS)[d] or ""
        pieces = [r for r in got if r.doc_id == d]
        assert sum(r.length for r in pieces) == copies * (len(ids(text)) + 1)
        assert {r.doc_tokens for r in pieces} == {len(ids(text)) + 1}
    assert [r.ids_crc32 for r in got if r.doc_id == 2] == [zlib.crc32(bytes(4))]
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    ends = {}
    for s, at, n in places:
        assert at == ends.get(s, 0) and at + n <= 1024
        ends[s] = at + n


def test_dedup_of_repeated_rows(spark):
    got = {r.doc_id: r for r in RUNS["dedup"](docs_of(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert [(got[d].n_bytes, got[d].n_removed, got[d].kept_sha256) for d in (2, 3)] == [(0, 0, empty)] * 2
    unit = len(LONG) // 8000
    # The text has a period of one sentence, so all but the first sentence repeats.
    assert (got[6].n_bytes, got[6].n_removed, got[6].n_spans) == (len(LONG), len(LONG) - unit, 1)
    assert got[6].kept_sha256 == hashlib.sha256(LONG[:unit].encode()).hexdigest()


def test_pii(spark):
    got = RUNS["pii"](docs_of(spark)).collect()
    assert len(got) == len(TEXTS)
    assert [r.n_email for r in got if r.doc_id is None] == [1] and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got) == 1
    assert {r.base_sha256 for r in got if r.doc_id in (2, 3)} == {hashlib.sha256(b"").hexdigest()}
    kept = pii.redact(docs_of(spark))
    assert kept.columns == docs_of(spark).columns and kept.count() == len(TEXTS) and kept.where("text IS NULL").count() == 1


def test_licence_with_clashing_columns(spark):
    df = docs_of(spark).unionByName(docs_of(spark).limit(1).withColumn("text", F.lit(license_scan.KNOWN_LICENSES["ISC"])).withColumn("doc_id", F.lit(9).cast("long")))
    got = RUNS["licence"](df).collect()
    assert len(got) == len(TEXTS) + 1 and [r.doc_id for r in got if r.license_id] == [9]


def test_decontamination(spark):
    docs = docs_of(spark)
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (2, None), (None, "never there at all"), (3, "")], "item_id long, text string")
    for held in (items, clashing(items)):
        assert sorted(r.doc_id for r in decontaminate.matches(docs.where("doc_id IS NOT NULL"), held).collect() if r.item_id == 1)[:1] == [1]
        kept = decontaminate.clean(docs, held)
        assert kept.columns == docs.columns
        assert plain(kept.collect(), "doc_id") == Counter((d,) for d, _ in TEXTS if d not in (1, 5))
    assert decontaminate.clean(docs, items.where("false")).count() == len(TEXTS)
    assert decontaminate.matches(docs.where("false"), items).count() == 0


def test_html_tables(spark):
    page = "<html><body><nav><a href='/'>Home</a></nav><div><p>One &amp; two.</p><p>Three\n four.</p></div></body></html>"
    long = "<body>" + "<p>" + LONG + "</p>"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<p>x"), (4, "u", long)]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string")).withColumn("n_chars", F.lit("clash")).withColumn("text", F.lit("clash"))
    got = html_extract.extract(pages).collect()
    assert plain(got, "page_id", "url", "text") == Counter([(1, "u", "One & two.\n\nThree four.")] * 2 + [(2, None, ""), (3, "u", ""), (None, "u", "x"), (4, "u", LONG.strip())])
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract(pages.where("false")).count() == 0


def test_long_conversation(spark):
    turns = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.when(F.col("id") % 2 == 1, "assistant").otherwise("user").alias("role"), F.concat(F.lit("</s> turn "), F.col("id").cast("string")).alias("text"))
    got = chat_format.read_back(chat_format.format_turns(clashing(turns))).collect()
    said = "".join(f"</s> turn {i}" for i in range(1, 3000, 2))
    whole = "".join(f"{'assistant' if i % 2 else 'user'}\n</s> turn {i}\n" for i in range(3000))
    assert [(r.n_turns, r.loss_chars, r.loss_sha256, r.turns_sha256) for r in got] == [(3000, len(said), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(whole.encode()).hexdigest())]


def test_vectors(spark):
    same = [1.0, 0.0]
    rows = [(0, same), (100, same), (1, same), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0, 1.0]), (200, [float("inf"), 1.0])]
    vectors = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(None).cast("int")))
    found = vptree.nearest(vectors, F.col("vec_id") % 100 == 0).collect()
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found)
    assert got == [(0, 1, 1, 0.0), (0, 2, 100, 0.0), (0, 3, 6, 1.0), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 6, 1.0)]
