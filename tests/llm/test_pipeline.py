import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from strataleaf.llm import decontaminate, language_id, packing, pii
from strataleaf.session import table
from test_duplicates import brute_components
from test_search_and_text import VOCABULARY, check_packed, edit_within

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_stage_by_stage_brute_force(spark):
    docs = table(spark, SF, "documents")
    said = {r.doc_id: r.lang_pred for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    rows = {r.doc_id: r.text for r in docs.collect() if said[r.doc_id] != "und"}
    kept = {c for _, _, c in brute_components(sorted(rows.items()), 5, 80)}
    items = [decontaminate.normal(r.text) for r in table(spark, SF, "benchmark").collect()]
    clean = {}
    for d in kept:
        n = decontaminate.normal(rows[d])
        hit = any(i in n for i in items) or any(len(n) < 400 and edit_within(i, n) <= int(decontaminate.ERROR_RATE * len(i)) for i in items)
        if not hit:
            clean[d] = pii.redact_text(rows[d])
    assert 0 < len(clean) < len(rows) <= docs.count()
    assert check_packed(corpus_pipeline.run(spark, SF).collect(), clean) > 0.9


def test_stages_keep_columns(spark):
    docs = table(spark, SF, "documents").limit(40).withColumn("key", F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.where("false"), SF).count() == 0, name
    odd = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", None, None, 0), (3, "der die das und", "de", "s", 15)], docs.drop("key").schema)
    assert [r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, odd, SF).collect()] == [3]


def test_crc_of_ids():
    assert packing.encoder(VOCABULARY)("") == [] and zlib.crc32(np.array([0], "<u4").tobytes()) == 0x2144DF1C
