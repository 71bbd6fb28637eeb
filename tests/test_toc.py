import itertools
import random

import pytest

from strataleaf.operators import toc

ENTRY = "doc_id long, ordinal long, title string, page_number int, level int, confidence double"


def test_hierarchy_equals_recurrence(spark):
    cases = [c for n in range(1, 6) for c in itertools.product(range(-1, 5), repeat=n)]
    rows = [(d, i, "t", 1, level, 1.0) for d, c in enumerate(cases) for i, level in enumerate(c)]
    got = {}
    for r in toc.sanitize_hierarchy(spark.createDataFrame(rows, ENTRY)).collect():
        got.setdefault(r.doc_id, {})[r.ordinal] = r.level
    for d, c in enumerate(cases):
        want = []
        for level in c:
            want.append(1 if not want else min(max(1, level), want[-1] + 1))
        assert [got[d][i] for i in range(len(c))] == want


@pytest.mark.parametrize(("levels", "want"), [([2], [1]), ([1, 3], [1, 2]), ([2, 3], [1, 2]), ([1, 4, 2, 5], [1, 2, 2, 3]), ([3, 5, 1, 4], [1, 2, 1, 2])])
def test_hierarchy_golden(spark, levels, want):
    df = spark.createDataFrame([(1, i, "t", 1, v, 1.0) for i, v in enumerate(levels)], ENTRY)
    assert [r.level for r in toc.sanitize_hierarchy(df).orderBy("ordinal").collect()] == want


def test_sort_and_dedup(spark):
    pages = spark.createDataFrame([(1, i, str(i), p, 1, 1.0) for i, p in enumerate([10, 5, 20, 1])], ENTRY)
    assert [r.page_number for r in toc.sort_by_page(pages).orderBy("ordinal").collect()] == [1, 5, 10, 20]
    levels = spark.createDataFrame([(1, i, str(i), 1, v, 1.0) for i, v in enumerate([2, 1, 3])], ENTRY)
    assert [r.level for r in toc.sort_by_page(levels).orderBy("ordinal").collect()] == [1, 2, 3]
    twice = spark.createDataFrame([(1, 0, "a", 10, 1, 0.85), (1, 1, "a", 10, 1, 0.95)], ENTRY)
    assert [r.confidence for r in toc.deduplicate(twice).collect()] == [0.85]


def test_merge_equals_fold(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for doc in range(150):
        merged: list[tuple] = []
        for batch in range(3):
            entries = [(rng.choice("ab"), rng.randint(1, 3), rng.randint(1, 2)) for _ in range(rng.randint(0, 4))]
            rows += [(doc, i, t, p, v, float(batch), batch) for i, (t, p, v) in enumerate(entries)]
            seen = {(t, p) for t, p, _ in merged}
            for t, p, v in entries:
                if (t, p) not in seen:
                    seen.add((t, p))
                    merged.append((t, p, v))
            merged.sort(key=lambda e: (e[1], e[2]))
        want[doc] = merged
    got: dict = {}
    for r in toc.merge(spark.createDataFrame(rows, ENTRY + ", batch_ix int")).orderBy("doc_id", "ordinal").collect():
        got.setdefault(r.doc_id, []).append((r.title, r.page_number, r.level))
    assert got == {d: m for d, m in want.items() if m}


def test_guard_and_rows(spark):
    docs = spark.createDataFrame([(1, [1]), (2, []), (3, None)], "doc_id long, existing_toc array<int>")
    assert {r.doc_id for r in toc.check_no_existing(docs).collect()} == {2, 3}
    assert toc.check_no_existing(docs, force=True).count() == 3
    e = spark.createDataFrame([(1, 1, "a", 3, 2, 0.5)], ENTRY)
    assert toc.from_rows(toc.to_rows(e)).first().confidence == 1.0
    assert e.select(toc.entry_bullet()).first()[0] == "- a (page 3, level 2, confidence 0.50)"
