import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest

from strataleaf.llm import components, induced_sort, jaccard_join, substring_dedup
from strataleaf.llm.shingles import shingle_sets
from strataleaf.session import table


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def shingles(text, width):
    w = words(text)
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute_components(rows, width, percent):
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, shingles(t, width)) for d, t in rows]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {(d, len(s), find(d)) for d, s in sets}


def test_shingle_sets_equal_brute_force():
    rng = random.Random(0)
    texts = ["".join(rng.choice("aB é\t\n\x0b,日") for _ in range(rng.randint(0, 120))) for _ in range(400)] + ["", " ", "a", "a b", "A b a B a b a b", "x " * 3000]
    for width in (1, 4, 5):
        got = shingle_sets([t.encode() for t in texts], width)
        assert [len(s) for s in got] == [len(shingles(t, width)) for t in texts]
        for i in range(0, 100, 7):
            for j in range(100):
                assert len(np.intersect1d(got[i], got[j])) == len(shingles(texts[i], width) & shingles(texts[j], width))


def near_copies(rng, n):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    passage = " ".join(word() for _ in range(60))
    rows = []
    while len(rows) < n:
        base = [word() for _ in range(rng.choice([1, 3, 5, 8, 20, 45, 64, 130, 260, 500]))]
        for _ in range(rng.choice([1, 1, 2, 6, 15])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                k = rng.randrange(len(copy))
                copy[k : k + 1] = rng.choice([[word()], [], [copy[k], word()]])
                copy = copy or [word()]
            rows.append(" ".join(copy) + (" " + passage if rng.random() < 0.2 else ""))
    return rows[:n]


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_join_equals_brute_force(spark, width, percent):
    rng = random.Random(width)
    rows = list(enumerate(near_copies(rng, 500)))
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one two"), (1004, "ONE\ttwo "), (1005, "two one"), (1006, rows[3][1].upper()), (1007, "w " * 20_000)]
    rows += [(2000 + i, rows[5][1]) for i in range(150)]
    want = brute_components(rows, width, percent)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, component_id int")
    got = {tuple(r) for r in jaccard_join.join(df, width, percent).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == want
    kept = jaccard_join.representatives(df, width, percent)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in want}) and kept.columns == df.columns


def thue_morse(n):
    """Words that sums of powers modulo 2**64 cannot tell apart, whatever the base."""
    word = "".join("ab"[k.bit_count() % 2] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_hashes_tell_words_apart(spark):
    one, other = thue_morse(2048)
    df = spark.createDataFrame([(1, one), (2, other), (3, f"{one} b c d e"), (4, f"{other} b c d e")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard_join.join(df).collect()) == [(d, d) for d in (1, 2, 3, 4)]
    rows = [(1, one), (2, other), (3, one)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_dedup(rows, 100)


def test_join_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.join(empty).count() == 0 and jaccard_join.representatives(empty).count() == 0
    again = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (None, None)], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in jaccard_join.join(again).collect()), key=str) == [(1, 1), (1, 1), (2, 1), (None, None)]
    assert [r.doc_id for r in jaccard_join.representatives(again.where("doc_id IS NOT NULL")).collect()] == [1]


def borderline(rng, n, threshold):
    """A set of n numbers and one that is only just linked with it."""
    one = {rng.getrandbits(63) for _ in range(n)}
    other = set(one)
    spare = sorted(one)
    while True:
        new = set(other)
        if rng.random() < 0.5 and len(spare) > 1:
            new.discard(spare[-1])
        else:
            new.add(rng.getrandbits(63))
        if not threshold.holds(len(one & new), n, len(new)):
            return [np.array(sorted(s), np.uint64) for s in (one, other)]
        if spare and spare[-1] not in new:
            spare.pop()
        other = new


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_share_a_key_and_pass_the_bound(percent):
    rng, threshold = random.Random(percent), jaccard_join.Threshold(percent)
    for n in [*range(1, 40), 63, 64, 65, 127, 128, 129, 255, 256, 300, 511, 513]:
        for _ in range(4):
            a, b = borderline(rng, n, threshold)
            assert len(np.intersect1d(jaccard_join.keys_of(a, threshold), jaccard_join.keys_of(b, threshold)))
            tree = jaccard_join.CountTree(jaccard_join.counts_of(b)[None], np.array([len(b)]), threshold)
            assert tree.search(jaccard_join.counts_of(a), len(a)).tolist() == [0]


def test_tree_equals_scan():
    rng, threshold = np.random.default_rng(1), jaccard_join.Threshold(85)
    base = rng.integers(0, 2**63, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(100, 200)], rng.integers(0, 2**63, rng.integers(0, 30)).astype(np.uint64)])) for _ in range(1500)]
    points, sizes = np.array([jaccard_join.counts_of(s) for s in sets]), np.array([len(s) for s in sets])
    tree = jaccard_join.CountTree(points, sizes, threshold)
    for k in range(0, 1500, 50):
        bound = np.minimum(points, points[k]).sum(axis=1, dtype=int)
        fits = (85 * sizes <= 100 * sizes[k]) & (100 * sizes >= 85 * sizes[k]) & (bound >= threshold.least_overlap(sizes + sizes[k]))
        assert sorted(tree.search(points[k], sizes[k]).tolist()) == np.flatnonzero(fits).tolist()


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(60)] + [(500, 500 + k) for k in range(1, 200)] + [(rng.randint(1000, 1300), rng.randint(1000, 1300)) for _ in range(250)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    got = {(r.node, r.component) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, find(x)) for e in edges for x in e if e[0] != e[1]}


def held_against_brute_force(text, scratch=None):
    order, shared = induced_sort.suffix_order(text, scratch)
    suffixes = [tuple(text[i:].tolist()) for i in range(len(text))]
    assert order.tolist() == sorted(range(len(text)), key=lambda i: suffixes[i])
    for a, b, s in zip(order, order[1:], shared[1:], strict=False):
        n_same = next(i for i, (x, y) in enumerate(zip(suffixes[a], suffixes[b], strict=False)) if x != y)
        assert s == min(n_same, induced_sort.CAP)


@pytest.mark.parametrize(("memory", "most", "block"), [(0, 1 << 15, 1 << 17), (1 << 20, 8, 16), (300, 1, 4), (0, 40, 5)])
def test_induced_order_and_prefixes(monkeypatch, memory, most, block):
    monkeypatch.setattr(induced_sort, "RANGE", most)
    monkeypatch.setattr(induced_sort, "BLOCK", block)
    rng = np.random.default_rng(block)
    for trial in range(24):
        n, k = int(rng.integers(2, 300)), int(rng.choice([1, 2, 3, 5, 40, 3000]))
        base = rng.integers(1, k + 1, n)
        if trial % 3 == 0:
            base = np.tile(base[: max(1, n // 7)], 7)
        held_against_brute_force(np.append(base, 0).astype(np.uint16), induced_sort.Scratch(None, memory, memory))
    for base in (np.ones(600), np.tile([3, 1, 2], 200), np.tile(np.append(np.full(280, 5), 1), 3)):
        held_against_brute_force(np.append(base, 0).astype(np.uint16))


def test_sort_keeps_to_its_memory():
    """A string of ten times the bounds: what does not fit goes to files, and memory stays near the bounds."""
    rng, bound = np.random.default_rng(3), 1 << 17
    words = [rng.integers(1, 30, rng.integers(3, 300)) for _ in range(400)]
    text = np.append(np.concatenate([words[i] for i in rng.integers(0, 400, 5_000)])[: 5 * bound], 0).astype(np.uint16)
    scratch = induced_sort.Scratch(None, bound, bound)
    tracemalloc.start()
    order, shared = induced_sort.suffix_order(text, scratch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert scratch.mapped > 10 * bound and scratch.spilled > 10 * bound and peak < 24 << 20
    at = rng.integers(1, len(text), 2000)
    for i, j, s in zip(order[at - 1].tolist(), order[at].tolist(), shared[at].tolist(), strict=True):
        assert text[i : i + s].tolist() == text[j : j + s].tolist()
        assert s == induced_sort.CAP or text[i + s] < text[j + s]
    assert len(np.unique(order)) == len(text)


def brute_dedup(rows, length):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 2, np.int8)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s + 1 : s + length + 1] = 1
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone[1:], strict=False) if not g)
        out[d] = (len(b), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_dedup_equals_brute_force(spark):
    rng = random.Random(6)
    text = lambda n, k=12: "".join(rng.choice("abcdefghijkl"[:k]) for _ in range(n))
    passages = [text(n) for n in (100, 101, 130, 260)] + ["ab" * 120, "x" * 400, "é" * 120]
    rows = [(0, None), (1, ""), (2, "a" * 99), (3, "a" * 100), (4, "a" * 101)]
    for d in range(5, 260):
        parts = [text(rng.randint(0, 300), rng.choice([1, 2, 12]))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            parts += [p[rng.randint(0, 20) :], text(rng.randint(0, 40))]
        rows.append((d, "".join(parts)))
    rows += [(300 + i, rows[20][1]) for i in range(80)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_bytes int")
    want = brute_dedup(rows, 100)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.dedup(df).collect()}
    assert got == want
    twice = df.unionByName(df)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.dedup(twice).collect()} == want
    assert substring_dedup.dedup(df.where("false")).count() == 0


def test_long_texts_are_cut_without_loss(monkeypatch):
    monkeypatch.setattr(substring_dedup, "PART_BYTES", 64)
    raw = ("abcdefghij" * 60).encode()
    parts = substring_dedup._parts(raw, 100)
    assert sum(len(p) - 99 for _, p in parts) == len(raw) - 99 and all(raw[a : a + len(p)] == p for a, p in parts)


def test_hot_keys_are_split(spark, monkeypatch):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    lines = [text(n) for n in (30, 60, 95, 99, 130)]
    rows = [(d, text(rng.choice([0, 3, 80])) + rng.choice(lines) + rng.choice(["", "q", text(90)]) + rng.choice(lines)) for d in range(300)]
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 300)
    passes = []
    real = substring_dedup._finer
    monkeypatch.setattr(substring_dedup, "_finer", lambda *a: passes.append(a[3]) or real(*a))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.removed_windows(df, 100, 28, 300).collect()
    assert len(passes) > 2
    starts = {(r.doc_id, k) for r in got for k in range(r.a, r.b + 1)}
    seen, want = set(), set()
    for d, t in rows:
        for k in range(len(t) - 99):
            if t[k : k + 100] in seen:
                want.add((d, k))
            seen.add(t[k : k + 100])
    assert starts == want and len(want) > 1000


def test_dedup_query(spark):
    from strataleaf.llm import registry

    sf = "/root/testdata/sf0.001"
    want = brute_dedup([(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()], 100)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in registry.op6_suffix_dedup(spark, sf).collect()}
    assert got == want
