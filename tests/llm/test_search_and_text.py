import random
import re
import time
import zlib
from collections import Counter
from html import unescape

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataleaf.llm import decontaminate, html_extract, language_id, packing, pii, vptree
from strataleaf.session import table

SF = "/root/testdata/sf0.001"


def brute_nearest(rows, k=10):
    best = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            best[i] = min(best.get(i, list(v)), list(v))
    ids = sorted(best)
    out = {}
    for q in ids:
        if q % 100 == 0:
            one = np.array(best[q], float)
            found = sorted((float(vptree.distances(one, np.array([best[i]], float))[0]), i) for i in ids if i != q and len(best[i]) == len(one))[:k]
            out[q] = found
    return out


def test_exact_search_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(1500)]
    rows += [(i, rows[7][1]) for i in range(2000, 2300)]  # very many equal vectors
    rows += [(3000, None), (3001, [0.0] * 6), (3100, [float("nan")] * 6), (3200, [1.0, None]), (3300, []), (3400, [1.0, 2.0]), (3500, [2.0, 2.0]), (None, [1.0] * 6), (100, [9.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    for shard_rows, least in ((400, 64), (100, 8), (10_000, 64)):  # regions, many of them, one shard
        got = {}
        for r in vptree.nearest(df, F.col("vec_id") % 100 == 0, factor=1.0, shard_rows=shard_rows, region_sample=least).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert got == brute_nearest(rows)
    assert vptree.nearest(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_recall_of_the_query(spark):
    from strataleaf.llm import registry

    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in table(spark, SF, "embeddings").collect()]
    want = brute_nearest(rows)
    got = {}
    for r in registry.op1_nearest(spark, SF).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = np.mean([len(got[q] & {i for _, i in f}) / len(f) for q, f in want.items()])
    assert recall >= 0.9


def recall_of(found, want):
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    return np.mean([len(got[q] & {i for _, i in f}) / len(f) for q, f in want.items()])


def test_recall_over_several_shards(spark):
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    want = brute_nearest([(r.vec_id, [float(x) for x in r.embedding]) for r in df.collect()])
    assert recall_of(vptree.nearest(df, F.col("vec_id") % 100 == 0, shard_rows=300), want) >= 0.9


def test_queries_are_not_copied_for_each_region(spark, monkeypatch):
    """Many regions, several shards in each, queries in several blocks: exact, and no table holds a query's vector once for each region."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(0, 60_000, 50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    sizes, keep = {}, vptree.written

    def counted(table, name, *more):
        out = keep(table, name, *more)
        if "embedding" in table.columns:
            sizes[name] = out.count()
        return out

    monkeypatch.setattr(vptree, "written", counted)
    monkeypatch.setattr(vptree, "BLOCK_NUMBERS", 1200, raising=False)
    got = {}
    for r in vptree.nearest(df, F.col("vec_id") % 100 == 0, factor=1.0, shard_rows=20, sample=400, region_sample=8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert got == brute_nearest(rows)
    assert max(sizes.values()) <= len(rows), sizes


def test_choice_by_dot_products_leaves_out_none():
    """Far from the origin, tiny, or so large that squares overflow: as by plain distances."""
    rng = np.random.default_rng(4)
    for shift, scale in ((0.0, 1.0), (1e9, 1.0), (0.0, 1e-170), (0.0, 1e160)):
        vectors = (rng.normal(size=(500, 5)) + shift) * scale
        vectors[100:120] = vectors[7]
        with np.errstate(over="ignore"):
            found = vptree.Tree(np.arange(500), vectors).search(np.arange(0, 500, 25), vectors[::25], 10, 1.0)
            for q, best in zip(range(0, 500, 25), found, strict=True):
                d = vptree.distances(vectors[q], vectors)
                assert best == sorted((float(x), i) for i, x in enumerate(d) if i != q)[:10]


def test_regions_bound_and_prune():
    """Bounds hold; where vectors lie in clusters, a search compares few of them and a query reaches few regions."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 10
    vectors = np.concatenate([c + rng.normal(size=(100, 16)) for c in centres])
    top = vptree.Regions(vectors, 16, 64)
    bounds, home = top.bounds(vectors)
    assert top.count > 20 and len(np.unique(home)) == top.count
    for q in range(0, 4000, 157):
        d = vptree.distances(vectors[q], vectors)
        assert bounds[q, home[q]] == 0 and (bounds[q, home] <= d + 1e-9).all()
        assert (bounds[q] <= np.sort(d)[10]).mean() < 0.5
    tree = vptree.Tree(np.arange(4000), vectors)
    exact = tree.search(np.arange(0, 4000, 40), vectors[::40], 10, 1.0)
    assert tree.compared < 0.5 * 100 * 4000
    for q, best in zip(range(0, 4000, 40), exact, strict=True):
        d = vptree.distances(vectors[q], vectors)
        assert best == sorted((float(x), i) for i, x in enumerate(d) if i != q)[:10]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><h2>Site name</h2></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div id=main><h1>Head &amp; line</h1><p>First   para&shy;graph
with <b>bold</b> and <a href="#">a link</a>.<p>Second &lt;unclosed&gt; paragraph, long enough to count as text.<br>After break
<ul><li>Item one of the list<li>Item two of the list</ul><blockquote>Quoted words &#233;&nbsp;here</blockquote></div>
<aside>Aside</aside><div class="comments"><p>Reader comment that is very long and goes on and on and on and on and on and on.</p></div>
<form><input><p>Your name</p></form><!-- hidden <p>comment</p> --><footer><p>Imprint</p></footer></body></html>"""


def test_html():
    assert html_extract.main_text(PAGE).split("\n\n") == [
        "Head & line",
        "First para\xadgraph with bold and a link.",
        "Second <unclosed> paragraph, long enough to count as text. After break",
        "Item one of the list",
        "Item two of the list",
        "Quoted words é here",
    ]


@pytest.mark.parametrize(("html", "want"), [(None, ""), ("", ""), ("<p>", ""), ("just text", "just text"), ("<p>a</p><p>b", "a\n\nb"), ("<<<>>>&", "<<<>>>&"), ("<div>" * 3000 + "deep", "deep"), ("<p>x<script>never closed", "x")])
def test_html_edges(html, want):
    assert html_extract.main_text(html) == want


def article_text(html):
    """The text between the generator's own article tags, by plain patterns, with nothing of the operator."""
    inner = re.search(r"<article[^>]*>(.*?)</article>", html, re.S)[1]
    inner = re.sub(r"<br\s*/?>", " ", re.sub(r"<!--.*?-->|<script.*?</script>|<style.*?</style>", "", inner, flags=re.S))
    parts = re.split(r"</?(?:p|h[1-6]|ul|ol|li|div|table|tr|td|th|blockquote|pre|section|figure|figcaption)\b[^>]*>", inner)
    texts = (re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]+>", "", x))).strip() for x in parts)
    return "\n\n".join(t for t in texts if t)


def test_html_articles(spark):
    """On the generated pages the main text is the article, with its tags and without them, in wrappers and in a form."""
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    html = {r.page_id: r.html for r in pages.collect()}
    got = html_extract.extract(pages.withColumn("text", F.lit("clash"))).collect()
    assert len(got) == len(html)
    for r in got:
        want = article_text(html[r.page_id])
        assert r.text == want and r.n_chars == len(r.text)
        plain = html[r.page_id].replace("article>", "div>")
        for page in (plain, plain.replace("<body>", '<body><div class="page no-sidebar has-menu">'), plain.replace("<body>", "<body><form id=f><input name=x>")):
            assert html_extract.main_text(page) == want
    empty = spark.createDataFrame([(1, None, None), (1, None, None)], "page_id long, url string, html string")
    assert [(r.text, r.n_chars) for r in html_extract.extract(empty).collect()] == [("", 0)] * 2
    assert html_extract.extract(empty.where("false")).count() == 0


LONG = "A sentence of the article that is long enough to be told from all the rest of the page. "


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f'<div class="page no-sidebar"><h1>T</h1><p>{LONG}</p></div>', ["T", LONG.strip()]),
        (f'<div class="content with-sidebar"><p>{LONG}</p><div class="sidebar"><p>Side</p></div></div>', [LONG.strip()]),
        (f"<form><h2>T</h2><p>{LONG}</p><input><label>Mail</label></form>", ["T", LONG.strip()]),
        (f"<main><h1>T</h1><p>{LONG}</p></main><form><p>Your name please</p></form>", ["T", LONG.strip()]),
        (f'<p class="legal">{LONG}</p><p>{LONG}</p>', [LONG.strip()] * 2),
        (f'<p title="5" tall">{LONG}</p>', [LONG.strip()]),
        (f"<p title='a > b' x=\"</p>\">{LONG}</p>", [LONG.strip()]),
        (f"<main><h1>T</h1><p>{LONG}</p><div class=x1><h3>3 Comments</h3><p>{LONG * 3}</p><p>{LONG * 3}</p></div></main>", ["T", LONG.strip()]),
        (f"<main><h1>T</h1><p>{LONG}</p><p>{LONG}</p><h2>Reader comments</h2><div><p>{LONG * 3}</p></div></main>", ["T", LONG.strip(), LONG.strip()]),
        (f'<div><h1>T</h1><p>{LONG}</p></div><div id="comments"><p>{LONG * 9}</p><p>{LONG * 9}</p></div>', ["T", LONG.strip()]),
        (f'<div class="cookie-banner"><p>{LONG}</p></div><h1>T</h1><p>{LONG}</p><p>{LONG}</p>', ["T", LONG.strip(), LONG.strip()]),
        (f"<p>{LONG}</p><a href=\"never closed><p>gone</p>", [LONG.strip()]),
    ],
)
def test_html_wrappers_and_markup(html, want):
    assert html_extract.main_text(html).split("\n\n") == want


@pytest.mark.parametrize("html", ["<a " * 350_000, "<div>" * 60_000 + "</x>" * 60_000 + "t", "<b>" * 60_000 + "<p>x" * 60_000, "<h2>comments" * 50_000, "<!--" * 200_000, "<" * 500_000, "<header>" * 60_000, "<p x='" * 100_000, "<b>" * 50_000 + "<header></header>" * 50_000])
def test_hostile_pages_take_linear_time(html):
    began = time.process_time()
    html_extract.main_text(html)
    assert time.process_time() - began < 20


def test_language_accuracy_on_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    said = {r.doc_id: r for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    right = Counter()
    for r in docs.select("doc_id", "lang").collect():
        held = zlib.crc32(str(r.doc_id).encode()) % 4 == 2
        assert said[r.doc_id].held_out is held and 0.0 <= said[r.doc_id].score <= 1.0
        if held:
            right[said[r.doc_id].lang_pred == r.lang] += 1
    assert right[True] / sum(right.values()) >= 0.97


def test_language_edges(spark):
    rows = [(i, t, l, "x") for i, (t, l) in enumerate([("the thing with that", "en"), ("der schnee und die", "de"), (None, "en"), ("", None), ("12 34 !!", "en"), ("é", None), ("a" * 300_000, None), ("the thing with that", "en")] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = {r.doc_id: r for r in language_id.identify(df, language_id.fit(df)).collect()}
    assert len(got) == 24
    assert all((got[i].lang_pred == "und") == (i % 8 in (2, 3, 4)) for i in got)
    assert all(got[i].score == 0.0 for i in got if got[i].lang_pred == "und")
    bare = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify(bare, language_id.fit(bare)).collect()} == {"und"}
    assert language_id.identify(df.where("false"), None).count() == 0
    assert language_id.accept(df, language_id.fit(df)).count() == 15 and language_id.accept(df, language_id.fit(df)).columns == df.columns


VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def test_training_rows_are_those_of_least_hash(spark):
    rows = [(i, f"text {i}", "en" if i % 3 else "de") for i in range(900)]
    df = spark.createDataFrame(rows + rows[:300] * 2 + [(901, "text", None), (902, None, "en"), (903, "1", "fr")], "doc_id long, text string, lang string").repartition(7)
    hashed = df.where(~language_id.held_out(F.col("doc_id"))).select("lang", "text", F.xxhash64("doc_id", "text").alias("h")).distinct().collect()
    by_lang = {lang: sorted((r.h, r.text) for r in hashed if r.lang == lang and "text" in (r.text or "")) for lang in ("en", "de")}
    got = sorted(map(tuple, language_id.training_rows(df, per_language=40).collect()))
    assert got == sorted((lang, text) for lang, held in by_lang.items() for _, text in held[:40])
    few = language_id.training_rows(df, per_language=40, sample=20).collect()
    assert len(few) == 20 and {tuple(r) for r in few} <= set(got)
    assert not language_id.training_rows(df.limit(0)).collect()


def test_ids_are_those_of_tokenizers(spark):
    tokens = Tokenizer.from_file(VOCABULARY)
    texts = [r.text for r in table(spark, SF, "documents").collect()] + ["", "<|endoftext|> x", "a <|endoftext|> b", "<|endoftext|><|endoftext|>\n<|endoftext|", "  \n\t é 日本 🙂" * 30, "x" * 5000, "1234567890" * 200, "'s 're don't"]
    encode = packing.encoder(VOCABULARY)
    assert [encode(t) for t in texts] == [e.ids for e in tokens.encode_batch(texts, add_special_tokens=False)]


def check_packed(rows, docs, capacity=1024):
    encode = packing.encoder(VOCABULARY)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(docs)
    for d, pieces in by_doc.items():
        ids = np.array([*encode(docs[d] or ""), 0], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return sum(r.length for r in rows) / (capacity * len(by_sequence))


def test_packing(spark):
    docs = {r.doc_id: r.text for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").coalesce(1)
    assert check_packed(packing.pack(df, VOCABULARY).collect(), docs) > 0.97
    odd = {1: None, 2: "", 3: "x y " * 5000, 4: "a"}
    check_packed(packing.pack(spark.createDataFrame(list(odd.items()), "doc_id long, text string").withColumn("start", F.lit(0)), VOCABULARY).collect(), odd)
    assert packing.pack(df.where("false"), VOCABULARY).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_differencing(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 257, 400)
    found = packing.windows_of(sizes, 1024)
    sums = np.bincount(found, weights=sizes)
    assert sums.max() <= 1024 and len(sums) >= sizes.sum() / 1024
    four = packing.differencing(sizes, 4)
    assert set(four) == {0, 1, 2, 3} and np.ptp(np.bincount(four, weights=sizes)) <= 4
    assert packing.windows_of(np.array([1024, 1024, 1]), 1024).tolist() in ([0, 1, 2], [1, 2, 0], [2, 0, 1], [0, 2, 1], [1, 0, 2], [2, 1, 0])


def brute_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        n = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(n) <= 19 and sum(sum(divmod(x * 2, 10)) if i % 2 else x for i, x in enumerate(n)) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [r.text for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    texts += ["".join(rng.choice("a1.2+@ -()3\n4.5") for _ in range(300)) for _ in range(300)]
    texts += ["x " * 5000 + "a@b.c " + "y " * 5000, "1" * 3000, "1.2.3.4.5.6.7.8", "a@b@c.d", "4111 1111 1111 1111", "+49 (30) 1234-567"]
    texts += ["".join(rng.choice("a@.b- ") for _ in range(60)) for _ in range(2000)]
    for t in texts:
        assert pii.base_spans(t) == brute_base(t), t[:80]


@pytest.mark.parametrize("unit", ["a", "a.", "1.", "1 ", "@", "a@", "a at ", "é at ", "plus 1 ", "one ", "1O", "+1 ", "a@b.co ", "é[dot]"])
def test_very_long_texts_take_linear_time(unit):
    text = "é" + unit * (1_000_000 // len(unit)) + "@"
    began = time.process_time()
    pii.all_spans(text)
    assert time.process_time() - began < 30


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write to john [at] mail [dot] example [dot] com now", "email", "john [at] mail [dot] example [dot] com"),
        ("write to john(at)example(dot)org.", "email", "john(at)example(dot)org"),
        ("reach jane at example dot com today", "email", "jane at example dot com"),
        ("mail jane&#64;example&#46;com please", "email", "jane&#64;example&#46;com"),
        ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("mail jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("call plus four nine three zero one two three four five six", "phone", "plus four nine three zero one two three four five six"),
        ("call +four nine three zero one two three four five", "phone", "+four nine three zero one two three four five"),
        ("host 10[.]0[.]0[.]255 is", "ip", "10[.]0[.]0[.]255"),
        ("host one zero dot four", "ip", None),
        ("card 4111​1111​1111​1111 end", "card", "4111​1111​1111​1111"),
        ("card ４１１１１１１１１１１１１１１１", "card", "４１１１１１１１１１１１１１１１"),
        ("they met at noon and one two", "email", None),
        ("mail john_at_example_dot_com now", "email", "john_at_example_dot_com"),
        ("mail john @ example.com now", "email", "john @ example.com"),
        ("call +1 (two zero three) five five five-eight two eight two", "phone", "+1 (two zero three) five five five-eight two eight two"),
        ("call +1 2O3 555 82l2 now", "phone", "+1 2O3 555 82l2"),
        ("host 1O.2.3.4 is", "ip", "1O.2.3.4"),
    ],
)
def test_deobfuscation(text, kind, found):
    base, spans = pii.all_spans(text)
    got = [text[a:b] for k, a, b in spans if k == kind]
    assert got == ([found] if found else [])
    assert set(base) <= set(spans)


def test_pii_tables(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "a@b.co " * 30_000, 1), (4, "x 10.0.0.1 y", 9), (4, "x 10.0.0.1 y", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn("spans", F.lit("clash"))
    got = pii.find(df).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_email, r.n_ip) for r in got] == [(1, 0, 0), (2, 0, 0), (3, 30_000, 0), (4, 0, 1), (4, 0, 1)]
    assert got[3].spans == "ip:2:10" and got[0].spans == ""
    clean = {r.doc_id: r for r in pii.redact(df).collect()}
    assert clean[4].text == "x [IP] y" and clean[4].n_chars == 8 and clean[1].text is None and clean[4].spans == "clash"
    assert pii.find(df.where("false")).count() == 0


def edit_within(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers_equals_dynamic_programme():
    rng = random.Random(1)
    for _ in range(400):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))
        masks = {}
        for i, c in enumerate(p):
            masks[c] = masks.get(c, 0) | 1 << i
        d = edit_within(p, t)
        assert decontaminate.distance_within(p, masks, t, len(p)) == d
        assert decontaminate.distance_within(p, masks, t, d - 1) is None


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(25))) for i in range(12)] + [(50, None), (51, "?!"), (52, ""), (53, None)]
    docs = []
    for d in range(120):
        base = [" ".join(word() for _ in range(30))]
        if d % 3 == 0:
            t = list(items[d % 12][1])
            for _ in range(d % 16):
                t[rng.randrange(len(t))] = rng.choice("abcdefgh ")
            base.append("".join(t).upper() if d % 2 else "".join(t))
        docs.append((d, ". ".join(base + [word()]), "x"))
    docs += [(500, None, "x"), (501, "", "x"), docs[0]]
    want = set()
    for d, t, _ in docs:
        for i, x in items:
            n = decontaminate.normal(x or "")
            if n and t:
                e = edit_within(n, decontaminate.normal(t))
                if e <= int(decontaminate.ERROR_RATE * len(n)):
                    want.add((d, i))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    for block in (20_000, 5):
        got = decontaminate.matches(df, bench, block_items=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 20
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, _, _ in docs} - {d for d, _ in want}
    assert decontaminate.matches(df, bench.where("false")).count() == 0 and decontaminate.clean(df, bench.where("false")).count() == len(docs)
    assert decontaminate.matches(df.where("false"), bench).count() == 0


def test_fitting_holds_one_dense_table(monkeypatch):
    """The driver's memory while it fits: the table of features and little else."""
    import tracemalloc

    import pyarrow as pa

    rng, langs = np.random.default_rng(3), ["de", "en", "fr", "es"] * 75
    slots = [np.sort(rng.choice(2 << language_id.BITS, 1000, replace=False)).astype(np.int32) for _ in langs]
    shares = [rng.random(1000).astype(np.float32) / 500 for _ in langs]
    rows = pa.table({"lang": langs, "slots": pa.array(slots, pa.list_(pa.int32())), "shares": pa.array(shares, pa.list_(pa.float32()))})

    class Rows:
        mapInArrow = lambda self, *_: self
        toArrow = lambda self: rows

    monkeypatch.setattr(language_id, "training_rows", lambda *_: Rows())
    tracemalloc.start()
    model = language_id.fit(None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.weights.shape == ((2 << language_id.BITS) + 1, 3)
    assert peak < 3 * len(langs) * (2 << language_id.BITS) * 4
