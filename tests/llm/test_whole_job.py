import random
import re

from strataleaf.llm import chat_format, decontaminate, jaccard_join, pii
from test_search_and_text import edit_within


def test_every_text_of_an_item_id_is_looked_for(spark):
    one, other = "the first wording of this question is here", "quite another sentence stands in its place"
    bench = spark.createDataFrame([(7, one), (7, other), (7, ""), (7, None), (8, one)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {one}"), (2, f"{other} y"), (3, f"{other}. {one[:-1]}"), (4, "none of it")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.matches(docs, bench).collect()}
    assert got == {(1, 7, 0), (1, 8, 0), (2, 7, 0), (3, 7, 0), (3, 8, 1)}
    assert [r.doc_id for r in decontaminate.clean(docs, bench).collect()] == [4]


def test_blocks_are_bounded_by_characters_too(spark):
    items = [(i, "word " * 20 + f"item {i}") for i in range(30)] + [(3, "other words of the same item")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    blocks = list(decontaminate._blocks(bench, 1000, 500))
    assert len(blocks) > 3 and sorted(r for b in blocks for r in b) == sorted(items)
    assert sum(3 in {i for i, _ in b} for b in blocks) == 1
    docs = spark.createDataFrame([(1, items[7][1]), (2, items[30][1]), (3, "clean")], "doc_id long, text string")
    want = sorted(map(tuple, decontaminate.matches(docs, bench).collect()))
    assert (2, 3, 0) in want and (1, 7, 0) in want
    assert sorted(map(tuple, decontaminate.matches(docs, bench, block_chars=500).collect())) == want


def test_long_items_have_one_budget():
    rng = random.Random(3)
    item = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(900))[:4000].strip()
    near = list(item)
    for k in rng.sample(range(2000), 200):  # all in one half: within 320 for the whole, beyond 160 for the half
        near[k] = rng.choice("xyz")
    far = list(item)
    for k in rng.sample(range(len(item)), 400):
        far[k] = rng.choice("xyz")
    matcher = decontaminate.Matcher([(7, item)], decontaminate.ERROR_RATE)
    assert matcher.find(f"before {''.join(near)} after") == {7: 200}
    assert matcher.find("".join(far)) == {}
    assert matcher.find(f"{item[2000:]} {item[:2000]}") == {}  # its halves in the wrong order are not the item


def test_distance_is_the_least_of_all_places():
    rng = random.Random(8)
    for _ in range(300):
        items = [(i % 3, "".join(rng.choice("abcd") for _ in range(rng.choice([3, 13, 30, 60])))) for i in range(5)]
        text = ""
        for _ in range(3):
            copy = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, len(copy) // 10 + 1)):
                k = rng.randrange(len(copy))
                copy[k : k + 1] = rng.choice([["a"], [copy[k], "b"], [copy[k], "c"]])
            text += "".join(copy) + rng.choice(["", "a", "bcd", " ", " "])
        text = text.strip()
        want = {}
        for i, x in items:
            e = edit_within(x, text)
            if not int(decontaminate.ERROR_RATE * len(x)):  # whole words only
                e = 0 if f" {x} " in f" {text} " else 1
            if e <= int(decontaminate.ERROR_RATE * len(x)):
                want[i] = min(e, want.get(i, e))
        assert decontaminate.Matcher(items, decontaminate.ERROR_RATE).find(text) == want


def test_short_items_are_whole_words():
    matcher = decontaminate.Matcher([(1, "Yes!"), (2, "no way")], decontaminate.ERROR_RATE)
    assert matcher.find("blue eyes, eyes and yesterday; no ways") == {}
    assert matcher.find("Oh yes. There is NO WAY") == {1: 0, 2: 0} and matcher.find("yes") == {1: 0}


def test_rows_without_or_with_one_id_go_by_their_texts(spark):
    one, two, three, four = ("a b c d e f g", "h i j k l m n", "o p q r s t u", "v w x y z a b")
    rows = [(None, one), (None, two), (None, two), (7, three), (7, four), (7, three), (8, one), (9, four), (None, ""), (None, None), (10, "  "), (10, "")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, lang string")
    kept = jaccard_join.representatives(df)
    assert kept.columns == df.columns
    want = [(None, two), (7, three), (7, four), (8, one), (None, ""), (None, None), (10, "  "), (10, "")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_gate_of_the_transducers_skips_nothing(monkeypatch):
    said = ["10 punkt 20 punkt 30 punkt 40", "192 point 168 point 1 point 1", "10  Punto 0 punto 0   punto 255"]
    for text in said:
        assert pii.all_spans(text)[1] == [("ip", 0, len(text))]
        assert pii.redact_text(f"host {text} is") == "host [IP] is"
    signs = "[at]|(arroba)|< chez >|{@}|&#64;|&commat;|%40|_at_|-AT-| @ | at |[dot]|( punkt )|<point>|{punto}|[.]|&#46;|&period;|_dot_|-dot-| dot | point | punkt | punto |plus |one two three four|1O.2|john|example|com|10|7|.| ".split("|")
    rng = random.Random(5)
    texts = said + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 9))) for _ in range(20_000)]
    gated = [pii.all_spans(t) for t in texts]
    monkeypatch.setattr(pii, "_SIGNS", re.compile(""))
    assert [pii.all_spans(t) for t in texts] == gated


def test_chat_figures_come_from_the_examples(spark, monkeypatch):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "bcd"), (1, 2, "assistant", "efg"), (2, 0, "user", "h")]
    formatted = chat_format.format_turns(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    right = {r.conv_id: r for r in chat_format.read_back(formatted).collect()}
    assert (right[1].n_examples, right[1].loss_chars, right[2].n_examples, right[2].loss_chars, right[2].example_chars) == (2, 6, 0, 0, 0)
    made = chat_format.example_columns
    names = ["target_ordinal", "context_chars", "loss_start", "loss_length", "target"]
    for column, field in (("context_chars", "example_chars"), ("loss_start", "loss_sha256"), ("loss_length", "loss_chars")):
        monkeypatch.setattr(chat_format, "example_columns", lambda c=column: [(x - 1).alias(n) if n == c else x for n, x in zip(names, made(), strict=True)])
        wrong = {r.conv_id: r for r in chat_format.read_back(formatted).collect()}
        assert wrong[1][field] != right[1][field]
        assert wrong[1].turns_sha256 == right[1].turns_sha256 and wrong[2] == right[2]
