"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are lower-cased, ASCII punctuation becomes a blank and
blanks are joined. An item of m characters has an error budget of
floor(error_rate * m) edits and is split into budget-plus-one pieces: wherever
an item occurs within its budget, one piece occurs exactly. Piece hits are found
in one pass over each whole text (Aho-Corasick) and the text around a hit is
verified with Myers' bit-parallel distance, first for the hit piece with its
neighbour, then for twice as many pieces, up to the whole item with its whole
budget, whatever its length. An item too short for any edit counts only as whole
words ("yes" is not in "blue eyes").

Items are read in blocks of about block_items rows and block_chars characters at
most (the texts of one item_id stay together); each block is one pass over the
documents, so what is sent to the executors is bounded.

Defined results: a null or empty text matches nothing; an item without letters
or digits matches nothing; repeated documents are reported each (equal rows
once); items of equal text are reported each; rows of one item_id with several
texts are each looked for, and the id is reported with the least distance; extra
columns are ignored; an empty table on either side gives an empty result (nothing is dropped).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataleaf.llm.frames import slices

ERROR_RATE = 0.08
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 8_000_000
_BLANKS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
SCHEMA = "doc_id long, item_id long, distance long"


def normal(text: str) -> str:
    """Lower case, ASCII punctuation and white space as single blanks."""
    raw = text.lower().encode("utf-8", "surrogatepass").translate(_BLANKS)
    return " ".join(raw.decode("utf-8", "surrogatepass").split())


def distance_within(pattern: str, masks: dict[str, int], text: str, most: int) -> int | None:
    """Least edit distance of the pattern to any substring of text, if it is at most most (Myers, 1999)."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    get = masks.get
    for c in text:
        eq = get(c, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        plus = (down | ~(horizontal | up)) & full
        minus = up & horizontal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            if score < best:
                best = score
                if not best:
                    break
        plus = (plus << 1) & full  # a match may begin anywhere: the row above is all zeros
        minus = (minus << 1) & full
        up = (minus | ~(vertical | plus)) & full
        down = plus & vertical
    return best if best <= most else None


def _apart(text: str, begin: int, end: int) -> bool:
    """Whether words begin and end there."""
    return (not begin or text[begin - 1] == " ") and (end == len(text) or text[end] == " ")


class Piece:
    """A stretch of an item that is split into so many pieces, in a tree: the item is the root, single pieces are leaves.

    A stretch of n pieces may hold n - 1 edits. If it does, one of its halves of x and y pieces
    holds x - 1 or y - 1 at most, and so on down to a piece without an edit; upwards from
    that piece each stretch is within its own budget, the item included.
    """

    __slots__ = ("begin", "budget", "masks", "row", "seen", "text", "up")

    def __init__(self, text: str, begin: int, budget: int, row: int, up: Piece | None):
        self.text, self.begin, self.budget, self.row, self.up = text, begin, budget, row, up
        self.masks: dict[str, int] | None = None
        self.seen: tuple[int, int, int, int | None] = (-1, 0, 0, None)  # text number, window that was searched, distance found

    def distance(self, number: int, text: str, start: int) -> int | None:
        """Least distance, if within budget, near where the stretch would start; start is of the whole item."""
        at, budget, m = start + self.begin, self.budget, len(self.text)
        lo, hi = max(0, at - budget), min(len(text), at + m + budget)
        held, a, b, d = self.seen
        if held == number and a <= lo and hi <= b:
            return d
        # Wider than asked for, so that hits of other pieces of the same place need no search of their own.
        lo, hi = max(0, lo - budget), min(len(text), hi + budget)
        window = text[lo:hi]
        if self.text in window:
            d = 0
        elif not budget:
            d = None
        else:
            if self.masks is None:
                self.masks = {}
                for i, c in enumerate(self.text):
                    self.masks[c] = self.masks.get(c, 0) | 1 << i
            d = distance_within(self.text, self.masks, window, budget)
        self.seen = (number, lo, hi, d)
        return d


class Matcher:
    """Automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        import ahocorasick

        self.ids = [item_id for item_id, _ in items]
        self.texts = 0
        pieces: dict[str, list[tuple[Piece, int]]] = {}
        for row, (_, text) in enumerate(items):
            whole = normal(text or "")
            n = int(error_rate * len(whole)) + 1
            cuts = [len(whole) * j // n for j in range(n + 1)]
            stack: list[tuple[int, int, Piece | None]] = [(0, n, None)] if whole else []
            while stack:
                i, j, up = stack.pop()
                node = Piece(whole[cuts[i] : cuts[j]], cuts[i], j - i - 1, row, up)
                if j - i == 1:
                    pieces.setdefault(node.text, []).append((node, cuts[j]))
                else:
                    stack += [(i, (i + j) // 2, node), ((i + j) // 2, j, node)]
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, places)
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, int]:
        """Item id to least distance, for the items that the text holds whole."""
        if not len(self.automaton):
            return {}
        t = normal(text)
        self.texts += 1
        found: dict[int, int] = {}
        for end, places in self.automaton.iter(t):
            for node, b in places:
                if found.get(node.row) == 0:
                    continue
                d: int | None = 0
                up = node.up
                if up is None and not _apart(t, end + 1 - len(node.text), end + 1):
                    continue
                while up is not None and d is not None:
                    d = up.distance(self.texts, t, end + 1 - b)
                    up = up.up
                if d is not None:
                    found[node.row] = min(d, found.get(node.row, d))
        held: dict[int, int] = {}
        for row, d in found.items():
            held[self.ids[row]] = min(d, held.get(self.ids[row], d))
        return held


def _blocks(benchmark: DataFrame, block_items: int, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items, a bounded number of rows and characters at a time, in order of item_id and text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL")
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()
    if n <= block_items and chars <= block_chars:
        if rows := [tuple(r) for r in items.distinct().collect()]:
            yield sorted(rows, key=str)
        return
    blocks = max(-(-n // block_items), -(-chars // block_chars)) * 2
    dealt = items.distinct().withColumn("b", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    for b in range(blocks):
        if rows := [tuple(r) for r in dealt.where(F.col("b") == b).drop("b").collect()]:
            yield rows


def _matchers(docs: DataFrame, benchmark: DataFrame, error_rate: float, block_items: int, block_chars: int):
    sc = docs.sparkSession.sparkContext
    for items in _blocks(benchmark, block_items, block_chars):
        yield sc.broadcast((items, error_rate))


_HELD: dict[int, Matcher] = {}


def _matcher(sent) -> Matcher:
    """Built once in each worker process for each broadcast."""
    if sent.id not in _HELD:
        _HELD.clear()
        _HELD[sent.id] = Matcher(*sent.value)
    return _HELD[sent.id]


class _Sent:
    """A broadcast with a key that survives pickling."""

    def __init__(self, broadcast):
        self.id, self.broadcast = f"{broadcast._jbroadcast.id()}", broadcast

    @property
    def value(self):
        return self.broadcast.value


def matches(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id and least distance of each item that a document holds within its budget."""
    found = docs.sparkSession.createDataFrame([], SCHEMA)
    for broadcast in _matchers(docs, benchmark, error_rate, block_items, block_chars):
        sent = _Sent(broadcast)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(sent)
            for part in slices(batches, "text"):
                rows = [
                    (doc_id, item, d)
                    for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)
                    if text
                    for item, d in matcher.find(text).items()
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "item_id", "distance"])

        found = found.unionByName(docs.select("doc_id", "text").mapInArrow(run, SCHEMA))
    return found.distinct()


def clean(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_items: int = BLOCK_ITEMS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no item, all columns as they were."""
    for broadcast in _matchers(docs, benchmark, error_rate, block_items, block_chars):
        sent = _Sent(broadcast)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(sent)
            for part in slices(batches, "text"):
                yield part.filter(pa.array([not (t and matcher.find(t)) for t in part.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
