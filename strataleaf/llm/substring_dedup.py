"""Suffix-array dedup by external induced sorting.

Removed is every byte under a string of `length` bytes that also starts earlier
(at a smaller doc_id, or in the same document further left).

1. Every window of `length` bytes has a key: the least hash of the shorter
   strings inside it. A run of neighbouring windows with one key is a segment.
   Equal windows have equal keys, so a key that occurs once, which is the rule in
   text that does not repeat, takes no further part.
2. Equal segments of a key (key and digest, 128 bits together) are copies: the
   windows of all but the earliest are removed. What is left of a key, if it is
   more than one segment, is sorted.
3. A key whose segments differ by more than a shard holds is split: the string
   that the key stands for is taken longer, to the left for windows that reach
   further left and to the right for the others, until the parts fit or the string
   is the whole window.
4. The keys are dealt to shards. A shard's segments are one string, whose suffixes
   are sorted by induction with disk-backed queues that carry prefix values
   (induced_sort). Neighbours in that order that share `length` bytes are one
   string: all but the earliest of such a run are removed.
5. Each document's removed windows are laid over its bytes.

Defined results: a null text is empty; a text shorter than length loses nothing;
rows without an id take no part; rows of one id count once, with the least of
their texts; texts of any length are read whole, in overlapping parts; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataleaf.llm.frames import scratch_folder, slices, written
from strataleaf.llm.induced_sort import Scratch, suffix_order
from strataleaf.llm.shingles import mixed, substring_hashes

KEY_BYTES = 28
SHARD_BYTES = 4 << 20
PART_BYTES = 1 << 20
_FACTOR = np.uint64(0xA0761D6478BD642F)


def _least_in_windows(h: np.ndarray, width: int) -> np.ndarray:
    """Least of each so many neighbours."""
    out, held = h, 1
    while held * 2 <= width:
        out = np.minimum(out[: len(out) - held], out[held:])
        held *= 2
    rest = width - held
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _parts(text: bytes, length: int) -> list[tuple[int, bytes]]:
    """(offset, bytes) of overlapping parts; each window lies in exactly one."""
    if len(text) < length:
        return []
    step = PART_BYTES
    return [(a, text[a : a + step + length - 1]) for a in range(0, len(text) - length + 1, step)]


def _digests(hashes: np.ndarray, first: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """Digest of each span, from the hashes of its substrings of so many bytes."""
    size = end - first
    out = mixed(size.astype(np.uint64))
    open_, done = np.arange(len(first)), 0
    while len(open_):
        at = np.minimum(first[open_] + done, end[open_] - width)
        out[open_] = mixed(out[open_] * _FACTOR + hashes[at])
        done += width
        open_ = open_[size[open_] > done]
    return out


def segments(texts: list[tuple[int, int, bytes]], length: int, key_bytes: int) -> tuple[np.ndarray, ...]:
    """doc, first and last window start, key and content digest of the segments of (doc, offset, bytes) parts."""
    raw = np.frombuffer(b"".join(t[2] for t in texts), np.uint8)
    if len(raw) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    sizes = np.array([len(t[2]) for t in texts])
    begins = np.cumsum(sizes) - sizes
    hashes = substring_hashes(raw, key_bytes)
    keys = _least_in_windows(hashes, length - key_bytes + 1)
    cut = np.zeros(len(keys), bool)
    # A window that begins with its key's string ends a segment: where that string recurs, its next place begins another.
    cut[1:] = (keys[1:] != keys[:-1]) | (hashes[: len(keys) - 1] == keys[:-1])
    cut[begins[begins < len(keys)]] = True
    over = np.minimum(begins + sizes - length + 1, len(keys))  # windows from here on run into the next text
    cut[over[over < len(keys)]] = True
    first = np.flatnonzero(cut)
    last = np.concatenate([first[1:], [len(keys)]]) - 1
    which = np.searchsorted(begins, first, side="right") - 1
    fine = first < over[which]
    first, last, which = first[fine], last[fine], which[fine]
    digest = _digests(hashes, first, last + length, key_bytes)
    docs = np.array([t[0] for t in texts], np.int64)[which]
    shift = np.array([t[1] for t in texts], np.int64)[which] - begins[which]
    return docs, first + shift, last + shift, keys[first].view(np.int64), digest.view(np.int64)


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _segments(docs: DataFrame, length: int, key_bytes: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, bytes]]]:
        held, n = [], 0
        for part in slices(batches, "text"):
            for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                for at, raw in _parts(_raw(t), length):
                    held.append((d, at, raw))
                    n += len(raw)
                    if n >= PART_BYTES:
                        yield held
                        held, n = [], 0
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in cut(batches):
            found = segments(texts, length, key_bytes)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["doc_id", "a", "b", "key", "digest"])

    return docs.mapInArrow(run, "doc_id long, a long, b long, key long, digest long")


class Shard:
    """The string of a shard's segments, which come by document and place; written to a scratch file."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.file = scratch, scratch.file()
        self.docs, self.places, self.ends = array("q"), array("q"), array("q")
        self.size = 0

    def add(self, doc: int, place: int, data: bytes) -> None:
        # A separator, the least symbol but the end, follows each segment.
        symbols = np.ones(len(data) + 1, np.uint16)
        symbols[:-1] = np.frombuffer(data, np.uint8)
        symbols[:-1] += 2
        self.file.write(symbols.tobytes())
        self.size += len(symbols)
        self.docs.append(doc)
        self.places.append(place)
        self.ends.append(self.size - 1)

    def later_windows(self, length: int) -> Iterator[pa.RecordBatch]:
        """doc_id, a, b: runs of windows that also occur earlier in the shard."""
        self.file.write(np.zeros(1, np.uint16).tobytes())
        self.file.flush()
        text = np.asarray(np.memmap(self.file, np.uint16, "r"))
        docs, places, ends = (np.frombuffer(x, np.int64) for x in (self.docs, self.places, self.ends))
        order, shared = suffix_order(text, self.scratch)
        later = self.scratch.array(len(text), bool)
        number, group, least = 0, -1, 0  # of the group that is open: its least place so far
        for a, b in _blocks(len(text)):
            at = order[a:b].astype(np.int64)
            of = number + np.cumsum(shared[a:b] < length)
            number = int(of[-1])
            # How many bytes are left in the segment of each suffix; where fewer than length, it starts no window.
            keep = ends[np.minimum(np.searchsorted(ends, at), len(ends) - 1)] - at >= length
            at, of = at[keep], of[keep]
            if not len(at):
                continue
            # Segments come by document and place, so the earliest of a group has the least place in the string.
            heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            lows = np.minimum.reduceat(at, heads)
            later[at] = True
            if of[0] == group:
                lows[0] = min(int(lows[0]), least)
            elif group >= 0:
                later[least] = False
            later[lows[:-1]] = False
            group, least = int(of[-1]), int(lows[-1])
        if group >= 0:
            later[least] = False
        del order, shared
        for a, b in _blocks(len(text)):
            at = np.flatnonzero(later[a:b]) + a
            if len(at):
                row = np.searchsorted(ends, at)
                turn = np.flatnonzero((np.diff(at) != 1) | (np.diff(row) != 0))
                first, last = at[np.concatenate([[0], turn + 1])], at[np.concatenate([turn, [len(at) - 1]])]
                row = np.searchsorted(ends, first)
                begin = np.where(row > 0, ends[row - 1] + 1, 0) - places[row]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (docs[row], first - begin, last - begin)], ["doc_id", "a", "b"])
        self.file.close()


def _blocks(n: int, size: int = 1 << 17) -> Iterator[tuple[int, int]]:
    for a in range(0, n, size):
        yield a, min(n, a + size)


def _with_texts(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, text, runs: rows gathered by their document."""
    runs = rows.groupBy("doc_id").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "doc_id"])).alias("runs"))
    return docs.join(runs, "doc_id").select("doc_id", "text", "runs")


def _sorted(wanted: DataFrame, docs: DataFrame, length: int, shards: int) -> DataFrame:
    """Window runs that the shards find to occur earlier; wanted: doc_id, key, a, b."""
    folder = scratch_folder(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            out: list[tuple] = []
            for d, t, runs in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("runs").to_pylist(), strict=True):
                raw = _raw(t)
                out += [(r["key"] % shards, d, r["a"], raw[r["a"] : r["b"] + length]) for r in runs]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["shard", "doc_id", "a", "data"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            for shard, d, a, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "a", "data")), strict=True):
                if shard != now:
                    if held is not None:
                        yield from held.later_windows(length)
                    now, held = shard, Shard(Scratch(folder))
                held.add(d, a, data)
        if held is not None:
            yield from held.later_windows(length)

    pieces = _with_texts(wanted, docs).mapInArrow(cut, "shard long, doc_id long, a long, data binary")
    return pieces.repartition("shard").sortWithinPartitions("shard", "doc_id", "a").mapInArrow(sort, "doc_id long, a long, b long")


def finer(raw: bytes, runs: list[dict], length: int, width: int, key_bytes: int) -> list[tuple[int, int, int, int, int]]:
    """(a, b, at, key, digest) of a document's runs, by longer strings than the width bytes at `at` that they share.

    `at` below 0: the leftmost string of key_bytes whose hash is the key.
    """
    grow = -(-(length - width) // 2)
    out = []
    for r in runs:
        a, b, at = r["a"], r["b"], r["at"]
        data = raw[a : b + length]
        if at < 0:
            found = substring_hashes(np.frombuffer(data, np.uint8), key_bytes)
            at = a + int(np.flatnonzero(found == np.uint64(r["key"] % (1 << 64)))[0])
        # Windows that reach so far to the left agree on that much more at the left, the others at the right.
        for first, last, core in ((a, min(b, at - grow), at - grow), (max(a, at - grow + 1), b, at)):
            if first <= last:
                key = hashlib.blake2b(raw[core : core + width + grow], digest_size=8).digest()
                digest = hashlib.blake2b(raw[first : last + length], digest_size=8, person=b"segment").digest()
                out.append((first, last, core, int.from_bytes(key, "little", signed=True), int.from_bytes(digest, "little", signed=True)))
    return out


def _finer(hot: DataFrame, docs: DataFrame, length: int, width: int, key_bytes: int) -> DataFrame:
    names = ("a", "b", "at", "key", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            for d, t, runs in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("runs").to_pylist(), strict=True):
                columns = list(zip(*finer(_raw(t), runs, length, width, key_bytes), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(columns[0]), pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *names])

    return _with_texts(hot.select("doc_id", "key", "a", "b", "at"), docs).mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", *names)))


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _covered(raw: bytes, runs: list | None, length: int) -> list[tuple[int, int]]:
    """Maximal removed spans of a document."""
    out: list[list[int]] = []
    for a, b in sorted((r["a"], r["b"] + length) for r in runs or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _repeated(found: DataFrame, length: int) -> DataFrame:
    """Segments that are copies, or differ from others of their key: doc_id, key, a, b, at, copy, bytes (of the key's different ones)."""
    place = F.struct("doc_id", "a")
    contents = found.groupBy("key", "digest").agg(F.min(place).alias("earliest"), F.count("*").alias("copies"), F.max(F.col("b") - F.col("a")).alias("more"))
    of_key = Window.partitionBy("key")
    contents = (
        contents.withColumn("contents", F.count("*").over(of_key))
        .withColumn("bytes", F.sum(F.col("more") + length).over(of_key))
        .where("copies > 1 OR contents > 1")
        .select("key", "digest", "earliest", "contents", "bytes")
    )
    joined = found.join(contents.hint("shuffle_hash"), ["key", "digest"]).withColumn("copy", place != F.col("earliest"))
    return joined.where("copy OR contents > 1").select("doc_id", "key", "a", "b", *(["at"] if "at" in found.columns else []), "copy", "bytes")


def removed_windows(docs: DataFrame, length: int = 100, key_bytes: int = KEY_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, a, b: runs of starts of windows that occur earlier; docs (doc_id, text) with one row for each id."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found, width, out = _segments(docs, length, key_bytes), key_bytes, None
    while found is not None:
        repeated = written(_repeated(found.repartition(parts, "key"), length), "repeated")
        out = repeated.where("copy").select("doc_id", "a", "b") if out is None else out.unionByName(repeated.where("copy").select("doc_id", "a", "b"))
        rest = repeated.where("NOT copy")
        size = F.col("b") - F.col("a") + length
        fits = F.col("bytes") <= shard_bytes
        cold, hot = rest.agg(F.sum(F.when(fits, size)), F.sum(F.when(~fits, size))).first()
        if cold:
            out = out.unionByName(_sorted(rest.where(fits).select("doc_id", "key", "a", "b"), docs, length, -(-cold // shard_bytes)))
        found = None
        if hot:  # the string is a whole window at last, and windows of one key are all equal
            more = rest.where(~fits)
            found = _finer(more if "at" in more.columns else more.withColumn("at", F.lit(-1)), docs, length, width, key_bytes)
            width += -(-(length - width) // 2)
    return out


def dedup(docs: DataFrame, length: int = 100, key_bytes: int = KEY_BYTES) -> DataFrame:
    """One row per document (SCHEMA)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        docs = written(docs.groupBy("doc_id").agg(F.min("text").alias("text")), "documents")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            out = []
            for d, t, runs in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("runs").to_pylist(), strict=True):
                raw = _raw(t)
                spans = _covered(raw, runs, length)
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                out.append((d, len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
            types = (*[pa.int64()] * 4, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    removed = removed_windows(docs, length, key_bytes)
    runs = removed.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    return docs.join(runs, "doc_id", "left").select("doc_id", "text", "runs").mapInArrow(run, SCHEMA)
