"""Packing by Karmarkar-Karp multiway differencing.

Each document becomes its token ids plus a closing id. Full windows are cut off
first and need no padding. What is left of a document is cut into near-equal
pieces of at most piece_tokens and collected, a bounded number at a time, and
each such collection is divided into windows: every piece starts as a partial
partition; the two partitions with the largest spread are merged, largest sum
onto smallest, until one is left, whose windows are near-equal. Where a window
exceeds the capacity, the window count rises and the division is done again.

Pieces never leave the task that made them, so there is no shuffle, memory is
bounded by one collection, and a task that is run again gives the same rows.

Defined results: a null text is empty and has the closing id alone; repeated
rows are packed each for itself; a text of any length is cut into windows;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from strataleaf.llm.frames import slices

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
_ENCODERS: dict[str, Callable[[str], list[int]]] = {}


def encoder(path: str) -> Callable[[str], list[int]]:
    """Encoder of a byte-level BPE vocabulary file.

    Special strings in a text get their one id, as tokenizers gives them. The ids are those of the tokenizers library with this file and
    add_special_tokens=False (tests compare them). The merges are run by tiktoken,
    over ranks read from the same file, which takes a quarter of the CPU time.
    """
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        special = {x["content"]: x["id"] for x in said.get("added_tokens", [])}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {
            chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)
        }
        ranks = {bytes(letters[c] for c in t): i for t, i in said["model"]["vocab"].items() if t not in special}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

        def encode(text: str) -> list[int]:
            if any(x in text for x in special):
                return own.encode(text, allowed_special="all")
            return own.encode_ordinary(text)

        _ENCODERS[path] = encode
    return _ENCODERS[path]


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """Window index of each size, by Karmarkar-Karp differencing into so many windows."""
    parent = np.arange(len(sizes))
    # A partial partition: sums above the least one, largest first, with one member of each window; empty windows are left out.
    heap = [(-int(s), i, np.array([s], np.int64), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    fresh = len(heap)
    while len(heap) > 1:
        _, _, a, ia = heapq.heappop(heap)
        _, _, b, ib = heapq.heappop(heap)
        over = len(a) + len(b) - windows
        if over > 0:  # the smallest of one meet the largest that remain of the other
            parent[ib[len(b) - over :]] = ia[len(a) - over :][::-1]
            met = a[len(a) - over :] + b[len(b) - over :][::-1]
            sums = np.concatenate([a[: len(a) - over], met, b[: len(b) - over]])
            ids = np.concatenate([ia, ib[: len(b) - over]])
        else:
            sums, ids = np.concatenate([a, b]), np.concatenate([ia, ib])
        order = np.argsort(-sums, kind="stable")
        sums, ids = sums[order], ids[order]
        if len(sums) == windows:
            sums = sums - sums[-1]
        heapq.heappush(heap, (-int(sums[0]), fresh, sums, ids))
        fresh += 1
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            break
        parent = up
    return np.unique(parent, return_inverse=True)[1]


def windows_of(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window index of each piece; no window holds more than capacity."""
    count = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        found = differencing(sizes, count)
        fullest = int(np.bincount(found, weights=sizes).max())
        if fullest <= capacity:
            return found
        count = min(len(sizes), max(count + 1, count * fullest // capacity))


def pack(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = 1024,
    end_id: int = 0,
    piece_tokens: int = 256,
    collection: int = 1536,
) -> DataFrame:
    """One row per piece (SCHEMA) for doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(vocabulary), TaskContext.get()
        first = (task.partitionId() if task else 0) << 40
        issued = 0
        whole: list[tuple] = []
        rest: list[tuple] = []

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

        def divided() -> list[tuple]:
            nonlocal issued
            sizes = np.array([x[2] for x in rest], np.int64)
            found = windows_of(sizes, capacity)
            ends, out = np.zeros(found.max() + 1, np.int64), []
            for x, w in zip(rest, found.tolist(), strict=True):
                out.append((*x, first + issued + w, int(ends[w])))
                ends[w] += x[2]
            issued += len(ends)
            rest.clear()
            return out

        for part in slices(batches, "text"):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                n, at = len(ids), 0
                while n - at >= capacity:
                    whole.append((doc_id, at, capacity, zlib.crc32(ids[at : at + capacity].tobytes()), n, first + issued, 0))
                    issued += 1
                    at += capacity
                if at < n:
                    cuts = np.linspace(at, n, -(-(n - at) // piece_tokens) + 1).astype(int).tolist()
                    for a, b in zip(cuts, cuts[1:], strict=False):
                        rest.append((doc_id, a, b - a, zlib.crc32(ids[a:b].tobytes()), n))
                    if len(rest) >= collection:
                        whole += divided()
            if whole:
                yield emit(whole)
                whole = []
        if rest:
            yield emit(divided())

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
