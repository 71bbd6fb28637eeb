"""External induced suffix sorting: disk-backed priority queues that carry prefix values through the recursion.

A string's suffixes are L (greater than the next suffix) or S; the leftmost S
suffixes of runs (LMS) are sorted first: the substrings between them are sorted
and named, and the string of their names is sorted by recursion, over an
alphabet of any width. One sweep upward then induces all L suffixes from them,
one downward all S suffixes.

A sweep's order is that of a priority queue of tuples (suffix, its symbol, the
prefix shared with the one queued before it under that symbol: one more than the
least value scanned between the suffixes that induced the two). Keys are
symbols. The queue is popped in bulk: a symbol with many suffixes first-in
first-out, a range of rarer symbols at once; chains of suffixes that induce
each other within the range are ranked by doubling along the chain.

Values of the recursion count names. They become symbols again as the length of
the shared names plus the least value between the two names that differ, so no
prefix is read off the text but the run of one symbol that an LMS substring ends
in, where an L suffix meets an S suffix.

What grows with the string - text, places, order, prefix values - is in memory up
to memory_bytes and beyond that in mapped scratch files of the task; queues
beyond queue_bytes are written to a scratch file and read back once. Besides
these two, memory holds blocks of BLOCK suffixes and some twenty bytes for each
symbol of the alphabet.
"""

from __future__ import annotations

import tempfile
import weakref
from collections import deque
from collections.abc import Iterator

import numpy as np

CAP = 254
BLOCK = 1 << 17
MEMORY_BYTES = 40 << 20
QUEUE_BYTES = 16 << 20
#: Symbols of fewer suffixes than this are popped together with their neighbours.
RANGE = 1 << 15


class Scratch:
    """Arrays of a task: in memory up to memory_bytes at a time, beyond that in unnamed, mapped files of a folder."""

    def __init__(self, folder: str | None = None, memory_bytes: int = MEMORY_BYTES, queue_bytes: int = QUEUE_BYTES):
        self.folder, self.memory_bytes, self.queue_bytes = folder, memory_bytes, queue_bytes
        self.live = self.mapped = self.spilled = 0

    def file(self):
        return tempfile.TemporaryFile(dir=self.folder)

    def _freed(self, size: int) -> None:
        self.live -= size

    def array(self, n: int, kind) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        if self.live + size <= self.memory_bytes or not size:
            out = np.zeros(n, kind)
            self.live += size
            weakref.finalize(out, self._freed, size)
            return out
        self.mapped += size
        with self.file() as f:
            return np.asarray(np.memmap(f, kind, "w+", shape=(n,)))


class Queues:
    """A first-in first-out queue of tuples (suffix, symbol, prefix value) for each range of symbols."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.chunks = scratch, {}
        self.held, self.file, self.end = 0, None, 0

    def push(self, key: int, *tuple_: np.ndarray) -> None:
        self.chunks.setdefault(key, deque()).append(tuple_)
        self.held += sum(c.nbytes for c in tuple_)

    def spill(self) -> None:
        """If too much is held, writes all of it; to be called between bulks."""
        if self.held <= self.scratch.queue_bytes:
            return
        if self.file is None:
            self.file = self.scratch.file()
        self.file.seek(self.end)
        for queue in self.chunks.values():
            # Only what stands at the end of a queue can be in memory.
            fresh = []
            while queue and isinstance(queue[-1][0], np.ndarray):
                fresh.append(queue.pop())
            for a in range(0, len(fresh), 1024):
                part = fresh[len(fresh) - a - 1 :: -1][:1024]
                columns = [np.concatenate(c) if len(part) > 1 else c[0] for c in zip(*part, strict=True)]
                for begin in range(0, len(columns[0]), BLOCK):
                    cut = [np.ascontiguousarray(c[begin : begin + BLOCK]) for c in columns]
                    queue.append((self.end, len(cut[0]), [c.dtype for c in cut]))
                    for c in cut:
                        self.file.write(c.tobytes())
                        self.end += c.nbytes
        self.scratch.spilled += self.held
        self.held = 0

    def pop(self, key: int, most: int) -> tuple[np.ndarray, ...] | None:
        """The oldest tuples, about most of them; None if there are none."""
        queue, parts, n = self.chunks.get(key), [], 0
        while queue and n < most:
            x = queue.popleft()
            if isinstance(x[0], np.ndarray):
                self.held -= sum(c.nbytes for c in x)
            else:
                at, size, kinds = x
                self.file.seek(at)
                x = tuple(np.frombuffer(self.file.read(size * k.itemsize), k) for k in kinds)
            parts.append(x)
            n += len(x[0])
        if not parts:
            return None
        return parts[0] if len(parts) == 1 else tuple(np.concatenate(c) for c in zip(*parts, strict=True))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _range_minima(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of values[lo..hi], both ends included, for each pair."""
    ends = np.empty(2 * len(lo), np.int64)
    ends[0::2], ends[1::2] = lo, hi + 1
    if np.maximum(np.diff(ends), 0).sum() < 8 * len(values):  # few to read: as they are, else from a table of powers of two
        return np.minimum.reduceat(np.append(values, np.array(CAP, values.dtype)), ends)[0::2]
    span = hi - lo + 1
    level = np.frexp(span.astype(np.float64))[1] - 1
    out = np.empty(len(lo), values.dtype)
    table = np.asarray(values)
    for k in range(int(level.max(initial=0)) + 1):
        if k:
            table = np.minimum(table[: len(table) - (1 << (k - 1))], table[1 << (k - 1) :])
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << k) + 1])
    return out


def _grown(text: np.ndarray, i: np.ndarray, j: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Prefix values of pairs of suffixes that share so many symbols at least, up to CAP."""
    out, n = shared.astype(np.int64), len(text)
    open_ = np.flatnonzero(out < CAP)
    while len(open_):
        a, b = i[open_] + out[open_], j[open_] + out[open_]
        fine = np.maximum(a, b) < n
        fine[fine] = text[a[fine]] == text[b[fine]]
        open_ = open_[fine]
        out[open_] += 1
        open_ = open_[out[open_] < CAP]
    return out.astype(np.uint8)


def _blocks(n: int) -> Iterator[tuple[int, int]]:
    for a in range(0, n, BLOCK):
        yield a, min(n, a + BLOCK)


def _ranked(sym: np.ndarray, kind: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Order of a range's suffixes: by symbol, then queued ones, chained ones by their inducer's rank, seeds; queued and seeds as they come."""

    def dense(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort(keys)
        new = np.zeros(len(order), bool)
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new)
        return rank, order

    chained = kind == 1
    rank, order = dense(np.where(chained, 0, np.arange(len(sym))), kind, sym)
    jump = np.where(chained, parent, -1)
    while rank[order[-1]] + 1 < len(sym):
        on = jump >= 0
        rank, order = dense(np.where(on, rank[jump], -1), rank)
        jump = np.where(on, jump[jump], -1)
    return order


class Sweep:
    """One sweep: scans seeds (given in order of their symbols) and what they induce, in order.

    Symbols are the text's, or for the downward sweep the text's distance from top. A seed
    stands behind the induced suffixes of its symbol. In the naming sweep, seeds are compared
    by their first symbol only.
    """

    def __init__(self, text: np.ndarray, top: int | None, counts: np.ndarray, seeds, naming: bool, scratch: Scratch):
        self.text, self.top, self.seeds, self.naming, self.scratch = text, top, seeds, naming, scratch
        width = len(counts)
        # Ranges: a symbol of many suffixes by itself, others with their neighbours.
        own = counts >= RANGE
        before = np.cumsum(np.where(own, 0, counts)) // RANGE
        turn = np.zeros(width, bool)
        turn[1:] = own[1:] | own[:-1] | (before[1:] != before[:-1])
        self.range_of = np.cumsum(turn).astype(np.int32)
        self.starts = np.concatenate([[0], np.flatnonzero(turn), [width]])
        self.least = np.full(width, CAP, np.uint8)  # of what was scanned since the last push, by symbol
        self.begun = np.zeros(width, bool)
        self.queues = Queues(scratch)

    def symbol(self, places: np.ndarray) -> np.ndarray:
        found = self.text[places]
        return found.astype(np.int64) if self.top is None else self.top - found.astype(np.int64)

    def induced(self, places: np.ndarray, sym: np.ndarray, seed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of the suffixes induce one, those, their symbols)."""
        at = np.flatnonzero(places > 0)
        before = places[at] - 1
        to = self.symbol(before)
        c, s = sym[at], seed[at] if isinstance(seed, np.ndarray) else seed
        # One of the same symbol as its follower is of the follower's type.
        fine = (to > c) | ((to == c) & ~s if isinstance(s, np.ndarray) else (to == c) & (not s))
        return at[fine], before[fine], to[fine]

    def scan(self, places: np.ndarray, sym: np.ndarray, shared: np.ndarray, seed, floor: int) -> None:
        """Queues what these suffixes induce under symbols of at least floor."""
        at, moved, to = self.induced(places, sym, seed)
        up = to >= floor
        at, moved, to = at[up], moved[up], to[up]
        if len(at):
            order = np.argsort(to, kind="stable")
            at, moved, to = at[order], moved[order], to[order]
            heads = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            ends = np.concatenate([heads[1:], [len(to)]])
            keys = to[heads]
            new = np.empty(len(at), np.uint8)
            inner = np.ones(len(at), bool)
            inner[heads] = False
            inner = np.flatnonzero(inner)
            if len(inner):
                new[inner] = np.minimum(_range_minima(shared, at[inner - 1] + 1, at[inner]), CAP - 1) + 1
            first = np.minimum(np.minimum.accumulate(shared)[at[heads]], self.least[keys])
            new[heads] = np.where(self.begun[keys], np.minimum(first, CAP - 1) + 1, 0)
        np.minimum(self.least, shared.min(), out=self.least)
        if not len(at):
            return
        after = np.concatenate([np.minimum.accumulate(shared[::-1])[::-1], np.array([CAP], np.uint8)])
        self.least[keys] = after[at[ends - 1] + 1]
        self.begun[keys] = True
        ranges = self.range_of[keys]
        cut = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]]))
        kind = self.text.dtype if self.top is None else np.int64
        to = to.astype(kind)
        bounds = [*heads[cut].tolist(), len(to)]
        for r, a, b in zip(ranges[cut].tolist(), bounds, bounds[1:], strict=False):
            # Copies, since a slice would hold on to its whole bulk.
            self.queues.push(r, moved[a:b].copy(), to[a:b].copy(), new[a:b].copy())
        self.queues.spill()

    def met(self, last: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Values of seeds that stand right behind an induced suffix of their symbol."""
        one = np.ones(len(first), np.uint8)
        return one if self.naming else _grown(self.text, last, first, one)

    def run(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Bulks (suffixes, prefix shared with the one before, is seed), in order."""
        for r, (lo, hi) in enumerate(zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True)):
            yield from self._many(r, lo) if hi - lo == 1 else self._range(r, lo, hi)
        self.queues.close()

    def _many(self, r: int, symbol: int):
        last = -1
        while (got := self.queues.pop(r, BLOCK)) is not None:
            places, sym, shared = got
            places, last = places.astype(np.int64), int(places[-1])
            yield places, shared, np.zeros(len(places), bool)
            self.scan(places, sym, shared, False, symbol)
        for places, sym, shared in self.seeds(symbol, symbol + 1):
            if last >= 0:
                shared[:1] = self.met(np.array([last]), places[:1])
                last = -1
            yield places, shared, np.ones(len(places), bool)
            self.scan(places, sym, shared, True, symbol + 1)

    def _range(self, r: int, lo: int, hi: int):
        got = self.queues.pop(r, 1 << 62)
        a_pos, a_sym, a_shared = got if got is not None else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8))
        turn = np.argsort(a_sym, kind="stable")
        parts = [(a_pos[turn].astype(np.int64), a_sym[turn].astype(np.int64), a_shared[turn]), *self.seeds(lo, hi)]
        queued = len(a_pos)
        pos, sym, shared = (np.concatenate(c) for c in zip(*parts, strict=True))
        if not len(pos):
            return
        kind = np.where(np.arange(len(pos)) < queued, 0, 2).astype(np.int8)
        parent = np.full(len(pos), -1, np.int64)
        places, syms, kinds, parents = [pos], [sym], [kind], [parent]
        begin = 0
        while True:  # what the range induces within itself
            at, moved, to = self.induced(places[-1], syms[-1], kinds[-1] == 2)
            inside = to < hi
            if not inside.any():
                break
            at, moved, to = at[inside], moved[inside], to[inside]
            parents.append(at + begin)
            begin += len(places[-1])
            places.append(moved)
            syms.append(to)
            kinds.append(np.ones(len(to), np.int8))
        pos, sym, kind, parent = (np.concatenate(c) for c in (places, syms, kinds, parents))
        shared = np.concatenate([shared, np.zeros(len(pos) - len(shared), np.uint8)])
        if len(places) > 1 or queued < len(pos):
            order = _ranked(sym, kind, parent)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            pos, sym, kind, shared = pos[order], sym[order], kind[order], shared[order]
            same = np.concatenate([[False], sym[1:] == sym[:-1]])
            shared[~same] = 0
            if (joint := np.flatnonzero(same & (kind == 2) & (np.concatenate([[2], kind[:-1]]) != 2))).size:
                shared[joint] = self.met(pos[joint - 1], pos[joint])
            chained = np.flatnonzero(same & (kind == 1))
            if len(chained):
                by = np.where(parent[order] >= 0, rank[parent[order]], -1)
                # Behind a queued one, whose inducer has a smaller symbol, only the first symbol is shared.
                shared[chained] = 1
                chained = chained[kind[chained - 1] == 1]
                shared[chained] = CAP
                first, last = by[chained - 1] + 1, by[chained]
                while len(chained):  # each value rests on values further left
                    new = np.minimum(_range_minima(shared, first, last), CAP - 1) + 1
                    if np.array_equal(new, shared[chained]):
                        break
                    shared[chained] = new
                    more = new > 1  # the others are final
                    chained, first, last = chained[more], first[more], last[more]
        yield pos, shared, kind == 2
        self.scan(pos, sym, shared, kind == 2, hi)


def _leftmost(text: np.ndarray, place, scratch: Scratch) -> np.ndarray:
    """Places of LMS suffixes, ascending, from right to left in blocks."""
    n = len(text)
    out = scratch.array(n // 2 + 1, place)
    free, is_s, stop = len(out), True, n - 1
    while stop > 0:
        a = max(0, stop - BLOCK)
        x = np.asarray(text[a : stop + 1])
        differ, rising = x[1:] != x[:-1], x[1:] > x[:-1]
        m = len(differ)
        nearest = np.minimum.accumulate(np.where(differ, np.arange(m), m)[::-1])[::-1]
        s = np.append(np.append(rising, is_s)[nearest], is_s)
        found = np.flatnonzero(s[1:] & ~s[:-1]) + a + 1
        out[free - len(found) : free] = found
        free -= len(found)
        is_s, stop = bool(s[0]), a
    return out[free:]


def _counted(text: np.ndarray, width: int) -> np.ndarray:
    counts = np.zeros(width, np.int64)
    for a, b in _blocks(len(text)):
        found = np.bincount(text[a:b])
        counts[: len(found)] += found
    return counts


def _bucketed(text: np.ndarray, lms: np.ndarray, width: int, scratch: Scratch) -> np.ndarray:
    """LMS places by first symbol."""
    at = np.zeros(width, np.int64)
    for a, b in _blocks(len(lms)):
        found = np.bincount(text[lms[a:b]])
        at[: len(found)] += found
    at = np.cumsum(at) - at
    out = scratch.array(len(lms), lms.dtype)
    for a, b in _blocks(len(lms)):
        places = np.asarray(lms[a:b])
        sym = text[places]
        order = np.argsort(sym, kind="stable")
        sym, places = sym[order], places[order]
        heads = np.flatnonzero(np.concatenate([[True], sym[1:] != sym[:-1]]))
        sizes = np.diff(np.append(heads, len(sym)))
        out[np.repeat(at[sym[heads]] - heads, sizes) + np.arange(len(sym))] = places
        at[sym[heads]] += sizes
    return out


def _seeds(text: np.ndarray, top: int | None, places, shared, n_seeds: int, counts: np.ndarray):
    """Reader of seeds by symbol; counts: seeds of each symbol; places(a, b) and shared(a, b) read in the sweep's order."""
    bounds = np.concatenate([[0], np.cumsum(counts)])

    def read(lo: int, hi: int):
        for a in range(int(bounds[lo]), int(bounds[hi]), BLOCK):
            b = min(int(bounds[hi]), a + BLOCK)
            p = places(a, b).astype(np.int64)
            sym = text[p].astype(np.int64)
            yield p, (sym if top is None else top - sym), shared(a, b)

    return read


def _induced(text: np.ndarray, counts: np.ndarray, seeds: np.ndarray, seed_shared: np.ndarray | None, scratch: Scratch):
    """Bulks (suffixes, prefix shared with the suffix before, which is the greater one) of all but the last suffix, from the greatest down."""
    width = len(counts)
    top, naming = width - 1, seed_shared is None
    of_seeds = np.zeros(width, np.int64)
    for a, b in _blocks(len(seeds)):
        found = np.bincount(text[seeds[a:b]])
        of_seeds[: len(found)] += found

    def first_only(a: int, b: int) -> np.ndarray:
        # Seeds of one symbol are not told apart; where a symbol begins, nothing is shared.
        out = np.ones(b - a, np.uint8)
        heads = np.cumsum(of_seeds) - of_seeds
        heads = heads[(of_seeds > 0) & (heads >= a) & (heads < b)]
        out[heads - a] = 0
        return out

    read = _seeds(text, None, lambda a, b: np.asarray(seeds[a:b]), first_only if naming else lambda a, b: np.array(seed_shared[a:b]), len(seeds), of_seeds)
    large = scratch.array(len(text), seeds.dtype)
    values = scratch.array(len(text) + 1, np.uint8)
    of_large, m = np.zeros(width, np.int64), 0
    for places, shared, is_seed in Sweep(text, None, counts, read, naming, scratch).run():
        keep = ~is_seed
        n = int(keep.sum())
        if n:
            large[m : m + n], values[m : m + n] = places[keep], shared[keep]
            found = np.bincount(text[places[keep]])
            of_large[: len(found)] += found
            m += n
    values[m] = 0
    # Greatest first: each shares with the one read before it what the latter shared with it.
    read = _seeds(
        text, top, lambda a, b: large[m - b : m - a][::-1], lambda a, b: values[m - b + 1 : m - a + 1][::-1].copy(), m, of_large[::-1]
    )
    yield from Sweep(text, top, counts[::-1], read, naming, scratch).run()


def _named(text: np.ndarray, counts: np.ndarray, lms: np.ndarray, scratch: Scratch):
    """LMS places by their substrings, the string of names, and the prefix value of each name with the name before it."""
    n, m = len(text), len(lms)
    width = len(counts)
    is_lms = scratch.array(n, bool)
    for a, b in _blocks(m):
        is_lms[lms[a:b]] = True
    order, between = scratch.array(m, lms.dtype), scratch.array(m + 1, np.uint8)
    at, least = m, CAP
    for places, shared, _ in _induced(text, counts, _bucketed(text, lms, width, scratch), None, scratch):
        found = np.flatnonzero(is_lms[places])
        if not len(found):
            least = min(least, int(shared.min()))
            continue
        # lows[k]: least of the values after the LMS suffix before, up to this one.
        cuts = np.concatenate([[0], found[:-1] + 1])
        lows = np.minimum.reduceat(shared, cuts)
        if found[-1] + 1 < len(shared):
            lows[-1] = shared[cuts[-1] : found[-1] + 1].min()
        lows[0] = min(int(lows[0]), least)
        k = len(found)
        order[at - k : at] = places[found][::-1]
        # Ascending, the value of a place is with its smaller neighbour: that of the next one scanned.
        between[at - k + 1 : at + 1] = lows[::-1]
        at -= k
        least = int(shared[found[-1] + 1 :].min()) if found[-1] + 1 < len(shared) else CAP
    # The last suffix, which is LMS, is the least and is not scanned.
    order[0], between[0], between[1 if m > 1 else 0] = n - 1, 0, 0
    names, adjacent, name = scratch.array(m, np.uint32), scratch.array(m, np.uint8), 0
    for a, b in _blocks(m):
        places = np.asarray(order[max(0, a - 1) : b])
        row = np.searchsorted(lms, places)
        size = np.where(row + 1 < m, lms[np.minimum(row + 1, m - 1)] - places + 1, 1)
        value = np.asarray(between[a:b]).astype(np.int64)
        if not a:
            size, row = np.append(0, size), np.append(0, row)
        # A value at the cap says no more than that so many symbols agree; longer substrings are compared.
        new = (size[1:] != size[:-1]) | (value < size[1:])
        for k in np.flatnonzero((size[1:] == size[:-1]) & (value >= CAP) & (size[1:] > CAP)).tolist():
            i, j = int(lms[row[k]]), int(lms[row[k + 1]])
            new[k] = not np.array_equal(text[i : i + size[k]], text[j : j + size[k]])
        if not a:
            new[0] = False
        number = name + np.cumsum(new)
        names[row[1:]] = number
        adjacent[number[new]] = np.minimum(value, CAP)[new]
        name = int(number[-1])
    return order, names, adjacent[: name + 1], name + 1


def _seed_values(text, lms, order, names, adjacent, deeper, scratch: Scratch) -> np.ndarray:
    """Prefix values of sorted LMS suffixes, in symbols; deeper: their shared names, or None if all names differ."""
    m = len(lms)
    out = scratch.array(m, np.uint8)
    for a, b in _blocks(m):
        a1 = max(1, a)
        if a1 >= b:
            continue
        i, j = np.asarray(order[a1 - 1 : b - 1]), np.asarray(order[a1:b])
        k = np.zeros(b - a1, np.int64) if deeper is None else np.asarray(deeper[a1:b]).astype(np.int64)
        x, y = np.minimum(i + k, m - 1), np.minimum(j + k, m - 1)
        past = np.minimum(lms[x] - lms[i], CAP).astype(np.int64)
        one, other = names[x].astype(np.int64), names[y].astype(np.int64)
        lo, hi = np.minimum(one, other), np.maximum(one, other)
        rest = np.full(len(i), CAP, np.int64)  # shared names up to the cap: so many symbols and more
        differ = hi > lo
        rest[differ] = _range_minima(adjacent, lo[differ] + 1, hi[differ])
        value = np.minimum(past + rest, CAP)
        # Where one substring ends in a run of one symbol the other run may go on.
        out[a1:b] = _grown(text, lms[i].astype(np.int64), lms[j].astype(np.int64), value)
    return out


def suffix_order(text: np.ndarray, scratch: Scratch | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, prefix shared with the one before, up to CAP) of an array of whole numbers.

    The last number must be the only least one.
    """
    scratch = scratch or Scratch()
    n = len(text)
    place = np.int32 if n < 1 << 31 else np.int64
    order, shared = scratch.array(n, place), scratch.array(n, np.uint8)
    if n == 1:
        return order, shared
    width = max(int(text[a:b].max()) for a, b in _blocks(n)) + 1
    counts = _counted(text, width)
    lms = _leftmost(text, place, scratch)
    rows, names, adjacent, found = _named(text, counts, lms, scratch)
    if found < len(lms):
        by_name, deeper = suffix_order(names, scratch)
    else:
        by_name, deeper = scratch.array(len(lms), place), None
        for a, b in _blocks(len(lms)):
            by_name[a:b] = np.searchsorted(lms, rows[a:b])
    values = _seed_values(text, lms, by_name, names, adjacent, deeper, scratch)
    seeds = rows  # no longer needed
    for a, b in _blocks(len(lms)):
        seeds[a:b] = lms[by_name[a:b]]
    del by_name, deeper, names, adjacent, rows
    at = n
    order[0] = n - 1
    for places, between, _ in _induced(text, counts, seeds, values, scratch):
        k = len(places)
        order[at - k : at] = places[::-1]
        # The first one scanned, the greatest, has no greater neighbour; its value is 0 and falls away.
        high = min(n, at + 1)
        shared[at - k + 1 : high] = between[::-1][: high - (at - k + 1)]
        at -= k
    shared[:2] = 0
    return order, shared
