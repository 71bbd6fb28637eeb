"""N-gram Jaccard join with a count-vector R-tree.

1. One pass turns each whole text into its set of hashed word shingles; documents
   with equal sets form a class, and only the class's least document goes on.
2. The shingles of a set are hashed into as many groups as let every linked pair
   agree on some whole group: sets of x and y shingles with Jaccard similarity of
   at least t differ in at most (x+y)(1-t)/(1+t) shingles, hence in no more groups.
   The contents of a group are its key, so linked classes meet under a key; where
   the agreement is on empty groups only, triples of these are keys.
3. Under each key the classes are points - their shingle counts in 512 other
   groups - of an R-tree. The overlap of two sets is at most the sum of the
   lesser coordinates, and with a node's largest coordinates the same bounds
   every set below it. Pairs that survive are verified on whole shingle sets.
   A first round compares each key's least class with the rest; its links make
   components, and the second round leaves out pairs that these already join.
4. Components are found by star contraction of the link table.

Nothing is capped: a key with very many classes is searched in blocks of bounded
size, each pair of blocks by itself; equal lists of classes are searched once.

Defined results: a null text, an empty one or one of white space has no shingle,
links with nothing and is a component by itself; with fewer words than a shingle
has, the whole sequence is one shingle; repeated rows are members of one class;
rows with an equal doc_id and other text are distinct documents of one id and
share its component; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataleaf.llm.components import components
from strataleaf.llm.frames import forget, only_ids, slices, without_ids, written
from strataleaf.llm.shingles import mixed, shingle_sets

GROUPS = 512
FULL = 255
LEAF = 32
BLOCK = 4096
#: Keys keep 48 bits: two that fall together by chance cost a comparison and change no result.
KEY_SHIFT = 16


def band(n: int) -> int:
    """Sets of 2**b to 2**(b+1) - 1 shingles are band b."""
    return n.bit_length() - 1


class Threshold:
    """Jaccard similarity of at least percent / 100, in whole numbers."""

    def __init__(self, percent: int):
        self.percent = percent

    def holds(self, overlap: int, one: int, other: int) -> bool:
        return 100 * overlap >= self.percent * (one + other - overlap)

    def least_overlap(self, total):
        """Least overlap of linked sets whose sizes add up to total."""
        return -(-(self.percent * total) // (100 + self.percent))

    def most_partner(self, n: int) -> int:
        return 100 * n // self.percent

    def most_differences(self, total: int) -> int:
        """Largest symmetric difference of linked sets whose sizes add up to total."""
        return (100 - self.percent) * total // (100 + self.percent)

    def instances(self, n: int) -> list[tuple[int, int, int]]:
        """(number, least size, largest symmetric difference) of the groupings that a set of n shingles takes part in.

        Linked sets of one band meet in the band's grouping, those on either side of a band's
        beginning in the grouping of that beginning.
        """
        b = band(n)
        out = [(2 * b, 1 << b, self.most_differences(2 * ((2 << b) - 1)))]
        for edge, below in ((1 << b, False), (2 << b, True)):
            least, most = -(-self.percent * edge // 100), self.most_partner(edge - 1)
            if (n >= least) if below else (n <= most):
                out.append((2 * band(edge) - 1, least, self.most_differences(edge - 1 + most)))
        return out


def keys_of(shingles: np.ndarray, threshold: Threshold) -> np.ndarray:
    """Keys of a set: any two linked sets have one in common."""
    n, out = len(shingles), []
    if not n:
        return np.zeros(0, np.int64)
    content = mixed(shingles)
    for number, least, differences in threshold.instances(n):
        # Spare groups, for so many may be empty in the least of these sets.
        k = differences + 1
        spare = 2 + int(1.3 * k * math.exp(-least / k)) if differences else 0
        k += spare
        group = ((shingles >> np.uint64(16)) % np.uint64(k)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        group = group[order]
        at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sums = np.add.reduceat(content[order], at)
        out.append(mixed(sums + mixed((group[at] + (number << 40)).astype(np.uint64))))
        if (empty := k - len(at)) > spare:
            # Linked sets agree on spare + 1 groups at least; if all of those are empty, three of them are among the first so many of each.
            first = np.setdiff1d(np.arange(k), group)[: empty - spare + 2]
            triples = np.array(list(combinations(first.tolist(), 3)), np.uint64).reshape(-1, 3)
            out.append(mixed(mixed(mixed(triples[:, 0] + np.uint64((number << 40) + 7)) + triples[:, 1]) + triples[:, 2]))
    return np.unique(np.concatenate(out) >> np.uint64(KEY_SHIFT)).view(np.int64)


def counts_of(shingles: np.ndarray) -> np.ndarray:
    """The set as a point: shingles in each group."""
    return np.minimum(np.bincount((shingles >> np.uint64(3)) % np.uint64(GROUPS), minlength=GROUPS), FULL).astype(np.uint8)


def overlap_bound(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sums of lesser coordinates, row by row; a coordinate that is full may stand for more, so such a sum is boundless."""
    least = np.minimum(p, q)
    out = least.sum(axis=1, dtype=np.int64)
    if least.size and least.max() == FULL:
        out[(least == FULL).any(axis=1)] = 1 << 40
    return out


class CountTree:
    """R-tree over count vectors, packed by set size; a node keeps its largest coordinates and its range of sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, threshold: Threshold):
        self.threshold = threshold
        # Like points lie together: by size, and within strips of like size by their heaviest groups.
        strip = np.argsort(np.argsort(sizes, kind="stable"), kind="stable") // (LEAF * 8)
        self.order = np.lexsort((points[:, 1], points[:, 0], strip)) if len(points) > LEAF else np.arange(len(points))
        self.points, self.sizes = points[self.order], sizes[self.order]
        starts = np.arange(0, len(points), LEAF)
        self.levels = [(np.maximum.reduceat(self.points, starts), np.minimum.reduceat(self.sizes, starts), np.maximum.reduceat(self.sizes, starts))]
        while len(self.levels[-1][0]) > LEAF:
            top, low, high = self.levels[-1]
            at = np.arange(0, len(top), LEAF)
            self.levels.append((np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def _may(self, q: np.ndarray, n: int, top, low, high) -> np.ndarray:
        fits = (self.threshold.percent * low <= 100 * n) & (100 * high >= self.threshold.percent * n)
        fits[fits] = overlap_bound(top[fits], q[None]) >= self.threshold.least_overlap(n + low[fits])
        return fits

    def search(self, q: np.ndarray, n: int) -> np.ndarray:
        """Places of the points that may be linked with a set of n shingles at q."""
        nodes = np.arange(len(self.levels[-1][0]))
        for top, low, high in reversed(self.levels):
            nodes = nodes[nodes < len(top)]
            nodes = nodes[self._may(q, n, top[nodes], low[nodes], high[nodes])]
            if not len(nodes):
                return nodes
            nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
        nodes = nodes[nodes < len(self.sizes)]
        return self.order[nodes[self._may(q, n, self.points[nodes], self.sizes[nodes], self.sizes[nodes])]]


def _bytes(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def _mapped(docs: DataFrame, width: int, columns: dict) -> DataFrame:
    """doc_id and, for each name, what a function makes of the document's shingle set; columns: name to (type, Arrow type, function)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = shingle_sets(_bytes(part.column("text").to_pylist()), width)
            made = [pa.array([f(s) for s in sets], kind) for _, kind, f in columns.values()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made], ["doc_id", *columns])

    return docs.mapInArrow(run, ", ".join(["doc_id long", *(f"{n} {c[0]}" for n, c in columns.items())]))


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


SIZE = ("long", pa.int64(), len)
DIGEST = ("binary", pa.binary(), _digest)
POINT = ("binary", pa.binary(), lambda s: counts_of(s).tobytes())
SHINGLES = ("binary", pa.binary(), lambda s: s.tobytes())


def _points(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, GROUPS)


def _bounded(pairs: DataFrame, points: DataFrame, threshold: Threshold) -> DataFrame:
    """The pairs (a, b) that the bound on overlap lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                bound = overlap_bound(_points(part.column("pa")), _points(part.column("pb")))
                total = part.column("na").to_numpy() + part.column("nb").to_numpy()
                yield part.select(["a", "b"]).filter(pa.array(bound >= threshold.least_overlap(total)))

    one = points.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("point").alias("pa"))
    other = points.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("point").alias("pb"))
    sizes = pairs.join(other.drop("pb"), "b").join(one.drop("pa"), "a").where(
        (F.lit(threshold.percent) * F.col("na") <= 100 * F.col("nb")) & (F.lit(threshold.percent) * F.col("nb") <= 100 * F.col("na"))
    )
    near = sizes.select("a", "b").distinct().join(other, "b").join(one, "a")
    return near.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, "a long, b long")


def _searched(members: DataFrame, threshold: Threshold) -> DataFrame:
    """Pairs that the tree of a block lets through: rows (key, i, j, side, rep, n, point, component, least)."""

    def block(table: pa.Table) -> pa.Table:
        side, rep, comp = (table.column(c).to_numpy() for c in ("side", "rep", "component"))
        least = table.column("least")[0].as_py()
        n, points = table.column("n").to_numpy(), _points(table.column("point"))
        one = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        right = np.flatnonzero(side >= 0) if one else np.flatnonzero(side == 1)
        left = right if one else np.flatnonzero(side == 0)
        a, b = [], []
        if len(right) and len(left):
            tree = CountTree(points[right], n[right], threshold)
            for k in left.tolist():
                if rep[k] == least:
                    continue  # compared in the first round
                found = right[tree.search(points[k], int(n[k]))]
                found = found[(comp[found] != comp[k]) & (rep[found] != least)]
                if one:
                    found = found[rep[found] > rep[k]]
                a += [rep[k]] * len(found)
                b += rep[found].tolist()
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.repartition(parts, "key", "i", "j").groupBy("key", "i", "j").applyInArrow(block, "a long, b long").distinct()


def _linked(pairs: DataFrame, docs: DataFrame, width: int, threshold: Threshold) -> DataFrame:
    """The pairs whose whole sets are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            keep = []
            for x, y in zip(part.column("sa").to_pylist(), part.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                keep.append(threshold.holds(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ends = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = written(_mapped(only_ids(docs, written(ends, "ends"), "doc_id"), width, {"shingles": SHINGLES}), "sets")
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    other = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    links = written(pairs.join(other, "b").join(one, "a").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct(), "links")
    forget(sets)
    return links


def join(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    threshold = Threshold(percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = written(_mapped(docs, width, {"n": SIZE, "digest": DIGEST, "point": POINT}), "described")
    classes = written(described.where("n > 0").groupBy("digest", "n").agg(F.min("doc_id").alias("rep")), "classes")
    # A class goes on as its least document. A document that is the least of no class is left out; one id may have several texts.
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()
    copies = written(described.select("doc_id").distinct().join(reps, "doc_id", "left_anti"), "copies")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = _mapped(without_ids(docs, copies, "doc_id"), width, {"keys": ("array<long>", pa.list_(pa.int64()), lambda s: keys_of(s, threshold))})
    # The filter is what the join below would add; stated here, both readers share one exchange.
    keyed = keys.select(F.explode("keys").alias("key"), F.col("doc_id").alias("rep")).where("key IS NOT NULL").repartition(parts, "key")
    shared = (
        keyed.groupBy("key")
        .agg(F.count("*").alias("c"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("h"), F.min("rep").alias("least"), F.max("rep").alias("most"))
        .where("least < most")
        .groupBy("c", "h", "least")
        .agg(F.min("key").alias("key"))
    )
    members = written(keyed.join(shared.hint("shuffle_hash"), "key").select("key", "c", "least", "rep").distinct(), "members")
    candidates = written(members.select(F.col("rep").alias("doc_id")).distinct(), "candidates")
    points = only_ids(described.where("n > 0").select("doc_id", "n", "point"), candidates, "doc_id")
    points = written(points.select(F.col("doc_id").alias("rep"), "n", "point").distinct(), "points")
    forget(copies, candidates)  # what is written after them no longer reads them
    first = members.where("rep != least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
    links = _linked(written(_bounded(first, points, threshold), "pairs"), docs, width, threshold)
    joined = components(links)
    # Second round: keys of three classes and more that the first did not make one component.
    labelled = (
        members.where("c > 2")
        .join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .withColumn("component", F.coalesce("component", "rep"))
    )
    open_keys = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("key")
    blocks = F.ceil(F.col("c") / F.lit(BLOCK)).cast("int")
    mine = F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")).cast("int")
    spread = (
        labelled.join(open_keys, "key", "left_semi")
        .join(points, "rep")
        .withColumn("blocks", blocks)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "key",
            F.least("mine", "other").alias("i"),
            F.greatest("mine", "other").alias("j"),
            (F.col("mine") >= F.col("other")).cast("int").alias("side"),
            "rep",
            "n",
            "point",
            "component",
            "least",
        )
    )
    second = written(_searched(spread, threshold), "pairs")
    forget(members, points)
    more = _linked(second, docs, width, threshold)
    forget(second)
    final = components(links.unionByName(more))
    by_class = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select(
        "digest", F.coalesce("component", "rep").alias("component")
    )
    return (
        described.select("doc_id", "n", "digest")
        .join(by_class, "digest", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    )


def representatives(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents but one of each component, all columns as they were.

    The least doc_id of a component stays. Where ids are missing or repeat, rows are
    documents of their own: they go only for what their own text is near to, and of a
    component the row of least doc_id (none last), then least text, stays.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("rows"))
    if not ids.where("rows > 1 OR doc_id IS NULL").limit(1).count():
        groups = written(join(docs, width, percent), "groups")
        gone = written(groups.where("doc_id != component_id").select("doc_id").distinct(), "gone")
        return without_ids(docs, gone, "doc_id")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = F.col("doc_id").asc_nulls_last()
    rest = [c for c, kind in docs.dtypes if c not in ("doc_id", "text") and not kind.startswith("map")]
    # Ranges are cut by the beginnings of texts, since bounds are sampled to the driver; rows with one beginning lie in one range.
    ordered = docs.repartitionByRange(parts, first, F.substring("text", 1, 64)).sortWithinPartitions(first, "text", *rest)
    numbered = written(ordered.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    groups = written(join(numbered.select(F.col("__row").alias("doc_id"), "text"), width, percent), "groups")
    gone = written(groups.where("doc_id != component_id").select(F.col("doc_id").alias("__row")), "gone")
    return without_ids(numbered, gone, "__row").drop("__row")
