"""Language ID by hierarchical discrimination with linear support vector machines.

A text is reduced to lower-case letters and blanks; hashed counts of byte pairs
and of runs of four bytes, as shares of the text, are its features. One-versus-
one linear SVMs first choose the language family, then others, trained within
that family only, choose the language. The SVMs are fitted on the driver on at
most per_language documents of each language and at most `sample` in all (those of
least hash; documented bounds: with very many languages each has fewer). Which
ones is decided from hashes, without their texts. The weights of a handful of
languages are a few hundred kilobytes and are sent to the executors, where a text's score is a sum of looked-up weights over the whole text.

Defined results: a null text, or one without a letter, is `und` with score 0;
with nothing to learn from every text is `und`; with a single learned language
every text with a letter gets it; repeated rows stay repeated; texts of any
length are read whole; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cmp_to_key
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataleaf.llm.frames import slices

PER_LANGUAGE = 300
SAMPLE = 4800
#: Parts of a language whose least hashes are found each by itself.
PARTS = 32
BITS = 13
SCALE = 100.0
UNDETERMINED = "und"
#: Families of languages by ISO 639-1 code; a code not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "be"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indo_aryan": ("hi", "bn", "mr", "ur", "pa", "gu"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
#: Unicode category L, as in fit().
_LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0], lang)


def _bytes(text: str) -> bytes:
    """Letters of the text, in blanks; at least four bytes on either side of nothing."""
    return b" " + " ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).decode("utf-8", "surrogatepass").split()).encode("utf-8", "surrogatepass") + b"   "


def _hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the pair and of the four bytes that begin at each byte but the last three."""
    x = raw.astype(np.uint32)
    pair = x[:-3] * np.uint32(256) + x[1:-2]
    four = (pair << np.uint32(16)) | (x[2:-1] << np.uint32(8)) | x[3:]
    shift = np.uint32(32 - BITS)
    return (pair * np.uint32(2654435761)) >> shift, ((four * np.uint32(2246822519)) >> shift) + np.uint32(1 << BITS)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots and their shares."""
    a, b = _hashes(np.frombuffer(_bytes(text), np.uint8))
    slots, n = np.unique(np.concatenate([a, b]), return_counts=True)
    return slots.astype(np.int32), (n / len(a)).astype(np.float32)


def _combined(shares: np.ndarray, x: np.ndarray) -> np.ndarray:
    """shares @ x, a block of rows at a time, since the product would copy all of x in double precision."""
    return sum((shares[i : i + 128] @ x[i : i + 128] for i in range(0, len(x), 128)), np.zeros(x.shape[1]))


def fit_dual(products: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Share of each row in the weights of a linear SVM (hinge loss; one more, constant feature as bias) by dual coordinate descent. products: of the rows, without bias; y is +1 or -1."""
    gram = products.astype(np.float64)
    gram += 1.0
    alpha, f, rng = np.zeros(len(y)), np.zeros(len(y)), np.random.default_rng(7)
    # Classes of unequal size weigh the same.
    limit = np.where(y > 0, cost * len(y) / (2 * max(1, (y > 0).sum())), cost * len(y) / (2 * max(1, (y < 0).sum())))
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            new = min(max(alpha[i] + (1 - y[i] * f[i]) / gram[i, i], 0.0), limit[i])
            if (step := new - alpha[i]) != 0.0:
                f += step * y[i] * gram[i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return alpha * y


class Model:
    """Pairwise SVMs between families, and within each family between its languages."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        families = [family_of(v) for v in langs]
        self.members = {f: sorted({v for v, w in zip(langs, families, strict=True) if w == f}) for f in sorted(set(families))}
        self.contests: list[tuple[str, str, str]] = []  # level, one, other
        rows, products = [], x @ x.T
        for level, names, of in [("", list(self.members), families), *((f, m, langs) for f, m in self.members.items())]:
            who = np.array(of, dtype=object)
            for one, other in combinations(names, 2):
                use = (who == one) | (who == other)
                shares = np.zeros(len(x))
                shares[use] = fit_dual(products[np.ix_(use, use)], np.where(who[use] == one, 1.0, -1.0))
                rows.append(np.append(_combined(shares, x), shares.sum()).astype(np.float32))
                self.contests.append((level, one, other))
        self.weights = np.array(rows, np.float32).reshape(len(rows), x.shape[1] + 1).T.copy()

    def predict(self, margins: np.ndarray) -> tuple[str, float]:
        """Language and score of a text from its margin in each contest."""
        won = 1.0 / (1.0 + np.exp(-2.0 * np.clip(margins, -30, 30)))

        def choose(level: str, names: list[str]) -> tuple[str, float]:
            if len(names) == 1:
                return names[0], 1.0
            votes, shares = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
            for (at, one, other), p in zip(self.contests, won.tolist(), strict=True):
                if at == level:
                    votes[one if p >= 0.5 else other] += 1
                    shares[one] += p
                    shares[other] += 1 - p
            best = max(names, key=lambda n: (votes[n], shares[n]))
            return best, shares[best] / (len(names) - 1)

        family, p = choose("", list(self.members))
        lang, q = choose(family, self.members[family])
        return lang, p * q


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> DataFrame:
    """lang, text of the documents to learn from: labelled, not held out, each different row once."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.coalesce(~held_out(F.col("doc_id")), F.lit(True)))
    labelled = labelled.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))

    def least(rows: DataFrame, rank: Column, *by: str) -> DataFrame:
        return rows.withColumn("r", rank.over(Window.partitionBy("lang", *by).orderBy("h"))).where(F.col("r") <= per_language)

    # The least hashes of each task first, then of each part of a language, then of the language: no task sends on or reads
    # more than so many of them (a repeated row has one rank). Texts are fetched for the chosen ones alone.
    of_task = least(labelled.select("lang", "h", F.spark_partition_id().alias("task")), F.dense_rank(), "task").select("lang", "h").distinct()
    of_part = least(of_task.withColumn("part", F.pmod(F.xxhash64("h"), F.lit(PARTS))), F.row_number(), "part").select("lang", "h")
    ranked = least(of_part, F.row_number())
    chosen = ranked.orderBy("r", "h", "lang").limit(sample).select("lang", "h")
    found = labelled.join(F.broadcast(chosen), ["lang", "h"])  # at most `sample` rows of two short values
    return found.groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Model | None:
    """Model from training_rows(); None if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            pairs = [features(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("lang"), pa.array([p[0] for p in pairs], pa.list_(pa.int32())), pa.array([p[1] for p in pairs], pa.list_(pa.float32()))],
                ["lang", "slots", "shares"],
            )

    rows = training_rows(docs, per_language, sample).mapInArrow(run, "lang string, slots array<int>, shares array<float>").toArrow()
    if not rows.num_rows:
        return None
    langs, sparse = rows["lang"].to_pylist(), [(i.values.to_numpy(), v.values.to_numpy()) for i, v in zip(rows["slots"], rows["shares"], strict=True)]

    def dense(i: int) -> np.ndarray:
        row = np.zeros(2 << BITS, np.float32)
        row[sparse[i][0]] = sparse[i][1]
        return row

    def compare(i: int, j: int) -> int:
        one, other = ((langs[k], dense(k).tobytes() if langs[i] == langs[j] else b"") for k in (i, j))
        return (one > other) - (one < other)

    order = sorted(range(len(langs)), key=cmp_to_key(compare))  # the same however the rows came
    # The one dense table is filled in place: the driver has room for few copies.
    x = np.empty((len(order), 2 << BITS), np.float32)
    for at, i in enumerate(order):
        np.multiply(dense(i), np.float32(SCALE), out=x[at])
    return Model(x, [langs[i] for i in order])


def _margins(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Margins of texts with a letter, (texts, contests)."""
    raws = [_bytes(t) for t in texts]
    raw = np.frombuffer(b"".join(raws), np.uint8)
    ends = np.cumsum([len(r) for r in raws])
    starts = ends - [len(r) for r in raws]
    out = np.zeros((len(texts), weights.shape[1]))
    if not weights.shape[1]:
        return out
    a, b = _hashes(raw)
    for k in range(weights.shape[1]):
        w = weights[:-1, k]
        total = np.concatenate([[0.0], np.cumsum(w[a] + w[b], dtype=np.float64)])
        out[:, k] = (total[ends - 3] - total[starts]) * SCALE / (ends - 3 - starts) + weights[-1, k]
    return out


SCHEMA = "doc_id long, lang_pred string, score double"


def _predicted(texts: list[str | None], model: Model | None) -> list[tuple[str, float]]:
    out = [(UNDETERMINED, 0.0)] * len(texts)
    if model is not None:
        use = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        if use:
            for i, m in zip(use, _margins([texts[i] for i in use], model.weights), strict=True):
                out[i] = model.predict(m)
    return out


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = _predicted(part.column("text").to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ids.mapInArrow(run, SCHEMA).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def accept(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents whose language can be told, all columns as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = _predicted(part.column("text").to_pylist(), model)
            yield part.filter(pa.array([f[0] != UNDETERMINED for f in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
