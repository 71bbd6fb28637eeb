"""PII by offset-preserving deobfuscation.

Two transducers rewrite a text and keep, for every character they write, the
source range that it came from: one folds look-alike characters (full-width
forms, digits of other scripts, Cyrillic and Greek look-alikes, invisible
characters), the other rewrites spelled digits and disguised at and dot signs.
Identifiers are detected in the source and in the rewritten text, and spans of
the rewritten text are mapped back to source characters. Spans found in the
source always stay; a rewritten one is added where it overlaps none of its kind.

Kinds and base patterns: email, ip (parts at most 255), card (16 to 19 digits,
Luhn), phone (8 to 15 digits); leftmost and non-overlapping for each kind; a
match that fails its test is dropped and not tried again.

Defined results: a null text counts as empty and has no spans; repeated rows
stay repeated; texts of any length are read whole; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import string
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strataleaf.llm.frames import slices

KINDS = ("email", "ip", "card", "phone")
#: An email's characters before the at sign, and what follows it.
_LOCAL = string.ascii_letters + string.digits + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# From the second digit of a run on, a match fails or succeeds as it does from the first.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

#: Look-alikes of ASCII letters in Cyrillic and Greek.
LOOKALIKES = dict(
    zip(
        "АВЕКМНОРСТУХаеорсухіјѕԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαν",
        "ABEKMHOPCTYXaeopcyxijsdqwABEZHIKMNOPTYXoav",
        strict=True,
    )
)
#: Spelled digits in the corpus languages, 0 to 9.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_WORD = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
#: A run of spelled digits, at least four, with plain digits between them allowed.
_SPELLED = re.compile(rf"(?i)\b{_WORD}(?:[\x20,().-]{{0,3}}(?:\b{_WORD}\b|[0-9])){{3,}}")
_SPELLED_ONE = re.compile(rf"(?i)\b{_WORD}\b|[0-9]")
_PLUS = re.compile(rf"(?i)\bplus[\x20]+(?=[0-9]|{_WORD}\b)")
_AT = re.compile(r"(?i)[\x20]{0,3}[\[({<][\x20]{0,3}(?:at|@|arroba|chez)[\x20]{0,3}[\])}>][\x20]{0,3}|&#64;|&commat;|%40|(?<=[a-z0-9])[_-]at[_-](?=[a-z0-9])|(?<=[a-z0-9])[\x20]@[\x20](?=[a-z0-9])")
_DOT = re.compile(r"(?i)[\x20]{0,3}[\[({<][\x20]{0,3}(?:dot|punkt|point|punto|\.)[\x20]{0,3}[\])}>][\x20]{0,3}|&#46;|&period;|(?<=[a-z0-9])[_-]dot[_-](?=[a-z0-9])")
_SAID = re.compile(r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+[\x20]{1,3}(at|arroba)[\x20]{1,3}[A-Za-z0-9-]+(?:(?:[\x20]{1,3}dot[\x20]{1,3}|\.)[A-Za-z0-9-]+)*[\x20]{1,3}dot[\x20]{1,3}[A-Za-z]{2,}\b")
_SAID_PART = re.compile(r"(?i)[\x20]{1,3}(at|arroba|dot)(?=[\x20])[\x20]{1,3}")
_SPELLED_DOT = re.compile(r"(?i)(?<=[0-9])[\x20]{1,3}(?:dot|point|punkt|punto)[\x20]{1,3}(?=[0-9])")
#: A number in which letters stand for digits: at least one digit and one such letter, and nothing else.
_MIXED = re.compile(r"(?<![A-Za-z0-9])(?:[0-9]+[OoIl]|[OoIl]+[0-9])[0-9OoIl]*(?![A-Za-z0-9])")
_LETTER_DIGITS = str.maketrans("OoIl", "0011")
_ODD = re.compile(r"[^\x00-\x7f¡-¬®-ɏ一-鿿가-힣぀-ヿ]")
#: The gate: wherever _AT, _DOT, _SAID, _PLUS or _SPELLED_DOT match, this matches too.
_SIGNS = re.compile(r"(?i)[\[({<][\x20]{0,3}(?:at|@|arroba|chez|dot|punkt|point|punto|\.)[\x20]{0,3}[\])}>]|&#(?:64|46);|&commat;|&period;|%40|\bdot\b|\bplus[\x20]|[_-](?:at|dot)[_-]|[\x20]@[\x20]|[0-9][\x20]{1,3}(?:point|punkt|punto)[\x20]{1,3}[0-9]")


def _folded(c: str) -> str:
    """What a single character is read as; empty for invisible ones."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    kind = unicodedata.category(c)
    if kind == "Cf":
        return ""
    if kind == "Nd":
        return str(unicodedata.digit(c))
    if kind == "Pd" or c == "−":
        return "-"
    if kind == "Zs":
        return " "
    if c in "。｡․":
        return "."
    plain = unicodedata.normalize("NFKC", c)
    return plain if len(plain) == 1 and plain.isascii() else c


class Rewritten:
    """A text with the source range of each of its characters."""

    def __init__(self, text: str):
        self.text, self.lo = text, np.arange(len(text), dtype=np.int32)
        self.hi = self.lo + 1

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """edits: (start, end, new) in the present text, in order, not overlapping; all of new comes from the range."""
        text, lo, hi, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            lo += [self.lo[at:a], np.full(len(new), self.lo[a], np.int32)]
            hi += [self.hi[at:a], np.full(len(new), self.hi[b - 1], np.int32)]
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.lo, self.hi = np.concatenate([*lo, self.lo[at:]]), np.concatenate([*hi, self.hi[at:]])


def rewritten(text: str) -> Rewritten | None:
    """The text as the transducers leave it; None if they change nothing."""
    odd = not text.isascii() and _ODD.search(text)
    spelled = _SPELLED.search(text)
    mixed = _MIXED.search(text)
    if not (odd or spelled or mixed or _SIGNS.search(text)):
        return None
    out = Rewritten(text)
    if odd:
        folds = [(m.start(), m.end(), f) for m in _ODD.finditer(text) if (f := _folded(m[0])) != m[0]]
        if folds:
            out.replace(folds)
    for pattern, new in ((_AT, "@"), (_DOT, ".")):
        if edits := [(m.start(), m.end(), new) for m in pattern.finditer(out.text)]:
            out.replace(edits)
    if edits := [(m.start() + i, m.start() + i + 1, new) for m in _MIXED.finditer(out.text) for i, (c, new) in enumerate(zip(m[0], m[0].translate(_LETTER_DIGITS), strict=True)) if c != new]:
        out.replace(edits)
    edits = []
    for m in _SAID.finditer(out.text):
        for p in _SAID_PART.finditer(out.text, m.start(), m.end()):
            edits.append((p.start(), p.end(), "." if p[1].lower() == "dot" else "@"))
    if edits:
        out.replace(edits)
    edits = []
    for m in _SPELLED.finditer(out.text):
        at = None
        for w in _SPELLED_ONE.finditer(out.text, m.start(), m.end()):
            if at is not None and w.start() > at:
                edits.append((at, w.start(), ""))
            edits.append((w.start(), w.end(), DIGIT_WORDS.get(w[0].lower(), w[0])))
            at = w.end()
    if edits:
        out.replace(edits)
    for pattern, new in ((_SPELLED_DOT, "."), (_PLUS, "+")):
        if edits := [(m.start(), m.end(), new) for m in pattern.finditer(out.text)]:
            out.replace(edits)
    return None if out.text == text else out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Read outwards from each at sign, which neither side of a match can hold, so each character is read twice at most."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin, step = at, 64
        while begin > done:
            low = max(done, begin - step)
            begin = low + len(text[low:begin].rstrip(_LOCAL))
            if begin > low:
                break
            step *= 2
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield begin, done
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in order of kind and start."""
    out = [("email", *s) for s in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and base and deobfuscated spans together, both in order."""
    base = base_spans(text)
    new = rewritten(text)
    if new is None:
        return base, base
    taken = {k: ([a for kind, a, _ in base if kind == k], [b for kind, _, b in base if kind == k]) for k in KINDS}
    extra = []
    for kind, a, b in base_spans(new.text):
        lo, hi = int(new.lo[a]), int(new.hi[b - 1])
        starts, ends = taken[kind]
        k = bisect_right(starts, lo)  # spans of a kind lie apart, in order
        if (not k or ends[k - 1] <= lo) and (k == len(starts) or starts[k] >= hi):
            extra.append((kind, lo, hi))
    return base, sorted(base + extra, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame) -> DataFrame:
    """One row per document: base counts, digest of the base spans, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                base, spans = all_spans(text or "")
                kinds = [s[0] for s in base]
                rows.append((doc_id, *(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            types = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def redact_text(text: str) -> str:
    """The text with each span, of any kind, replaced by its kind; of overlapping spans the first names the whole."""
    spans = sorted(all_spans(text)[1], key=lambda s: (s[1], -s[2]))
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The documents with identifiers masked and n_chars brought up to date; other columns as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            clean = [None if t is None else redact_text(t) for t in part.column("text").to_pylist()]
            part = part.set_column(part.schema.get_field_index("text"), part.schema.field("text"), pa.array(clean, part.schema.field("text").type))
            if "n_chars" in part.schema.names:
                k = part.schema.get_field_index("n_chars")
                kept = part.column(k).to_pylist()
                part = part.set_column(k, part.schema.field(k), pa.array([n if t is None else len(t) for t, n in zip(clean, kept, strict=True)], part.schema.field(k).type))
            yield part

    return docs.mapInArrow(run, docs.schema)
