"""Hashed word shingles of many texts at once, with numpy."""

from __future__ import annotations

import hashlib

import numpy as np

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FACTOR = np.uint64(0xD6E8FEB86659FD93)
_SEED = np.uint64(0x9E3779B97F4A7C15)
#: The lowest so many bytes of a number.
_LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words longer than this are hashed one by one.
_LONG = 256


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number (a view; zeros follow the end)."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))


def substring_hashes(raw: np.ndarray, length: int) -> np.ndarray:
    """64-bit hash of each substring of so many bytes.

    Built up by doubling, mixed at each step: sums of powers, which are cheaper, have fixed
    collisions modulo 2**64 (texts that follow the Thue-Morse sequence).
    """
    n = len(raw) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    held = min(length, 8)
    h = mixed((_eights(raw)[: len(raw) - held + 1] & _LOWEST[held]) + _SEED)
    while held < length:
        step = min(held, length - held)
        h = mixed(h[: len(h) - step] * _FACTOR + h[step:])
        held += step
    return h


def span_hashes(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hash of each given span, eight bytes at a time; very long ones by BLAKE2."""
    eights, out = _eights(raw), mixed(sizes.astype(np.uint64) + _SEED)
    open_ = np.flatnonzero((sizes > 0) & (sizes <= _LONG))
    done = 0
    while len(open_):
        left = sizes[open_] - done
        out[open_] = mixed(out[open_] * _FACTOR + (eights[starts[open_] + done] & _LOWEST[np.minimum(left, 8)]))
        done += 8
        open_ = open_[left > 8]
    for k in np.flatnonzero(sizes > _LONG).tolist():
        digest = hashlib.blake2b(raw[starts[k] : starts[k] + sizes[k]].tobytes(), digest_size=8).digest()
        out[k] = np.frombuffer(digest, np.uint64)[0]
    return out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased, in order, and each text's number of words."""
    raw = np.frombuffer(b" ".join(texts).translate(_LOWER) + b" ", np.uint8)
    blank = _SPACE[raw]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    words = span_hashes(raw, starts, ends - starts)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, bounds)]))
    return words, counts


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of so many words; fewer words are one shingle, none are none."""
    words, counts = word_hashes(texts)
    out, at = [], 0
    n = len(words)
    if n >= width:
        rolled = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            rolled = rolled * _FACTOR + words[k : n - width + 1 + k]
        rolled = mixed(rolled)
    for c in counts.tolist():
        if c >= width:
            out.append(np.unique(rolled[at : at + c - width + 1]))
        elif c:
            short = np.uint64(c)
            with np.errstate(over="ignore"):
                for w in words[at : at + c]:
                    short = short * np.uint64(0xA0761D6478BD642F) + w
            out.append(mixed(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out
