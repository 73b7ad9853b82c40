"""Anchored segments: where strings of a fixed width can repeat.

A byte window has a key, the least hash of its grams.  Equal windows have equal
keys, and neighbouring windows mostly share theirs, so a text falls into runs of
windows with one key.  Only windows of one key need to be compared.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

#: Bytes of a string that counts as repeated.
WIDTH = 100
#: Bytes of a gram: three words of eight.
GRAM = 24
#: Windows of a segment, at most; longer runs are split.
LONGEST = 256

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _gram_hashes(data: bytes) -> np.ndarray:
    n = len(data)
    eight = np.ndarray(n - 7, "<u8", buffer=data, strides=(1,))
    h = eight[: n - GRAM + 1] * _MULTIPLIERS[0]
    h ^= h >> np.uint64(29)
    h += eight[8 : n - GRAM + 9] * _MULTIPLIERS[1]
    h ^= h >> np.uint64(32)
    h += eight[16 : n - GRAM + 17] * _MULTIPLIERS[2]
    h *= _MULTIPLIERS[0]
    h ^= h >> np.uint64(31)
    return h


def _sliding_minimum(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling spans."""
    span, m = 1, h
    while 2 * span <= width:
        m = np.minimum(m[: len(m) - span], m[span:])
        span *= 2
    rest = width - span
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


@dataclass
class Segments:
    """Runs of windows with one key: text number, start in it, windows, key and
    content hash.  A periodic segment may hold equal windows itself."""

    text: np.ndarray
    start: np.ndarray
    n: np.ndarray
    key: np.ndarray
    content: np.ndarray
    periodic: np.ndarray


def segments(texts: list[bytes], width: int = WIDTH) -> Segments:
    """The segments of all windows of ``width`` bytes; none reaches over two texts."""
    data = b"".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    if len(data) < width:
        none = np.zeros(0, np.int64)
        return Segments(none, none, none, none, none, none.astype(bool))
    h = _gram_hashes(data)
    back = width - GRAM
    keys = _sliding_minimum(h, back + 1)
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    for at in (begins, ends - width + 1):  # a text's first window, and the first that would leave it
        first[at[(at >= 0) & (at < len(keys))]] = True
    lo = np.flatnonzero(first)
    hi = np.append(lo[1:], len(keys))
    if len(lo) and (hi - lo).max() > LONGEST:
        lo = np.concatenate([np.arange(a, b, LONGEST) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
        hi = np.append(lo[1:], len(keys))
    text = np.searchsorted(ends, lo, side="right")
    inside = lo + width <= ends[text]
    lo, hi, text = lo[inside], hi[inside], text[inside]
    # Equal windows a < b of a segment put the key's first place from a on before b, and
    # its last place up to b's end after a's end; a lone place is both.
    opens = np.append(np.flatnonzero(h[: len(keys)] == keys), len(h))
    closes = np.append(-1, np.flatnonzero(h[back:] == keys))
    a = opens[np.searchsorted(opens, lo)]
    b = closes[np.searchsorted(closes, hi) - 1]
    periodic = (a < hi) & (b >= lo) & (a < b + back)
    view = memoryview(data)
    spans = zip(lo.tolist(), (hi + width - 1).tolist(), strict=True)
    content = np.fromiter((xxhash.xxh3_64_intdigest(view[x:y]) for x, y in spans), np.uint64, len(lo))
    return Segments(text, lo - begins[text], hi - lo, keys[lo].view(np.int64), content.view(np.int64), periodic)


#: Bytes beside the key's gram that a shared window must share on one side.
_SIDE = (WIDTH - GRAM) // 2


def _hashed(eight: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the ``_SIDE + GRAM`` bytes from each place on."""
    h = np.zeros(len(at), np.uint64)
    for k in (*range(0, _SIDE + GRAM - 7, 8), _SIDE + GRAM - 8):
        h = (h ^ eight[at + k]) * _MULTIPLIERS[0]
        h ^= h >> np.uint64(29)
    return h


def contexts(pieces: list[bytes], key: np.ndarray) -> np.ndarray:
    """Whether a segment may share a window with another, or with itself elsewhere.

    A window holds its key's gram with ``_SIDE`` bytes before or after it, and an
    equal window holds the same.  Segments whose bytes on either side of each such
    gram occur nowhere else share no window.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    if not len(sizes):
        return np.zeros(0, bool)
    ends = np.cumsum(sizes)
    data = b"".join(pieces)
    h = _gram_hashes(data)
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(h)]
    at = np.flatnonzero(h == key.view(np.uint64)[owner])
    at = at[at + GRAM <= ends[owner[at]]]
    eight = np.ndarray(len(data) - 7, "<u8", buffer=data, strides=(1,))
    out = np.zeros(len(sizes), bool)
    for first in (at - _SIDE, at):
        fits = (first >= (ends - sizes)[owner[at]]) & (first + _SIDE + GRAM <= ends[owner[at]])
        _, back, n = np.unique(_hashed(eight, first[fits]), return_inverse=True, return_counts=True)
        out[owner[at[fits]][n[back] > 1]] = True
    return out
