"""Similarities that Spark has no function for, as Arrow-batched kernels.

A batch is reduced to its distinct pairs before they are compared.  Pairs of
strings of up to 64 characters are compared together, a symbol of each at a
time; longer ones are compared one by one, by the same rules.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of the strings that are compared together: the bits of a machine word.
LANES = (8, 16, 32, 64)


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit of a word for each symbol of ``a``."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        hit = state & masks.get(c, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def jaro(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    first = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                first.append(c)
                break
    m = len(first)
    if not m:
        return 0.0
    second = [c for c, t in zip(b, taken, strict=True) if t]
    swapped = sum(x != y for x, y in zip(first, second, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def _lanes(texts: Sequence[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of strings of up to ``width`` characters, a row each, and their lengths."""
    points = np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width)
    return points.astype(np.uint8) if points.max() < 256 else points, np.fromiter(map(len, texts), np.int16, len(texts))


def _apart(a: Sequence[str], b: Sequence[str], together: Callable, single: Callable[[str, str], float], kind: type) -> np.ndarray:
    """``together`` for the pairs of each width of lane, ``single`` for each pair that is longer."""
    out = np.zeros(len(a), kind)
    size = np.fromiter((max(len(x), len(y)) for x, y in zip(a, b, strict=True)), np.int64, len(a))
    lane = np.searchsorted(LANES, size)
    for k, width in enumerate(LANES):
        own = np.flatnonzero(lane == k)
        if len(own):
            out[own] = together(*_lanes([a[i] for i in own], width), *_lanes([b[i] for i in own], width))
    for i in np.flatnonzero(lane == len(LANES)):
        out[i] = single(a[i], b[i])
    return out


def _words(mark: np.ndarray) -> np.ndarray:
    """Rows of marks as the bits of unsigned whole numbers, the first mark lowest."""
    return np.packbits(mark, axis=1, bitorder="little").view(f"<u{mark.shape[1] // 8}")[:, 0]


def _lcs_lanes(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    inside = np.arange(x.shape[1], dtype=np.int16) < nx[:, None]
    kept = _words(inside)
    state = np.full_like(kept, ~kept.dtype.type(0))
    for j in range(int(ny.max())):
        hit = state & kept & np.where(j < ny, _words(x == y[:, j : j + 1]), kept.dtype.type(0))
        state = (state + hit) | (state - hit)
    return nx - np.bitwise_count(state & kept).astype(np.int64)


def lcs_lengths(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs."""
    return _apart(a, b, _lcs_lanes, lcs_length, np.int64)


def _jaro_lanes(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Marks are bits: the first fitting symbol is the lowest bit of those that are left."""
    kind = np.dtype(f"u{x.shape[1] // 8}").type
    reach = np.maximum(0, np.maximum(nx, ny) // 2 - 1)
    place = np.arange(x.shape[1], dtype=np.int16)
    free = _words(place < ny[:, None])
    whole, met, one = free.copy(), np.zeros(x.shape, bool), kind(1)
    for i in range(int(nx.max())):
        near = _words(np.abs(place - np.int16(i)) <= reach[:, None])
        fit = np.where(i < nx, _words(y == x[:, i : i + 1]) & near & free, kind(0))
        lowest = fit & (~fit + one)
        met[:, i] = lowest != 0
        free ^= lowest
    taken = np.unpackbits((whole ^ free)[:, None].view(np.uint8), axis=1, bitorder="little").astype(bool)
    m = met.sum(axis=1)
    # the matched symbols of both sides in their order: row by row, so that both run alike
    row = np.nonzero(met)[0]
    swapped = np.bincount(row, weights=x[met] != y[taken], minlength=len(x)).astype(np.int64) // 2
    share = lambda n, of: n / np.maximum(of, 1)
    return np.where(m > 0, (share(m, nx) + share(m, ny) + share(m - swapped, m)) / 3, 0.0)


def jaro_winkler(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Jaro of pairs, raised by a common prefix of up to four if it is above 0.7; 1 for two empty strings."""
    j = _apart(a, b, _jaro_lanes, jaro, float)
    prefix = np.fromiter((len(os.path.commonprefix((x[:4], y[:4]))) for x, y in zip(a, b, strict=True)), np.int64, len(a))
    empty = np.fromiter((not x and not y for x, y in zip(a, b, strict=True)), bool, len(a))
    return np.where(empty, 1.0, np.where(j > 0.7, j + 0.1 * prefix * (1 - j), j))


def token_sort(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """1 - insertions and deletions over both lengths, of the sorted tokens of pairs.

    Two empty strings, or two blank ones, score 1; one empty string scores 0.
    """
    left, right = ([" ".join(sorted(t.split())) for t in side] for side in (a, b))
    both = np.array([len(x) + len(y) for x, y in zip(left, right, strict=True)], np.int64)
    ratio = np.where(both > 0, 2 * lcs_lengths(left, right) / np.maximum(both, 1), 1.0)
    return np.where([bool(x) == bool(y) for x, y in zip(a, b, strict=True)], ratio, 0.0)


def token_set(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """The best of three ratios over shared and own tokens of pairs; 1 if one set holds the other.

    Two empty strings score 1; a side without a token scores 0 otherwise.
    """
    out = np.zeros(len(a))
    at, own, other, common = [], [], [], []
    for n, (x, y) in enumerate(zip(a, b, strict=True)):
        left, right = set(x.split()), set(y.split())
        if not left or not right:
            out[n] = float(not x and not y)
        elif left & right and (left <= right or right <= left):
            out[n] = 1.0
        else:
            at.append(n)
            own.append(" ".join(sorted(left - right)))
            other.append(" ".join(sorted(right - left)))
            common.append(len(" ".join(sorted(left & right))))
    if at:
        nx, ny = (np.fromiter(map(len, side), np.int64, len(at)) for side in (own, other))
        i = np.array(common, np.int64)
        gap = (i > 0).astype(np.int64)
        whole = 1 - (nx + ny - 2 * lcs_lengths(own, other)) / (2 * i + 2 * gap + nx + ny)
        best = np.maximum(whole, np.maximum(1 - (gap + nx) / (2 * i + gap + nx), 1 - (gap + ny) / (2 * i + gap + ny)))
        out[at] = np.where(i > 0, best, whole)
    return out


def batched(many: Callable[[Sequence[str], Sequence[str]], np.ndarray]):
    """A pandas UDF that applies ``many`` to the distinct pairs of a batch; a null counts as empty."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        left, la = pd.factorize(a.fillna(""))
        right, rb = pd.factorize(b.fillna(""))
        code, back = np.unique(left.astype(np.int64) * max(1, len(rb)) + right, return_inverse=True)
        if not len(code):
            return pd.Series([], dtype=float)
        value = many([la[c // len(rb)] for c in code], [rb[c % len(rb)] for c in code])
        return pd.Series(value[back])

    return F.pandas_udf(run, T.DoubleType())
