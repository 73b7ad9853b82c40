"""Merging Burrows-Wheeler transforms by interleave refinement.

A collection of byte strings is held in shards.  Each shard sorts its own
suffixes and keeps their order with its transform: for the suffix of each rank,
the symbol before it.  Symbols are four bytes long, so a pass below reaches four
bytes deeper; the end of a string makes a symbol of its own.

The shards are merged without comparing suffixes.  An interleave names the shard
that each place of the merged order comes from.  If it is right for the first d
bytes, dealing it out by the symbols of the shards' transforms, read in its own
order, makes it right for d + 4.  A border between two places appears in the
pass that first tells them apart, which is their common prefix; after enough
passes the intervals between borders are the repeats of the wanted length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes of a symbol.
SYMBOL = 4


@dataclass
class Collection:
    """Strings laid end to end, each followed by SYMBOL zero bytes; bytes are raised by one."""

    data: np.ndarray
    begins: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, strings: list[bytes]) -> Collection:
        sizes = np.array([len(s) for s in strings], np.int64)
        begins = np.cumsum(sizes + SYMBOL) - sizes - SYMBOL
        raw = np.frombuffer((b"\0" * SYMBOL).join([*strings, b""]), np.uint8)
        data = (raw + np.uint8(1)).astype(np.uint8)
        for k in range(SYMBOL):
            data[begins + sizes + k] = 0
        return cls(data, begins, sizes)


def _symbols(c: Collection, places: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Ranks of the symbols at ``places``; one that holds a string's end is unlike all others."""
    wide = np.zeros(len(places), np.uint64)
    for k in range(SYMBOL):
        wide = (wide << np.uint64(8)) | c.data[places + k]
    ended = places + SYMBOL > (c.begins + c.sizes)[owner]
    key = (wide << np.uint64(32)) | np.where(ended, owner + 1, 0).astype(np.uint64)
    known, rank = np.unique(key, return_inverse=True)
    return rank.astype(np.uint16 if len(known) <= 1 << 16 else np.uint32)


def _shard_order(symbol: np.ndarray, after: np.ndarray, width: int) -> np.ndarray:
    """Suffixes of a shard in the order of their first ``width`` bytes at least.

    ``after``: the suffix that follows a symbol, -1 at the end.  Suffixes that are
    equal so far may stand in any order: the merge asks no more of them.
    """
    rank = symbol.astype(np.int64)
    n, depth = len(rank), SYMBOL
    step = after
    while True:
        key = rank * (rank.max(initial=0) + 2) + np.where(step >= 0, rank[step] + 1, 0)
        order = np.argsort(key)
        depth *= 2
        fresh = np.ones(n, bool)
        fresh[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh) - 1
        if depth >= width or fresh.all():
            return order
        step = np.where(step >= 0, step[step], -1)


def repeats(strings: list[bytes], width: int, shards: int = 4) -> tuple[np.ndarray, Collection]:
    """For each place of the collection the number of its interval in the merged
    order: two places with ``width`` bytes of their strings before them have one
    number exactly if those bytes are equal.

    ``width`` is a multiple of SYMBOL.
    """
    c = Collection.of(strings)
    if not len(strings):
        return np.zeros(0, np.int64), c
    # A string of m bytes has m + 1 suffixes, the last of them empty.
    size = c.sizes + 1
    owner_of = np.repeat(np.arange(len(strings)), size)
    offset = np.arange(len(owner_of)) - np.repeat(np.cumsum(size) - size, size)
    places = c.begins[owner_of] + offset
    n, size = len(places), size[owner_of]
    symbol = _symbols(c, places, owner_of)
    # Suffix numbers run through the strings; the one a symbol later, or the end.
    after = np.where(offset + SYMBOL < size, np.arange(n) + SYMBOL, -1)
    # The suffix a symbol before; a string's first ones follow, in a ring, on the last of their chain.
    before = np.where(offset >= SYMBOL, np.arange(n) - SYMBOL, np.arange(n) + (size - 1 - offset) // SYMBOL * SYMBOL)
    bounds = np.searchsorted(owner_of, np.linspace(0, len(strings), shards + 1).astype(int)[1:-1])
    transforms, orders, interleave = [], [], []
    for s, (a, b) in enumerate(zip([0, *bounds], [*bounds, n], strict=True)):
        if a == b:
            continue
        order = _shard_order(symbol[a:b], np.where(after[a:b] >= 0, after[a:b] - a, -1), width) + a
        orders.append(order)
        transforms.append(symbol[before[order]])
        interleave.append(np.full(b - a, s, np.uint8))
    order, transform, z = np.concatenate(orders), np.concatenate(transforms), np.concatenate(interleave)
    block = np.zeros(n, np.int32)
    merged = np.empty_like(transform)
    border = np.zeros(n, bool)
    for _ in range(width // SYMBOL):
        merged[np.argsort(z, kind="stable")] = transform
        deal = np.argsort(merged, kind="stable")
        z, own, block = z[deal], merged[deal], block[deal]
        border[0] = False
        np.not_equal(own[1:], own[:-1], out=border[1:])
        border[1:] |= block[1:] != block[:-1]
        block = np.cumsum(border, dtype=np.int32)
    suffix = np.empty(n, np.int64)
    suffix[np.argsort(z, kind="stable")] = order
    out = np.full(len(c.data), -1, np.int64)
    out[places[suffix]] = block
    return out, c
