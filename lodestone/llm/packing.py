"""Best-fit packing of tokenised documents, improved by swaps.

Documents are cut into pieces of at most ``CAPACITY`` ids and the pieces are
dealt evenly to shards of a bounded size.  A shard is packed best-fit, largest
first; then bins, the emptiest first, give pieces to fuller ones, by a move, by
exchanging one or two pieces for a smaller one or one for two, each step raising
the sum of squared fills, until no step is left.  What is left in underfull bins
of all shards is dealt out and packed once more.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import fresh
from lodestone.plans.lineage import cut

#: Ids that fit a sequence.
CAPACITY = 1024
#: The id that ends a document.
END_ID = 2
#: Pieces of a shard, on average.
SHARD = 16_384
#: Bins filled below this share are packed again across shards.
UNDERFULL = 0.97

_CACHE = 400_000
_RUN = re.compile(r"\s ")


# --- tokens ---------------------------------------------------------------


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    """(exact, fast, specials) of a byte-level BPE file: the file's own tokenizer,
    an equal encoder of single words, and the strings that are whole ids."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    exact = Tokenizer.from_file(path)
    specials = {t["content"] for t in spec.get("added_tokens", [])}
    # The byte-level alphabet: printable bytes stand for themselves, the rest follow from 256 on.
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in specials}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return exact, fast, specials


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    A text is split before every space.  No token reaches over such a place
    unless white space stands before the space, and then the text is encoded
    whole, as is one that holds the string of an added token.  Ids of the parts
    are kept, up to a bounded number.
    """

    def __init__(self, path: str):
        self.exact, self.fast, self.specials = _tokenizer(path)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return array("I", self.fast.encode_ordinary(text)).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a space and a word that is not among ``words``."""
        ids = self.older.get(word)
        if ids is None:
            ids = self._ids(" " + word)
        if len(self.words) >= _CACHE:
            self.older, self.words = self.words, {}
        self.words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.specials):
            return array("I", self.exact.encode(text, add_special_tokens=False).ids).tobytes()
        if _RUN.search(text):
            return self._ids(text)
        first, *rest = text.split(" ")
        found = list(map(self.words.get, rest))
        if None in found:
            found = [self._word(w) if ids is None else ids for w, ids in zip(rest, found, strict=True)]
        return self._ids(first) + b"".join(found)


def cut_points(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``length`` ids."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity
    return ([(0, first)] if first else []) + [(i, capacity) for i in range(first, length, capacity)]


_PIECE = [("doc_id", T.LongType()), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of every row of ``docs``: doc_id, piece, start, length, ids_crc32.

    ``with_ids`` adds ``ids``, the piece's ids as an array.  A null text counts
    as empty: its only id is the end id.  Repeated rows give repeated pieces.
    """
    schema = T.StructType([T.StructField(*f) for f in _PIECE] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        encoder = Encoder(path)
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"].astype(object).where(pdf["doc_id"].notna(), None), pdf["text"], strict=True):
                ids = encoder.encode(text or "") + end
                for i, (a, n) in enumerate(cut_points(len(ids) // 4, capacity)):
                    own = ids[4 * a : 4 * (a + n)]
                    rows.append((doc_id, i, a, n, zlib.crc32(own), *([np.frombuffer(own, "<u4").astype(np.int32)] if with_ids else ())))
            frame = pd.DataFrame(rows, columns=schema.names)
            yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, schema)


# --- bins -----------------------------------------------------------------


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item, largest first, each into the bin it fits best."""
    out, bins, at, mask = [0] * len(sizes), 0, {}, 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        fits = mask >> size
        if fits:
            gap = size + (fits & -fits).bit_length() - 1
            b = at[gap].pop()
            if not at[gap]:
                mask &= ~(1 << gap)
        else:
            gap, b = capacity, bins
            bins += 1
        out[i] = b
        left = gap - size
        at.setdefault(left, []).append(b)
        mask |= 1 << left
    return out


class _Open:
    """Underfull bins by what they can give back: for one item, or the sum of two,
    the gaps of the bins that hold it."""

    def __init__(self, capacity: int):
        self.bins: dict[int, dict[int, set[int]]] = {}
        self.largest = np.full(capacity + 1, -1, np.int64)  # the largest of these gaps

    def add(self, sums: set[int], gap: int, b: int) -> None:
        for y in sums:
            self.bins.setdefault(y, {}).setdefault(gap, set()).add(b)
            if gap > self.largest[y]:
                self.largest[y] = gap

    def drop(self, sums: set[int], gap: int, b: int) -> None:
        for y in sums:
            there = self.bins[y][gap]
            there.discard(b)
            if not there:
                del self.bins[y][gap]
                if gap == self.largest[y]:
                    self.largest[y] = max(self.bins[y], default=-1)

    def least(self) -> np.ndarray:
        """For each amount the least return that makes room for it in some bin."""
        n = len(self.largest)
        known = np.flatnonzero(self.largest >= 0)
        out = np.full(2 * n, n, np.int64)
        np.minimum.at(out, known + self.largest[known], known)
        return np.minimum.accumulate(out[::-1])[::-1]

    def fit(self, y: int, amount: int) -> int:
        """The fullest bin that takes ``amount`` for ``y``; the least number among several."""
        gap = min(g for g in self.bins[y] if g + y >= amount)
        return min(self.bins[y][gap])


def _pair_sums(sizes: dict[int, list[int]]) -> set[int]:
    some = sorted(sizes)
    return {x + y for i, x in enumerate(some) for y in some[i + 1 :]} | {2 * x for x in some if len(sizes[x]) > 1}


def _taken(sizes: dict[int, list[int]], amount: int, two: bool) -> list[int]:
    """One item of that size, or two of that sum, taken out of a bin."""
    if not two:
        return [sizes[amount].pop()]
    x = next(x for x in sorted(sizes) if amount - x in sizes and (2 * x != amount or len(sizes[x]) > 1))
    return [sizes[x].pop(), sizes[amount - x].pop()]


def swap_search(sizes: list[int], bins: list[int], capacity: int) -> list[int]:
    """Better bins for the items, by moves and swaps between underfull bins.

    From the emptiest bin on, each bin gives fuller ones one or two of its items
    for none or one of theirs, or one for two, wherever that leaves it emptier:
    the sum of squared fills rises with each step.  The largest net amount goes
    first.  A bin is done with when it is empty or has no step; all are tried
    again until there is no step left, or no fewer bins are possible.
    """
    if not len(sizes):
        return []
    at = list(bins)
    n_bins = max(at) + 1
    held: list[dict[int, list[int]]] = [{} for _ in range(n_bins)]
    for i in range(len(sizes) - 1, -1, -1):
        held[at[i]].setdefault(sizes[i], []).append(i)
    fill = np.zeros(n_bins, np.int64)
    np.add.at(fill, at, sizes)
    open_bins, least = int((fill > 0).sum()), -(-int(sum(sizes)) // capacity)
    moved = True
    while moved and open_bins > least:
        moved = False
        one, two = _Open(capacity), _Open(capacity)
        single = lambda b: {0, *held[b]}

        def enter(b: int, one=one, two=two, single=single) -> None:
            if fill[b] < capacity:
                one.add(single(b), capacity - int(fill[b]), b)
                two.add(_pair_sums(held[b]), capacity - int(fill[b]), b)

        def leave(b: int, one=one, two=two, single=single) -> None:
            if fill[b] < capacity:
                one.drop(single(b), capacity - int(fill[b]), b)
                two.drop(_pair_sums(held[b]), capacity - int(fill[b]), b)

        waiting = np.where((fill > 0) & (fill < capacity), fill, capacity)
        for b in np.flatnonzero(waiting < capacity).tolist():
            enter(b)
        while open_bins > least:
            e = int(np.argmin(waiting))
            if waiting[e] >= capacity:
                break
            leave(e)
            waiting[e] = capacity
            while fill[e]:
                own, pairs = np.array(sorted(held[e])), np.array(sorted(_pair_sums(held[e])), np.int64)
                f1, f2 = one.least(), two.least()
                # net amount, what goes, whether that is two, what comes back, whether that is two
                steps = [(x - y, x, double, y, back) for a, f, double, back in ((own, f1, False, False), (pairs, f1, True, False), (own, f2, False, True)) if len(a) for x, y in [_widest(a, f)] if y < x]
                if not steps:
                    break
                net, x, double, y, back = max(steps, key=lambda s: (s[0], -s[2] - s[4]))
                b = (two if back else one).fit(y, x)
                leave(b)
                go, come = _taken(held[e], x, double), _taken(held[b], y, back) if y else []
                for items, to in ((go, b), (come, e)):
                    for i in items:
                        held[to].setdefault(sizes[i], []).append(i)
                        at[i] = to
                for c in (b, e):
                    for s in [s for s, items in held[c].items() if not items]:
                        del held[c][s]
                fill[b] += net
                fill[e] -= net
                enter(b)
                waiting[b] = fill[b] if waiting[b] < capacity and fill[b] < capacity else capacity
                moved = True
            open_bins -= not fill[e]
    return at


def _widest(amounts: np.ndarray, least: np.ndarray) -> tuple[int, int]:
    """The amount that exceeds its least return the most, and that return."""
    i = int(np.argmax(amounts - least[amounts]))
    return int(amounts[i]), int(least[amounts[i]])


def pack_items(sizes: list[int], capacity: int, before: list[int] | None = None) -> list[int]:
    """Bins of items, numbered from 0; ``before`` is kept if it has no more bins.

    Items longer than ``capacity`` have a bin each.
    """
    fits = [i for i, s in enumerate(sizes) if s <= capacity]
    small = [sizes[i] for i in fits]
    found = swap_search(small, best_fit(small, capacity), capacity)
    if before is not None and len(fits) == len(sizes) and len(set(before)) <= len(set(found)):
        found = swap_search(small, before, capacity)
    out = [-1 - i for i in range(len(sizes))]
    for i, b in zip(fits, found, strict=True):
        out[i] = b
    number: dict[int, int] = {}
    return [number.setdefault(b, len(number)) for b in out]


def _shard_packer(capacity: int, shard: str, before: str, number: str, fill: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = [c for c in pdf.columns if c not in (shard, before)]
        length = pdf["length"].fillna(0).clip(lower=0).astype(np.int64)
        by = pd.DataFrame({"n": -length, **{c: pdf[c] for c in ("doc_id", "piece") if c in order}}).sort_values(["n", *[c for c in ("doc_id", "piece") if c in order]], kind="stable").index
        pdf, length = pdf.loc[by].reset_index(drop=True), length.loc[by].reset_index(drop=True)
        known: dict[int, int] = {}
        bins = [known.setdefault(b, len(known)) for b in pdf[before].tolist()] if pdf[before].notna().all() else None
        pdf[number] = np.array(pack_items(length.tolist(), capacity, bins), np.int64)
        pdf["offset"] = length.groupby(pdf[number]).cumsum() - length
        pdf[fill] = length.groupby(pdf[number]).transform("sum")
        return pdf

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """``items``, all columns kept, with ``sequence_id`` and ``offset``.

    ``items`` has a whole-number ``length``; null or negative ones count as 0, and
    an item longer than ``capacity`` is a sequence of its own.  Other sequences
    hold at most ``capacity``; offsets are gapless from 0.  Columns ``sequence_id``
    and ``offset`` of ``items`` are replaced.  Repeated rows are items of their
    own; an empty table gives an empty result.
    """
    items = items.drop("sequence_id", "offset")
    names = items.columns
    shard_name, before, number, fill = (fresh(n, names) for n in ("shard", "before", "bin", "fill"))
    rows = cut(items)
    n = rows.count()
    if n == 0:
        return rows.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    full = T.StructType([*rows.schema.fields, *[T.StructField(c, T.LongType()) for c in (shard_name, before, number, "offset", fill)]])

    def packed(df: DataFrame) -> DataFrame:
        return df.groupBy(shard_name).applyInPandas(_shard_packer(capacity, shard_name, before, number, fill), full)

    # dealt row by row, so that no key can crowd a shard
    dealt = rows.withColumn(shard_name, F.monotonically_increasing_id() % (-(-n // shard))).withColumn(before, F.lit(None).cast("long"))
    bin_id = F.shiftleft(F.col(shard_name), 32).bitwiseOR(F.col(number))
    done = cut(packed(dealt)).select(*names, bin_id.alias("sequence_id"), "offset", fill)
    loose = done.where(F.col(fill) < UNDERFULL * capacity)
    m = loose.count()
    if m == 0:
        return done.drop(fill)
    again = loose.select(*names, F.pmod(F.xxhash64("sequence_id"), F.lit(-(-m // shard))).alias(shard_name), F.col("sequence_id").alias(before))
    second = packed(again).select(*names, bin_id.bitwiseOR(F.lit(1 << 62)).alias("sequence_id"), "offset")
    return done.where(F.col(fill) >= UNDERFULL * capacity).drop(fill).unionByName(second)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, shard: int = SHARD, with_ids: bool = False) -> DataFrame:
    """Every document of ``docs`` in pieces, each with its sequence and place."""
    return pack(pieces(docs, path, capacity, with_ids), capacity, shard)
