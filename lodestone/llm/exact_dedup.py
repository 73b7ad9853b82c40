"""Repeated 100-byte strings by merged Burrows-Wheeler transforms.

Documents fall into anchored segments (see ``passages``), whose rows hold hashes
and places but no text.  A segment with the key and content of an earlier one is
removed whole, as each of its windows starts earlier there; copies that meet in a
task's own part of the input are settled before the shuffle.  Where one key has
different contents, or a content may repeat within itself, the bytes of one
segment of each content are fetched, those that share no long enough context with
another are left out, the transforms of shards of the others are merged (see
``bwt``), and the repeated intervals tell which windows start earlier.

A key of very many contents (the edge of a passage that very many documents
share) never meets in one task: its segments are cut into single windows, whose
keys are their own contents, so that all rows of a key are copies and those of a
task are settled before the shuffle as well.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import bwt
from lodestone.llm.passages import LONGEST, WIDTH, contexts, segments
from lodestone.plans.lineage import cut

#: Bytes of texts that are cut into segments together, of those whose copies are
#: settled together, and of segments merged together (sorted inside a core's cache).
TOGETHER, SETTLED, MERGED = 1 << 20, 1 << 24, 1 << 16
#: Contents of one key from which on its segments are cut into single windows.
CROWD = 1024
#: Crowded keys that are broadcast, at most; more are joined by a shuffle.
BROADCAST_KEYS = 200_000
#: Documents without a doc_id are named from here on, by their texts: after all others.
_UNNAMED = 1 << 62
_BITS = LONGEST.bit_length()
_WHOLE, _COMPARE, _CROWD = 0, 1, 2


def _encoded(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


class Copies:
    """Tells, from rows sorted by group (two columns), doc, node and start, which
    start earlier: in a smaller doc, or before in the same node (a doc_id with one
    of its texts).  Rows may come in parts."""

    def __init__(self):
        self.last = None

    def push(self, group: tuple[np.ndarray, np.ndarray], doc: np.ndarray, node: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(copy, first): rows that start earlier elsewhere, and those that don't.
        A row given twice is neither the second time."""
        n = len(doc)
        if not n:
            return np.zeros(0, bool), np.zeros(0, bool)
        same, own = np.zeros(n, bool), np.zeros(n, bool)
        same[1:] = (group[0][1:] == group[0][:-1]) & (group[1][1:] == group[1][:-1])
        own[1:] = (doc[1:] == doc[:-1]) & (node[1:] == node[:-1])
        again = np.zeros(n, bool)
        again[1:] = start[1:] == start[:-1]
        lead = doc[0]
        if self.last is not None:
            g, last_doc, last_node, last_start, lead = self.last
            same[0] = g == (group[0][0], group[1][0])
            own[0] = (last_doc, last_node) == (doc[0], node[0])
            again[0] = last_start == start[0]
        head = np.maximum.accumulate(np.where(same, -1, np.arange(n)))
        first_doc = np.where(head >= 0, doc[head], lead)
        own &= same
        again &= own
        copy = same & ~again & (own | (doc != first_doc))
        self.last = ((group[0][-1], group[1][-1]), doc[-1], node[-1], start[-1], first_doc[-1])
        return copy, ~copy & ~again


def _settled(frame: pd.DataFrame) -> pd.DataFrame:
    """Rows (key, content, doc, node, pack) without repeated ones; ``pack`` is made
    odd where a row of the frame starts earlier, which is then all there is to it."""
    key, content, doc, node, pack = (frame[c].to_numpy(np.int64) for c in ("key", "content", "doc", "node", "pack"))
    mixed = key ^ (content * np.int64(-7046029254386353131))
    order = np.argsort(mixed, kind="stable")
    twin = np.zeros(len(order), bool)
    twin[1:] = mixed[order[1:]] == mixed[order[:-1]]
    twin[:-1] |= twin[1:]
    some = order[twin]
    some = some[np.lexsort((pack[some], node[some], doc[some], content[some], key[some]))]
    copy, first = Copies().push((key[some], content[some]), doc[some], node[some], pack[some])
    pack = pack.copy()
    pack[some[copy]] |= 1
    keep = np.ones(len(pack), bool)
    keep[some[~copy & ~first]] = False
    return frame.assign(pack=pack)[keep]


def _route() -> Column:
    """Rows that are settled go anywhere, the others where their key meets."""
    return F.when(F.col("pack").bitwiseAND(F.lit(1)) == 1, F.xxhash64("doc", "pack")).otherwise(F.col("key"))


def _segment_batches(batches):
    """pack: start, n, whether the content may repeat within itself, and whether it is settled."""
    held, size = [], 0
    for pdf in batches:
        texts = [_encoded(t) for t in pdf["text"]]
        ids, nodes = pdf["doc"].to_numpy(np.int64), pdf["node"].to_numpy(np.int64)
        a = 0
        while a < len(texts):
            b, here = a, 0
            while b < len(texts) and (b == a or here + len(texts[b]) <= TOGETHER):
                here += len(texts[b])
                b += 1
            s = segments(texts[a:b])
            pack = (s.start << _BITS | s.n) << 2 | s.periodic.astype(np.int64) << 1
            held.append(pd.DataFrame({"key": s.key, "content": s.content, "doc": ids[a:b][s.text], "node": nodes[a:b][s.text], "pack": pack}))
            size += here
            a = b
            if size >= SETTLED:
                yield _settled(pd.concat(held, ignore_index=True))
                held, size = [], 0
    if held:
        yield _settled(pd.concat(held, ignore_index=True))


def _runs(crowd: int):
    def run(batches):
        """Rows sorted by key, content, doc, node, pack: what to remove, what to compare, and crowded keys."""
        copies, held, count = Copies(), None, (None, 0)  # held: the last first-of-its-content, and whether its key has others
        names = ["key", "content", "doc", "node", "pack"]
        for pdf in batches:
            done = pdf["pack"].to_numpy(np.int64) & 1 > 0
            out = [_found(_WHOLE, pdf[done])]
            rows = pdf[~done]
            key, content, doc, node, pack = (rows[c].to_numpy(np.int64) for c in names)
            copy, first = copies.push((key, content), doc, node, pack)
            out.append(_found(_WHOLE, rows[copy]))
            rows = rows[first]
            if len(rows):
                key = rows["key"].to_numpy(np.int64)
                fresh = np.ones(len(key), bool)
                fresh[1:] = key[1:] != key[:-1]
                at = np.flatnonzero(fresh)
                nth = np.arange(len(key)) - at[np.cumsum(fresh) - 1]
                if count[0] == key[0]:
                    nth[: at[1] if len(at) > 1 else len(key)] += count[1]
                out.append(_found(_CROWD, rows[nth == crowd]))
                count = (key[-1], int(nth[-1]) + 1)
                other = rows["pack"].to_numpy(np.int64) & 2 > 0
                other[1:] |= ~fresh[1:]
                other[:-1] |= ~fresh[1:]
                if held is not None:
                    if held[0]["key"].iloc[0] == key[0]:
                        held = (held[0], True)
                        other[0] = True
                    if held[1]:
                        out.append(_found(_COMPARE, held[0]))
                out.append(_found(_COMPARE, rows[:-1][other[:-1]]))
                held = (rows[-1:], bool(other[-1]))
            yield pd.concat(out, ignore_index=True)
        if held is not None and held[1]:
            yield _found(_COMPARE, held[0])

    return run


def _found(kind: int, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"kind": np.full(len(rows), kind, np.int32), "key": rows["key"], "doc": rows["doc"], "node": rows["node"], "packed": rows["pack"].to_numpy(np.int64) >> 2})


def _fetch(batches):
    """Segments with their bytes; those of crowded keys as single windows without."""
    for pdf in batches:
        whole, single = [], []
        for doc, node, text, wanted in zip(pdf["doc"], pdf["node"], pdf["text"], pdf["x"], strict=True):
            if wanted is None:
                continue
            data = _encoded(text)
            for row in wanted:
                p = row["packed"]
                start, n = p >> _BITS, p & ((1 << _BITS) - 1)
                piece = data[start : start + n + WIDTH - 1]
                if not row["crowd"]:
                    whole.append((row["key"], 0, doc, node, p << 2, piece))
                    continue
                for i in range(n):
                    h = xxhash.xxh3_128_intdigest(piece[i : i + WIDTH])
                    single.append((h >> 64, h & ((1 << 64) - 1), doc, node, (start + i << _BITS | 1) << 2))
        yield pd.DataFrame(whole, columns=["key", "content", "doc", "node", "pack", "piece"])
        if single:
            columns = zip(*single, strict=True)
            key, content = (np.array(c, np.uint64).view(np.int64) for c in (next(columns), next(columns)))
            doc, node, pack = (np.array(c, np.int64) for c in columns)
            yield _settled(pd.DataFrame({"key": key, "content": content, "doc": doc, "node": node, "pack": pack})).assign(piece=None)


def repeated_windows(strings: list[bytes], doc: np.ndarray, node: np.ndarray, start: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """For each string the offsets of its windows that start earlier elsewhere."""
    block, c = bwt.repeats(strings, width)
    n = np.maximum(0, c.sizes - width + 1)
    owner = np.repeat(np.arange(len(strings)), n)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    own = block[c.begins[owner] + offset].astype(np.int64)
    at_doc, at_node, at_start = doc[owner], node[owner], start[owner] + offset
    order = np.lexsort((at_start, at_node, at_doc, own))
    copy, _ = Copies().push((own[order], own[order]), at_doc[order], at_node[order], at_start[order])
    hit = np.sort(order[copy])
    return np.split(offset[hit], np.searchsorted(owner[hit], np.arange(1, len(strings))))


def _compared(rows: pd.DataFrame) -> pd.DataFrame:
    """Windows of whole segments that start earlier, as runs (doc, node, packed)."""
    doc, node, start = rows["doc"].to_numpy(np.int64), rows["node"].to_numpy(np.int64), rows["pack"].to_numpy(np.int64) >> 2 + _BITS
    out = []
    for i, hit in enumerate(repeated_windows([bytes(p) for p in rows["piece"]], doc, node, start)):
        if len(hit):
            for run in np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1):
                out.append((doc[i], node[i], start[i] + run[0] << _BITS | len(run)))
    return pd.DataFrame(out, columns=["doc", "node", "packed"])


def _compare(batches):
    """Rows sorted by key, content, doc, node, pack: windows that start earlier."""
    copies = Copies()
    rest: list[pd.DataFrame] = []  # rows whose keys may go on
    ready: list[pd.DataFrame] = []  # rows of whole keys that share contexts
    waiting = size = 0

    def sifted(rows: pd.DataFrame) -> pd.DataFrame:
        return rows[contexts([bytes(p) for p in rows["piece"]], rows["key"].to_numpy(np.int64))]

    for pdf in batches:
        done = pdf["pack"].to_numpy(np.int64) & 1 > 0
        alone = pdf["piece"].isna().to_numpy() & ~done
        single = pdf[alone]
        key, content, doc, node, pack = (single[c].to_numpy(np.int64) for c in ("key", "content", "doc", "node", "pack"))
        copy, _ = copies.push((key, content), doc, node, pack)
        settled = pd.concat([pdf[done], single[copy]])
        if len(settled):
            yield pd.DataFrame({"doc": settled["doc"], "node": settled["node"], "packed": settled["pack"].to_numpy(np.int64) >> 2})
        pieces = pdf[~done & ~alone]
        for a in range(0, len(pieces), 250):
            rest.append(pieces.iloc[a : a + 250])
            waiting += sum(map(len, rest[-1]["piece"]))
            if waiting < MERGED:
                continue
            rows = pd.concat(rest, ignore_index=True)
            over = rows["key"] != rows["key"].iloc[-1]
            rest = [rows[~over]]
            waiting = sum(map(len, rest[0]["piece"]))
            ready.append(sifted(rows[over]))
            size += sum(map(len, ready[-1]["piece"]))
            if size >= MERGED:
                yield _compared(pd.concat(ready, ignore_index=True))
                ready, size = [], 0
    if rest:
        ready.append(sifted(pd.concat(rest, ignore_index=True)))
    if ready:
        yield _compared(pd.concat(ready, ignore_index=True))


def merged_spans(packed, size: int, width: int = WIDTH) -> list[tuple[int, int]]:
    """Maximal removed runs of a text of ``size`` bytes."""
    if packed is None or not len(packed):
        return []
    p = np.sort(np.asarray(packed, np.int64))
    a = p >> _BITS
    b = np.maximum.accumulate(np.minimum(size, a + (p & ((1 << _BITS) - 1)) + width - 1))
    opens = np.ones(len(a), bool)
    opens[1:] = a[1:] > b[:-1]
    first = np.flatnonzero(opens)
    return list(zip(a[first].tolist(), b[np.append(first[1:], len(a)) - 1].tolist(), strict=True))


def _remove(with_text: bool):
    def run(batches):
        for pdf in batches:
            rows = []
            for doc_id, text, packed in zip(pdf["doc_id"].astype(object).where(pdf["doc_id"].notna(), None), pdf["text"], pdf["packed"], strict=True):
                data = _encoded(text)
                spans = merged_spans(packed, len(data))
                kept, at = [], 0
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                left = b"".join([*kept, data[at:]])
                row = (doc_id, len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest())
                rows.append((*row, left.decode("utf-8", "ignore") if isinstance(text, str) else None) if with_text else row)
            frame = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["text"] * with_text])
            yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    return run


def remove_repeats(docs: DataFrame, with_text: bool = False, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs``.

    Each byte is removed that some 100-byte string covers which also starts
    earlier: in a smaller doc_id or before in the same document.  Null texts
    count as empty.  Equal rows are one document and each give the same result;
    of rows that share a doc_id but not a text none is earlier than another.
    Rows with a null id come after all others, in the order of a hash of their
    texts; those with equal texts are one document.  ``with_text`` adds what is
    left, without characters that were cut in two; null texts stay null.  An
    empty table gives an empty result; other columns are not read.
    """
    h = F.xxhash64(F.col("text").cast("string"))
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(_UNNAMED) + F.pmod(h, F.lit(_UNNAMED)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), place.alias("doc"), h.alias("node"), F.col("text").cast("string").alias("text"))
    order = ["key", "content", "doc", "node", "pack"]
    row = "key long, content long, doc long, node long, pack long"
    rows = texts.select("doc", "node", "text").mapInPandas(_segment_batches, row)
    met = rows.repartition(_route()).sortWithinPartitions(*order)
    found = cut(met.mapInPandas(_runs(crowd), "kind int, key long, doc long, node long, packed long"))
    # One row a key of at least CROWD contents.
    crowded = cut(found.where(F.col("kind") == _CROWD).select(F.col("key").alias("crowd")).distinct())
    crowded = F.broadcast(crowded) if crowded.count() <= BROADCAST_KEYS else crowded
    some = found.where(F.col("kind") == _COMPARE).join(crowded, F.col("key") == F.col("crowd"), "left")
    wanted = some.groupBy("doc", "node").agg(F.collect_list(F.struct("key", "packed", F.col("crowd").isNotNull().alias("crowd"))).alias("x"))
    # Equal rows are fetched from once.  The join reads the texts as the last one below does, so that one shuffle serves both.
    once = texts.join(wanted, ["doc", "node"], "left").dropDuplicates(["doc", "node"])
    fetched = once.mapInPandas(_fetch, f"{row}, piece binary")
    compared = fetched.repartition(_route()).sortWithinPartitions(*order).mapInPandas(_compare, "doc long, node long, packed long")
    whole = found.where(F.col("kind") == _WHOLE).select("doc", "node", "packed")
    spans = whole.unionByName(compared).groupBy("doc", "node").agg(F.collect_list("packed").alias("packed"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * with_text
    return texts.join(spans, ["doc", "node"], "left").select("doc_id", "text", "packed").mapInPandas(_remove(with_text), schema)


__all__ = ["remove_repeats", "repeated_windows"]
