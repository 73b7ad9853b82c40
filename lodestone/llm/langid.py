"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds all substrings of a bounded sample of
labelled text.  A text is parsed from left to right into the longest phrases
that the automaton knows; the fewer phrases for its length, the closer the text
is to the language.  Blocks of ``BLOCK`` symbols are parsed in step, through a
table that holds for a state and a symbol either the next state or, marked, the
state after a new phrase has begun.  A phrase that is open at the end of a block
is then carried into the next one, up to the first place where both parses begin
a phrase and so go on alike: the counts are those of one parse of the whole text.

Every letter of the samples has a code of its own: a symbol, or several where the
samples have more letters than the table has columns.  Letters that no sample
has share one symbol, which no phrase holds.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Symbols of training text for each language, at most, and for all languages together.
SAMPLE, SAMPLES = 40_000, 600_000
#: Code points of a passage: training texts are cut whole into passages, which are drawn.
PASSAGE = 1_000
#: Symbols of the table, at most, and those of them that are digits of longer codes where letters are more.
WIDTH, DIGITS = 96, 32
#: Symbols of a block, and the blocks times languages that are parsed together, at most.
BLOCK, LANES = 2_048, 1 << 14
#: The prediction for texts without a letter.
UNKNOWN = "und"

_NEW = 1 << 30


@functools.lru_cache(maxsize=1)
def _lower_letters() -> np.ndarray:
    """The lower-case letter of every code point; 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _collapse(symbols: np.ndarray) -> np.ndarray:
    """Runs of separators become one."""
    keep = symbols != 0
    keep[1:] |= symbols[:-1] != 0
    return symbols[keep]


def automaton(symbols: list[int], width: int) -> np.ndarray:
    """The step table of a suffix automaton over symbols 0 to ``width`` - 1.

    Entry [state, symbol] is the next state, or ``_NEW`` plus the state after
    the symbol alone where the phrase can't go on; for a symbol that the sample
    lacks that is the root.
    """
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    table = np.empty((len(nxt), width), np.int32)
    table[:] = [_NEW + nxt[0].get(c, 0) for c in range(width)]
    for s, steps in enumerate(nxt):
        for c, t in steps.items():
            table[s, c] = t
    return table


class Alphabet:
    """Codes of the letters of some samples; 0 parts words, 1 is any other letter."""

    def __init__(self, texts: list[str]):
        lower = _lower_letters()
        seen, found = np.unique(np.concatenate([*(lower[_points(t)] for t in texts), np.zeros(0, np.uint32)]), return_counts=True)
        letters = [int(seen[i]) for i in np.lexsort((seen, -found)) if seen[i]]
        alone = len(letters) if len(letters) <= WIDTH - 2 else WIDTH - 2 - DIGITS
        self.width = 2 + alone + (DIGITS if len(letters) > alone else 0)
        self.digits = next(d for d in range(1, 5) if DIGITS**d >= len(letters) - alone)
        #: For each code point its symbol, or -1 less the number of its longer code.
        code = np.zeros(0x110000, np.int32)
        code[lower != 0] = 1
        by_letter = np.full(0x110000, 1, np.int32)
        for k, c in enumerate(letters):
            by_letter[c] = k + 2 if k < alone else alone - k - 1
        known = lower != 0
        code[known] = by_letter[lower[known]]
        self.code, self.first_digit = code, 2 + alone

    def symbols(self, text: str) -> np.ndarray:
        """The codes of a text's letters, words parted by one 0; empty without a letter."""
        code = self.code[_points(text)]
        if not code.any():
            return np.zeros(0, np.uint8)
        code = _collapse(code)
        if code.min() >= 0:
            return code.astype(np.uint8)
        size = np.where(code < 0, self.digits, 1)
        out = np.repeat(code, size)
        place = np.arange(len(out)) - np.repeat(np.cumsum(size) - size, size)
        long = out < 0
        out[long] = self.first_digit + (-1 - out[long]) // DIGITS ** (self.digits - 1 - place[long]) % DIGITS
        return out.astype(np.uint8)


class Parser:
    """Automata of all languages over one alphabet."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        self.alphabet = Alphabet([samples[k] for k in self.languages])
        room = min(SAMPLE, SAMPLES // max(1, len(samples)))
        self.tables = [automaton(self.alphabet.symbols(samples[k])[:room].tolist(), self.alphabet.width).ravel() for k in self.languages]

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text in each language, and the symbols of each text
        (0 for texts without a letter).

        A symbol that the sample lacks opens a phrase, to which the longest match
        after it belongs.
        """
        parsed = [self.alphabet.symbols(t) if t else np.zeros(0, np.uint8) for t in texts]
        sizes = np.array([len(s) for s in parsed], np.int64)
        counts = np.zeros((len(texts), len(self.languages)), np.int64)
        # Whole texts in each group, so that a phrase can be carried on; a text of many blocks may be a group alone.
        group, blocks, most = [], 0, max(1, LANES // max(1, len(self.languages)))
        for i in np.argsort(-sizes, kind="stable").tolist():
            n = -(-int(sizes[i]) // BLOCK)
            if group and (blocks + n > most or not n):
                self._count(group, parsed, counts)
                group, blocks = [], 0
            if n:
                group.append(i)
                blocks += n
        if group:
            self._count(group, parsed, counts)
        return counts, sizes

    def _count(self, group: list[int], parsed: list[np.ndarray], counts: np.ndarray) -> None:
        # Blocks of a text lie side by side; only a text's last one may be short.
        owner = np.repeat(group, [-(-len(parsed[i]) // BLOCK) for i in group])
        last = np.append(owner[1:] != owner[:-1], True)
        length = np.full(len(owner), BLOCK)
        length[last] = [(len(parsed[i]) - 1) % BLOCK + 1 for i in group]
        grid = np.zeros((int(length.max()), len(owner)), np.uint8)
        for k, (i, a) in enumerate(zip(group, np.flatnonzero(np.append(True, last[:-1])).tolist(), strict=True)):
            s = parsed[i]
            whole = len(s) // len(grid) if len(s) > len(grid) else 0
            grid[:, a : a + whole] = s[: whole * len(grid)].reshape(whole, len(grid)).T
            rest = s[whole * len(grid) :]
            if len(rest):
                grid[: len(rest), a + whole] = rest
        for k, table in enumerate(self.tables):
            np.add.at(counts[:, k], owner, _block_phrases(table, self.alphabet.width, grid, length, last))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text; ties go to the first language by name."""
        counts, sizes = self.phrases(texts)
        out = []
        for n, c in zip(sizes.tolist(), counts, strict=True):
            if not n or not len(c):
                out.append((UNKNOWN, 0.0))
                continue
            best = int(np.argmin(c))
            rest = np.delete(c, best)
            score = 1.0 - c[best] / rest.min() if len(rest) else 1.0
            out.append((self.languages[best], float(score)))
        return out


def _block_phrases(table: np.ndarray, width: int, grid: np.ndarray, length: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Phrases that begin in each block (a column of ``grid``), in the parse of the whole texts.

    ``last`` marks the last block of each text; the next one follows the others.
    """
    depth, lanes = grid.shape
    order = np.argsort(-length, kind="stable")
    ends = np.searchsorted(-length[order], -np.arange(depth), side="left")  # blocks that have a symbol there
    state, begins = np.zeros(lanes, np.int32), np.zeros((depth, lanes), bool)
    sorted_grid = grid[:, order]
    for i in range(depth):
        n = ends[i]
        step = table[state[:n] * np.int32(width) + sorted_grid[i, :n]]
        begins[i, :n] = step >= _NEW
        state[:n] = step & (_NEW - 1)
    begins[0] = True  # each block by itself begins with a phrase
    own = np.empty_like(begins)
    own[:, order] = begins
    out_state = np.empty_like(state)
    out_state[order] = state
    # At each place the phrases of the block from there on.
    rest = np.cumsum(own[::-1], axis=0, dtype=np.int16)[::-1]
    found = rest[0].astype(np.int64)
    # Carry each open phrase into the next block, to the first place where both parses begin one.
    # Where they never meet, the next block but one is entered otherwise and is parsed again.
    leave = out_state.copy()
    lane = np.flatnonzero(~last) + 1
    while len(lane):
        state, begun = leave[lane - 1], np.zeros(len(lane), np.int64)
        live = np.arange(len(lane))
        for i in range(depth):
            live = live[length[lane[live]] > i]
            if not len(live):
                break
            at = lane[live]
            step = table[state[live] * np.int32(width) + grid[i, at]]
            met = (step >= _NEW) & own[i, at]
            state[live] = step & (_NEW - 1)
            begun[live] += (step >= _NEW) & ~met
            done = live[met]
            begun[done] += rest[i, lane[done]]
            state[done] = out_state[lane[done]]
            live = live[~met]
        found[lane] = begun
        changed = state != leave[lane]
        leave[lane] = state
        lane = lane[changed & ~last[lane]] + 1
    return found


@functools.lru_cache(maxsize=2)
def _parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(dict(samples))


def collect_samples(docs: DataFrame, use: Column | None = None) -> dict[str, str]:
    """Training text of each language: a bounded sample of labelled passages.

    Rows with a null text, lang or doc_id teach nothing.  Whole texts are cut
    into passages of ``PASSAGE`` code points; of each language those with the
    least hash of text and place are taken, as many as hold about twice
    ``SAMPLE`` symbols, wherever in a text they lie.  Equal texts of a language
    count once.  The text sent to the driver is bounded by ``SAMPLES``, and by
    one passage a language.
    """
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").where(F.col("lang") != UNKNOWN)
    if use is not None:
        rows = rows.where(use)
    rows = rows.select("lang", F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    # Sized by distinct texts: copies draw the same passages.
    sizes = rows.select("lang", "h", F.length("text").alias("n")).distinct().groupBy("lang").agg(F.sum("n").alias("n"))
    chars = {r["lang"]: r["n"] for r in sizes.collect()}
    if not chars:
        return {}
    wanted = 2 * min(SAMPLE, SAMPLES // len(chars))
    share = lambda n: min(1 << 30, int((1 << 30) * (wanted + 40 * PASSAGE) / max(1, n)))
    limit = F.coalesce(*[F.when(F.col("lang") == k, F.lit(share(n))) for k, n in chars.items()])
    rows = rows.withColumn("limit", limit)
    places = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PASSAGE).cast("int"))
    draw = lambda i: F.pmod(F.xxhash64("h", i), F.lit(1 << 30))
    drawn = rows.where("text <> ''").select("lang", "h", "text", F.explode(F.filter(places, lambda i: draw(i) < F.col("limit"))).alias("i"))
    drawn = drawn.select("lang", draw(F.col("i")).alias("draw"), "h", "i", F.substr("text", F.col("i") * PASSAGE + 1, F.lit(PASSAGE)).alias("text")).distinct()
    out: dict[str, list[str]] = {}
    room = dict.fromkeys(chars, wanted)
    for r in sorted(drawn.collect()):
        if room[r["lang"]] > 0:
            out.setdefault(r["lang"], []).append(r["text"])
            room[r["lang"]] -= len(r["text"]) + 1
    return {k: "\n".join(v) for k, v in out.items()}


def identify(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """(doc_id, lang_pred, score) of every row.

    ``score`` is the margin by which the best language needs fewer phrases than
    the next, 0 to 1.  Null texts and texts without a letter are ``und`` with
    score 0, and so is everything if nothing was learned.  Rows are read one by
    one; an empty table gives an empty result.
    """
    learned = tuple(sorted(samples.items()))
    schema = "doc_id long, lang_pred string, score double"

    def run(batches):
        parser = _parser(learned)
        for pdf in batches:
            for a in range(0, len(pdf), 2000):
                part = pdf.iloc[a : a + 2000]
                found = parser.predict(part["text"].tolist())
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").to_numpy(), "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, schema)


__all__ = ["Parser", "automaton", "collect_samples", "identify"]
