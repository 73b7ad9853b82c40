"""Toxicity by a factorization machine over hashed terms.

A document is the set of its lower-cased terms (runs of bytes of its UTF-8 that
are ASCII letters or no ASCII at all), hashed to ``2**BITS`` buckets.  The machine adds a linear weight for each bucket and, through inner
products of low-rank factors, a weight for each pair of buckets that occur
together, so that an insult beside a group mention can count for more than the
sum of the two.  It is trained on the driver, on a bounded sample of labelled
rows, with proximal AdaGrad steps whose L1 term sets the weights of terms that
carry no signal to zero; only what is left goes to the executors.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Terms are hashed to two to this power of buckets.
BITS = 20
#: Labelled rows to train on, at most.
SAMPLE = 20_000
#: Rank of the pairwise factors.
RANK = 4
#: Training rows that must hold a bucket before it gets weights.
MIN_ROWS = 4

#: ASCII bytes that are no letters part terms.
_PARTS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_CACHE = 1 << 20


@dataclass
class Model:
    """A trained machine: ``rows`` maps a bucket to its row of ``w`` and ``v``."""

    bias: float
    rows: dict[int, int]
    w: np.ndarray
    v: np.ndarray

    def logit(self, at: np.ndarray) -> float:
        v = self.v[at]
        s = v.sum(axis=0)
        return float(self.bias + self.w[at].sum() + 0.5 * (s @ s - (v * v).sum()))


def terms(text: str | None) -> set[bytes]:
    """The distinct terms of a text; none for a null one."""
    return set((text or "").lower().encode("utf-8", "surrogatepass").translate(_PARTS).split())


def bucket(term: bytes) -> int:
    return zlib.crc32(term) & ((1 << BITS) - 1)


def buckets(text: str | None) -> list[int]:
    """The buckets of a text's terms, in ascending order."""
    return sorted(set(map(bucket, terms(text))))


def train(rows: list, labels: list[int], rank: int = RANK, epochs: int = 12, rate: float = 0.15, l1: float = 2.5e-4, l1_pairs: float = 1e-3, batch: int = 128, seed: int = 7) -> Model:
    """Fit the machine; with no rows at all it scores everything 0.

    With labels of one kind only, every score lies near that label.
    """
    if not rows:
        return Model(-40.0, {}, np.zeros(0), np.zeros((0, rank)))
    y = np.asarray(labels, np.float64)
    flat = np.concatenate([np.asarray(r, np.int32) for r in rows] + [np.zeros(0, np.int32)])
    sizes = np.array([len(r) for r in rows])
    often = np.bincount(flat) >= MIN_ROWS
    place = np.where(often, np.cumsum(often, dtype=np.int32) - 1, -1)
    known = np.flatnonzero(often)
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    cols = place[flat] if len(flat) else flat
    doc, cols = doc[cols >= 0], cols[cols >= 0]
    starts = np.searchsorted(doc, np.arange(len(rows) + 1))
    rng = np.random.default_rng(seed)
    m = len(known)
    w, v = np.zeros(m), rng.normal(0, 0.02, (m, rank))
    gw, gv = np.full(m, 1e-8), np.full((m, rank), 1e-8)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias, gb = float(np.log(share / (1 - share))), 1e-8
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            at = np.concatenate([cols[starts[d] : starts[d + 1]] for d in some])
            row = np.repeat(np.arange(len(some)), starts[some + 1] - starts[some])
            va = v[at]
            sums = np.stack([np.bincount(row, va[:, f], len(some)) for f in range(rank)], axis=1)
            z = bias + np.bincount(row, w[at], len(some)) + 0.5 * ((sums**2).sum(axis=1) - np.bincount(row, (va**2).sum(axis=1), len(some)))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) / len(some)
            gb += g.sum() ** 2
            bias -= rate * g.sum() / np.sqrt(gb)
            own, back = np.unique(at, return_inverse=True)
            step = np.bincount(back, g[row], len(own))
            gw[own] += step**2
            lr = rate / np.sqrt(gw[own])
            moved = w[own] - lr * step
            w[own] = np.sign(moved) * np.maximum(0, np.abs(moved) - lr * l1)
            for f in range(rank):
                step = np.bincount(back, g[row] * (sums[row, f] - va[:, f]), len(own))
                gv[own, f] += step**2
                lr = 0.3 * rate / np.sqrt(gv[own, f])
                moved = v[own, f] - lr * step
                v[own, f] = np.sign(moved) * np.maximum(0, np.abs(moved) - lr * l1_pairs)
    used = np.flatnonzero((w != 0) | (v != 0).any(axis=1))
    return Model(bias, {int(b): k for k, b in enumerate(known[used])}, w[used], v[used])


def _bucket_batches(batches):
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "terms": [np.array(buckets(t), "<i4").tobytes() for t in pdf["text"]]})


def fit(docs: DataFrame, labels: DataFrame, use: Column | None = None, sample: int = SAMPLE) -> Model:
    """Train on at most ``sample`` labelled documents.

    ``labels``: doc_id, toxic; null ids or labels are left out, of repeated ids
    the larger label holds.  ``use`` is a condition on doc_id that rows to learn
    from must meet.  If there are more labels than ``sample``, those with the
    least hash of the id are taken.  Of several texts of one doc_id the one whose
    buckets come first in order teaches, so that no id can outgrow the sample.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    if use is not None:
        known = known.where(use)
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    taken = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` pairs of numbers: bounded by the parameter.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(taken), "doc_id")
    seen = texts.select("doc_id", "toxic", "text").mapInPandas(_bucket_batches, "doc_id long, toxic int, terms binary")
    got = seen.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("terms").alias("terms"))
    got = sorted((bytes(r["terms"]), int(r["toxic"] > 0)) for r in got.select("toxic", "terms").coalesce(4).toLocalIterator())
    return train([np.frombuffer(t, "<i4") for t, _ in got], [k for _, k in got])


def _scorer(model: Model):
    def run(batches):
        cache: dict[bytes, int] = {}
        for pdf in batches:
            out = np.empty(len(pdf))
            for i, text in enumerate(pdf["text"]):
                at = set()
                for term in terms(text):
                    k = cache.get(term)
                    if k is None:
                        if len(cache) >= _CACHE:
                            cache.clear()
                        k = cache[term] = model.rows.get(bucket(term), -1)
                    at.add(k)
                at.discard(-1)
                out[i] = model.logit(np.fromiter(sorted(at), np.int64, len(at))) if at else model.bias
            yield pdf.drop(columns="text").assign(score=1 / (1 + np.exp(-np.clip(out, -40, 40))))

    return run


def _column_scorer(model: Model):
    run = _scorer(model)

    def scored(text: pd.Series) -> pd.Series:
        return next(run(iter([pd.DataFrame({"text": text})])))["score"]

    return scored


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row: the probability that it is toxic.

    Null and empty texts have no terms and get the machine's base rate.  Rows
    are scored on their own, so repeated rows get equal scores; an empty table
    gives an empty result.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(_scorer(model), schema)


def remove_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns kept, that score below ``threshold``."""
    score_one = F.pandas_udf(_column_scorer(model), T.DoubleType())
    return docs.where(score_one(F.col("text").cast("string")) < threshold)
