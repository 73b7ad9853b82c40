"""Exact top-k search by inner product in M-trees.

The upper level is a set of routing objects, picked from a bounded sample: every
vector belongs to the nearest of them, and each keeps its covering radius.  The
vectors of one routing object form shards of a bounded size, and a task holds the
M-tree of one shard at a time: pages of at most ``PAGE`` entries, an inner entry
with its routing object, covering radius and the distance to its parent's routing
object, a leaf entry with that distance.

A query first searches the shard that promises most.  The k-th score found there
goes with it to all further shards, of which only those are visited whose bound
reaches that score.  Queries stream through a shard in blocks that search its
tree best first; entries whose stored distances rule them out by the triangle
inequality are skipped without computing a distance, and what is left of a page
is computed for all queries of the block that need it at once.

Inner products order candidates as distances do once a coordinate is added to
every vector x that brings all to one length M: for a query q with 0 there,
|q - x|^2 = |q|^2 + M^2 - 2 q.x.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.plans.lineage import cut

#: Vectors of a shard, on average; entries of a page, at most.
SHARD, PAGE = 8192, 256
#: Routing objects of the upper level, at most, and the vectors that they are picked from.
PIVOTS, SAMPLE = 256, 2048
#: Queries that search a tree together, and those that one task sends through a shard, on average.
BLOCK, GROUP = 256, 1 << 16
#: Neighbours returned.
K = 20
#: Vectors are multiplied by this before they are rounded down to integers.
SCALE = 64.0
#: Distances are widened by this share of the lengths, far beyond their rounding.
_SLACK = 1e-7
_EXACT, _LONG = 1 << 52, (1 << 63) - 1


@dataclass(frozen=True)
class Metric:
    """What turns integer vectors into points of one length.

    Points are divided by ``unit``; ``length2`` is the square of their length;
    ``exact`` tells whether doubles hold all scores.
    """

    width: int
    unit: float
    length2: float
    exact: bool

    @classmethod
    def of(cls, vectors: np.ndarray) -> Metric:
        largest = float(np.abs(vectors).max(initial=0.0))
        unit = max(1.0, largest)
        return cls(vectors.shape[1], unit, float(((vectors / unit) ** 2).sum(axis=1).max(initial=0.0)), largest * largest * max(1, vectors.shape[1]) < _EXACT)

    def points(self, vectors: np.ndarray) -> np.ndarray:
        x = vectors / self.unit
        return np.column_stack([x, np.sqrt(np.maximum(0.0, self.length2 - (x * x).sum(axis=1)))])

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        return np.column_stack([vectors / self.unit, np.zeros(len(vectors))])

    def slack(self, queries: np.ndarray) -> np.ndarray:
        """What a query's distances may be off by."""
        return _SLACK * (np.sqrt((queries * queries).sum(axis=1)) + np.sqrt(self.length2) + 1e-300)

    def reach(self, queries: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """No vector at this distance from its query (a row) or farther has a larger score over ``unit`` squared."""
        squares = (queries * queries).sum(axis=1) + self.length2
        near = np.maximum(0.0, distance - 4 * self.slack(queries)[:, None])
        return (squares[:, None] - near * near) / 2 + 1e-12 * squares[:, None] + 0.25 / self.unit / self.unit

    def bound(self, limit: np.ndarray) -> np.ndarray:
        """Limits as ``reach`` gives them; at the least score that is told apart there is none."""
        return np.where(limit <= -_LONG, -np.inf, limit / self.unit / self.unit)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` to all rows of ``b``."""
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(0.0, squares))


def spread(points: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` rows of ``points`` that lie far apart, none equal to another."""
    centre = points.mean(axis=0)[None]
    chosen = [int(np.argmin(distances(points, centre)))]
    near = distances(points, points[chosen])[:, 0]
    while len(chosen) < n and near.max() > 1e-6 * (1 + np.abs(points).max()):
        chosen.append(int(np.argmax(near)))
        near = np.minimum(near, distances(points, points[chosen[-1:]])[:, 0])
    return np.array(chosen)


@dataclass
class _Page:
    centre: np.ndarray
    radius: float
    to_parent: np.ndarray  # distance of each entry to ``centre``
    rows: np.ndarray | None = None  # of a leaf: rows of the matrix
    children: list = field(default_factory=list)
    centres: np.ndarray | None = None  # of an inner page: routing objects and radii of the children
    radii: np.ndarray | None = None


class MTree:
    """An M-tree over integer vectors (held as doubles), loaded in bulk.

    ``scored`` counts the scores computed by searches.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, page: int = PAGE, metric: Metric | None = None):
        self.ids, self.vectors, self.page = ids, vectors.astype(np.float64), page
        self.metric = metric or Metric.of(self.vectors)
        self.repeated = len(np.unique(ids)) < len(ids)
        self.points = self.metric.points(self.vectors)
        self.scored = 0
        self.root = self._load(np.arange(len(ids)))

    def _load(self, rows: np.ndarray) -> _Page:
        """A page over rows: a leaf, or one child for each of some far-apart routing objects."""
        own = self.points[rows]
        centre = own.mean(axis=0) if len(rows) else np.zeros(self.points.shape[1])
        if len(rows):  # a routing object is an object of the set
            centre = own[np.argmin(distances(own, centre[None])[:, 0])]
        far = distances(own, centre[None])[:, 0]
        if len(rows) <= self.page:
            return _Page(centre, float(far.max(initial=0.0)), far, rows=rows)
        chosen = spread(own, min(self.page, max(2, -(-len(rows) * 2 // self.page))))
        owner = np.argmin(distances(own, own[chosen]), axis=1)
        parts = [rows[owner == i] for i in range(len(chosen))]
        parts = [p for p in parts if len(p)]
        if len(parts) == 1:  # equal objects: any halves will do
            parts = [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
        children = [self._load(p) for p in parts]
        centres = np.array([c.centre for c in children])
        return _Page(centre, float(far.max()), distances(centres, centre[None])[:, 0], children=children, centres=centres, radii=np.array([c.radius for c in children]))

    def _scores(self, asked: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Scores of some queries with some rows; beyond a long's range its nearest end."""
        self.scored += len(asked) * len(rows)
        if self.metric.exact:
            return np.rint(asked @ self.vectors[rows].T).astype(np.int64)
        whole = np.vectorize(int, otypes=[object])
        found = whole(asked) @ whole(self.vectors[rows]).T
        return np.clip(found, -_LONG, _LONG).astype(np.int64)

    def search(self, asked: np.ndarray, own: np.ndarray, k: int, limits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) rows of the k best ids of each query, by query, falling score and id.

        ``asked`` has a row for each query; rows of the id ``own`` are none of its
        candidates.  An id counts with the best score of its vectors.  Scores
        below a query's entry of ``limits`` may be left out.
        """
        n = len(asked)
        asked = asked.astype(np.float64)
        limit = np.full(n, -np.inf) if limits is None else limits.astype(np.float64)
        q, ids, scores = (np.zeros(0, np.int64) for _ in range(3))
        points = self.metric.queries(asked)
        every = np.arange(n)
        first = distances(points, self.root.centre[None])[:, 0]
        heap, number = [(0.0, 0, every, first, self.root)], 0
        while heap:
            _, _, some, at, page = heapq.heappop(heap)
            bound = self.metric.bound(limit)
            fine = self.metric.reach(points[some], at[:, None] - page.radius)[:, 0] >= bound[some]
            some, at = some[fine], at[fine]
            if not len(some):
                continue
            apart = np.abs(at[:, None] - page.to_parent[None])
            if page.rows is None:
                may = self.metric.reach(points[some], apart - page.radii[None]) >= bound[some, None]
                take = np.flatnonzero(may.any(axis=0))
                d = distances(points[some], page.centres[take])
                low = np.maximum(0.0, d - page.radii[take][None])
                may = may[:, take] & (self.metric.reach(points[some], low) >= bound[some, None])
                for i in np.flatnonzero(may.any(axis=0)):
                    number += 1
                    on = may[:, i]
                    heapq.heappush(heap, (float(low[on, i].min()), number, some[on], d[on, i], page.children[take[i]]))
                continue
            may = self.metric.reach(points[some], apart) >= bound[some, None]
            need, take = may.any(axis=1), may.any(axis=0)
            some, rows = some[need], page.rows[take]
            if not len(some):
                continue
            found = self._scores(asked[some], rows)
            good = (found >= limit[some, None]) & (self.ids[rows][None] != own[some, None])
            if not self.repeated and len(rows) > k:  # the k-th best of this page bounds the k-th of all
                kth = -np.partition(-np.where(good, found, -_LONG), k - 1, axis=1)[:, k - 1]
                good &= found >= kth[:, None]
            i, j = np.nonzero(good)
            if not len(i):
                continue
            touched = np.zeros(n, bool)
            touched[some[i]] = True
            old = touched[q]
            new_q, new_ids, new_scores = np.concatenate([q[old], some[i]]), np.concatenate([ids[old], self.ids[rows[j]]]), np.concatenate([scores[old], found[i, j]])
            new_q, new_ids, new_scores = _best(new_q, new_ids, new_scores, k, self.repeated)
            q, ids, scores = (np.concatenate([a[~old], b]) for a, b in ((q, new_q), (ids, new_ids), (scores, new_scores)))
            full = np.flatnonzero(np.bincount(new_q, minlength=n) == k)
            ends = np.searchsorted(new_q, full, side="right") - 1
            limit[full] = np.maximum(limit[full], new_scores[ends])
        order = np.lexsort((ids, -scores, q))
        return q[order], ids[order], scores[order]


def _best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int, repeated: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best ids of each query, by query, falling score and id."""
    if repeated:  # an id's best score only
        order = np.lexsort((-scores, ids, q))
        q, ids, scores = q[order], ids[order], scores[order]
        head = np.ones(len(q), bool)
        head[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
        q, ids, scores = q[head], ids[head], scores[head]
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
    return q[rank < k], ids[rank < k], scores[rank < k]


def quantised(embeddings: DataFrame, scale: float = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each valid vector's components, as doubles.

    Left out: null ids, null vectors and those with null or non-finite
    components, also where only their multiple is not finite.  Repeated rows
    count once.
    """
    x = F.transform("embedding", lambda y: F.lit(scale) * y.cast("double"))
    fine = F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < F.lit(float("inf"))))
    good = embeddings.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(F.coalesce(fine, F.lit(False)))
    # a double of 2^53 or more is whole, and beyond a long's range its floor would be cut
    whole = F.transform(x, lambda y: F.when(F.abs(y) < F.lit(float(1 << 53)), F.floor(y).cast("double")).otherwise(y))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")).distinct()


def _matrix(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _assigner(metric: Metric, pivots: np.ndarray):
    """Each vector's nearest routing object and its distance to it."""

    def run(batches):
        for pdf in batches:
            d = distances(metric.points(_matrix(pdf["v"], metric.width)), pivots)
            yield pdf.assign(pivot=np.argmin(d, axis=1).astype(np.int32), far=d.min(axis=1) if len(d) else np.zeros(0))

    return run


def _router(metric: Metric, pivots: np.ndarray, radii: np.ndarray, first: np.ndarray, ways: np.ndarray, start: bool):
    """The shards that a query must visit: the most promising one, or all others that its bound leaves."""

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            points = metric.queries(_matrix(pdf["v"], metric.width))
            d = distances(points, pivots)
            home = np.argmin(np.where(radii[None] < 0, np.inf, d), axis=1)
            seed = first[home] + pdf["h"].to_numpy() % ways[home]
            if start:
                yield pd.DataFrame({"shard": seed, "vec_id": pdf["vec_id"], "v": pdf["v"], "floor": -np.inf, "near": home})
                continue
            floor = pdf["floor"].to_numpy(np.float64)
            may = (metric.reach(points, np.maximum(0.0, d - radii[None])) >= metric.bound(floor)[:, None]) & (radii[None] >= 0)
            for p in range(len(pivots)):
                for s in range(first[p], first[p] + ways[p]):
                    go = may[:, p] & (seed != s)
                    if go.any():
                        yield pd.DataFrame({"shard": s, "vec_id": pdf["vec_id"][go], "v": pdf["v"][go], "floor": floor[go], "near": home[go]})

    return run


def _searcher(metric: Metric, k: int, page: int):
    def run(batches):
        """Rows sorted by cell, vectors before queries; a tree is built where the first query follows."""
        cell, ids, vectors, tree = None, [], [], None
        for pdf in batches:
            cells, kinds = pdf["cell"].to_numpy(), pdf["kind"].to_numpy()
            edges = np.flatnonzero((cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])) + 1 if len(pdf) else []
            out = [np.zeros((3, 0), np.int64)]
            for a, b in zip([0, *edges], [*edges, len(pdf)], strict=True):
                if a == b:
                    continue
                if cells[a] != cell:
                    cell, ids, vectors, tree = cells[a], [], [], None
                own, v = pdf["vec_id"].to_numpy(np.int64)[a:b], _matrix(pdf["v"].iloc[a:b], metric.width)
                if kinds[a] == 0:
                    ids.append(own)
                    vectors.append(v)
                    continue
                if not ids:
                    continue
                if tree is None:
                    tree = MTree(np.concatenate(ids), np.concatenate(vectors), page, metric)
                for c in range(0, len(own), BLOCK):
                    q, other, score = tree.search(v[c : c + BLOCK], own[c : c + BLOCK], k, pdf["floor"].to_numpy(np.float64)[a + c : min(b, a + c + BLOCK)])
                    out.append(np.stack([own[c : c + BLOCK][q], other, score]))
            yield pd.DataFrame(np.concatenate(out, axis=1).T, columns=["query_id", "vec_id", "score"])

    return run


def top_k(embeddings: DataFrame, is_query: Column, k: int = K, scale: float = SCALE, shard: int = SHARD, page: int = PAGE, pivots: int = PIVOTS, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of every query, all if fewer.

    ``is_query`` is a condition on vec_id.  Vectors of different lengths are
    compared as if the shorter ended in zeros.  Rows with the query's vec_id are
    its own and no candidates; ties go to the smaller vec_id.  A vec_id with
    several vectors is a query for each, of which the best scores count.  Scores
    beyond the range of a long count as its nearest end.  An empty table, or one
    without queries, gives an empty result.
    """
    spark = embeddings.sparkSession
    result = "query_id long, rank int, vec_id long, score long"
    vectors = cut(quantised(embeddings, scale))
    size = lambda f: F.aggregate("v", F.lit(0.0), lambda a, y: f(a, y))
    row = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.max(size(lambda a, y: F.greatest(a, F.abs(y)))).alias("largest"), F.count_if(is_query).alias("asks")).first()
    if not row["n"] or not row["asks"]:
        return spark.createDataFrame([], result)
    unit, width = max(1.0, row["largest"]), max(1, row["width"])
    length2 = vectors.agg(F.max(size(lambda a, y: a + (y / unit) * (y / unit)))).first()[0]
    metric = Metric(width, unit, float(length2), row["largest"] * row["largest"] * width < _EXACT)
    # At most SAMPLE rows, from which at most ``pivots`` routing objects are picked.
    sample = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).select("v").collect()
    points = metric.points(_matrix([r["v"] for r in sample], width))
    routing = points[spread(points, min(pivots, -(-row["n"] // shard)))]

    schema = "vec_id long, v array<double>, asks boolean, pivot int, far double"
    owned = cut(vectors.withColumn("asks", F.coalesce(is_query, F.lit(False))).mapInPandas(_assigner(metric, routing), schema))
    known = {r["pivot"]: r for r in owned.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}
    ways = np.array([-(-known[p]["n"] // shard) if p in known else 0 for p in range(len(routing))], np.int64)
    radii = np.array([known[p]["far"] if p in known else -1.0 for p in range(len(routing))])
    first = np.cumsum(ways) - ways
    of_pivot = lambda x: F.element_at(F.lit(x.tolist()), F.col("pivot") + 1)
    # The vectors of a routing object are dealt by their hash: however many it has, no shard outgrows the others.
    dealt = owned.select((of_pivot(first) + F.pmod(F.xxhash64("vec_id", "v"), of_pivot(ways))).alias("shard"), "vec_id", "v")
    asks = owned.where("asks").select("vec_id", "v", F.pmod(F.xxhash64("v", "vec_id"), F.lit(1 << 62)).alias("h"))

    def searched(routes: DataFrame) -> DataFrame:
        # Tasks take one part of a shard's queries each, so that their work is bounded too.
        parts = max(1, -(-row["asks"] // group))
        part = lambda c: (F.col("shard") * parts + c).alias("cell")
        none, zero = F.lit(float("-inf")), F.lit(0).cast("long")
        each = F.explode(F.sequence(zero, F.lit(parts - 1).cast("long")))
        there = dealt.select("shard", "vec_id", "v", each.alias("part")).select(part(F.col("part")), F.lit(0).alias("kind"), "vec_id", "v", none.alias("floor"), zero.alias("near"))
        come = routes.select(part(F.pmod(F.xxhash64("vec_id"), F.lit(parts))), F.lit(1).alias("kind"), "vec_id", "v", "floor", "near")
        rows = there.unionByName(come).repartition("cell").sortWithinPartitions("cell", "kind", "near", "vec_id")
        found = rows.mapInPandas(_searcher(metric, k, page), "query_id long, vec_id long, score long")
        return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    def ranked(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    route = "shard long, vec_id long, v array<double>, floor double, near long"
    start = ranked(searched(asks.mapInPandas(_router(metric, routing, radii, first, ways, True), route)))
    if ways.sum() == 1:  # the first shard is all there is
        return start
    start = cut(start)
    floors = start.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score").cast("double")).otherwise(F.lit(float("-inf"))).alias("floor"))
    limited = asks.join(floors, asks["vec_id"] == floors["query_id"], "left").select("vec_id", "v", "h", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    more = searched(limited.mapInPandas(_router(metric, routing, radii, first, ways, False), route))
    both = start.drop("rank").unionByName(more).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return ranked(both)
