"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.lineage import cut


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step over directed rows (u, v).

    ``larger``: every neighbour above u is linked to the least of u and its
    neighbours; otherwise u and its neighbours below it are.  The minimum is a
    partial aggregate, and joining it back leaves a hot node to the skew join.
    """
    if larger:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if larger:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        below = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = below.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h"),
    ).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge to another node.

    ``edges`` holds two long columns ``u`` and ``v``; rows with a null end and
    self-loops are ignored, repeated and reversed rows count once.  ``component``
    is the least node that can be reached.  Nodes without edges are not returned:
    they are their own component.  An empty input gives an empty result.  Raises
    RuntimeError if ``max_rounds`` rounds (far above the logarithm of any
    realistic size) do not settle.
    """
    now = cut(
        edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
        .distinct()
    )
    before = _digest(now)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        now = cut(_stars(_stars(now, True), False))
        after = _digest(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
