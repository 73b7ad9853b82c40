"""SimHash near-duplicates by a grid range-join over segment popcounts.

A 64-bit fingerprint is embedded as the popcounts of its 16 four-bit segments.
The Manhattan distance of two embeddings never exceeds the Hamming distance of
the fingerprints.  Embeddings are points of an integer grid, and two points are
within distance two exactly if some grid point is within one of both: the range
join sends every fingerprint to its own point and to that point's neighbours,
and what meets at a point is verified bit by bit.  A point at which more than
``CELL`` distinct fingerprints meet is split by further coordinates, down to
segments of one bit, where the Manhattan distance is the Hamming distance: all
that meet there are within two bits of each other, so that a star around the
least keeps every link exactly and no pairs are formed.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.operators.components import connected_components
from lodestone.plans.lineage import cut

#: Seed of the shingle hash.
SEED = 42
#: Words in a shingle.
SHINGLE = 3
#: Linked fingerprints differ in at most so many bits.
RADIUS = 2
#: Distinct fingerprints up to which those that meet at a grid point are paired off.
CELL = 32
#: Bits of a segment.
SEGMENT = 4

_CHUNK = 1 << 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None) -> int:
    """The unsigned SimHash of one text; 0 where there is no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) < SHINGLE:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(words) - SHINGLE + 1], ends[SHINGLE - 1 :]
    n, ones = len(starts), np.zeros(64, np.int64)
    for i in range(0, n, _CHUNK):
        spans = zip(starts[i : i + _CHUNK].tolist(), ends[i : i + _CHUNK].tolist(), strict=True)
        grams = [flat[a:b] for a, b in spans]
        h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(grams))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _batches(batches):
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fp": np.array([_signed(fingerprint(t)) for t in pdf["text"]], np.int64)})


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id long, fp long): the fingerprint's 64 bits as a signed long."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(_batches, schema)


def segment_popcounts(fp: Column) -> Column:
    """The popcount of each four-bit segment, in the place of the segment."""
    half = lambda x, shift, mask: F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(mask))
    low, high = half(fp, 0, 0x5555555555555555), half(fp, 1, 0x5555555555555555)
    two = low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))
    return half(two, 0, 0x3333333333333333) + half(two, 2, 0x3333333333333333)


def grid_points(emb: Column) -> Column:
    """A packed embedding and its neighbours on the grid, as an array."""
    at = [emb]
    for shift in range(0, 64, SEGMENT):
        digit = F.shiftrightunsigned(emb, shift).bitwiseAND(F.lit(15))
        step = F.lit(_signed(1 << shift)).cast("long")
        at += [F.when(digit < SEGMENT, emb.bitwiseXOR(step * digit).bitwiseOR(step * (digit + 1))), F.when(digit > 0, emb.bitwiseXOR(step * digit).bitwiseOR(step * (digit - 1)))]
    return F.array_compact(F.array(*at))


def fingerprint_links(reps: DataFrame, cell: int = CELL) -> DataFrame:
    """Edges (u, v) between ``rep`` ids whose fingerprints are within two bits.

    ``reps`` has one row (rep, fp) for each distinct fingerprint.  The edges
    connect exactly the fingerprints that a chain of links connects; where many
    meet there are stars in place of all their pairs.
    """
    points = reps.withColumn("emb", segment_popcounts(F.col("fp")))
    spread = points.select("rep", "fp", "emb", F.explode(grid_points(F.col("emb"))).alias("key"))
    met = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut(spread.join(met, "key"))
    few = shared.where(F.col("n") <= cell)
    a = few.select("key", F.col("rep").alias("u"), F.col("fp").alias("fu"), F.col("emb").alias("eu"))
    b = few.select("key", F.col("rep").alias("v"), F.col("fp").alias("fv"), F.col("emb").alias("ev"))
    near = (
        a.join(b, "key")
        .where("u < v")
        .where("eu <> ev OR eu = key")  # one point has the same neighbours; once is enough
        .where(F.bit_count(F.col("fu").bitwiseXOR(F.col("fv"))) <= RADIUS)
        .select("u", "v")
    )
    crowd = shared.where(F.col("n") > cell).select("rep", "fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)).cast("long") for i in range(64)])
    one_off = crowd.select("rep", "fp", F.explode(flips).alias("flip")).select("rep", F.col("fp").bitwiseXOR(F.col("flip")).alias("key"))
    # At most 65 distinct fingerprints lie within one bit of a key.
    star = one_off.withColumn("least", F.min("rep").over(Window.partitionBy("key"))).where("least < rep").select(F.col("least").alias("u"), F.col("rep").alias("v"))
    return near.unionByName(star).distinct()


def _same_id_links(hashed: DataFrame, reps: DataFrame) -> DataFrame:
    """Edges (u, v) from each doc_id of several fingerprints to the reps of these."""
    several = hashed.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("doc_id IS NOT NULL AND a <> b").select("doc_id")
    rows = hashed.join(several, "doc_id", "left_semi").distinct()
    return rows.join(reps, "fp").where("rep <> doc_id").select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))


def near_duplicates(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs``.

    Words are split at ASCII white space after lower-casing A-Z; null, empty and
    blank texts have fingerprint zero and link like any other.  ``component_id``
    is the smallest doc_id reachable over links of at most two bits.  Repeated
    rows and repeated doc_ids each give their row; a doc_id stands for one node.
    Rows with a null doc_id link nothing and get their fingerprint's component,
    null if no row with an id shares it.  An empty table gives an empty result;
    other columns are not read.
    """
    hashed = cut(fingerprints(docs))
    reps = cut(hashed.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    parts = connected_components(fingerprint_links(reps, cell).unionByName(_same_id_links(hashed, reps)))
    named = (
        reps.join(parts, reps["rep"] == parts["node"], "left")
        .select(reps["fp"].alias("rep_fp"), F.coalesce(parts["component"], reps["rep"]).alias("component_id"))
    )
    return hashed.join(named, hashed["fp"] == named["rep_fp"], "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_representatives(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """The rows of ``docs`` whose doc_id names its group, all columns kept.

    Of rows with equal doc_id one stays; rows with a null doc_id all stay.
    """
    groups = near_duplicates(docs.select("doc_id", "text"), cell)
    heads = groups.where("doc_id = component_id").select(F.col("doc_id").alias("__head")).distinct()
    kept = docs.join(heads, docs["doc_id"] == heads["__head"], "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id IS NULL"))
