"""Quality rules: a log-likelihood ratio of hashed n-grams beside plain counts.

Words and pairs of neighbouring words are hashed to a fixed number of buckets.
Two multinomials are counted, one over all trusted documents and one over the
whole raw corpus; a document's verdict is the mean, over its
n-grams, of the logarithm of the ratio of the two, held against a fixed
threshold.  Everything is DataFrame code without Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import words
from lodestone.plans.lineage import cut

#: Buckets of the hashed n-grams.
BUCKETS = 1 << 14
#: Ids of trusted documents that are broadcast, at most; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Added to every count.
SMOOTHING = 1.0
#: Documents whose mean log ratio is below this fail.
THRESHOLD = -0.1
#: Base rules: words a document must have, and the percentage of words that may
#: stand in repeated windows of WINDOW words.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
SYMBOLS = "#*$%&|<>"


def windows(w: Column) -> Column:
    """A hash and the place of every 3-word window of the array ``w``, in order.

    ``w`` should be a column of its own, as it is read at many places.
    """
    last = F.size(w) - WINDOW
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))


def _same(w: Column, a: Column, b: Column) -> Column:
    equal = a["h"] == b["h"]
    for k in range(WINDOW):
        equal = equal & (F.get(w, a["i"] + k) == F.get(w, b["i"] + k))
    return F.coalesce(equal, F.lit(False))


def base_rules(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every row, with ``base_failed``; null text: no words.

    Windows of a text with repeats are sorted by hash and place; equal neighbours
    are compared word by word, and the union of their places is summed in order.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        words(F.col("text")).alias("w"),
        F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    d = d.withColumns({"word_chars": F.length(F.array_join("w", "")).cast("long"), "grams": windows(F.col("w"))})
    d = d.withColumn("sorted", F.when(F.size("grams") > F.size(F.array_distinct("grams.h")), F.array_sort("grams")))
    s, w = F.col("sorted"), F.col("w")
    again = F.filter(s, lambda x, j: _same(w, x, F.get(s, j - 1)) | _same(w, x, F.get(s, j + 1)))
    d = d.withColumn("places", F.array_sort(F.transform(again, lambda x: x["i"])))
    p = F.col("places")
    steps = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
    d = d.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")).alias("n_repeat_words"),
    )
    # A filter on a count would otherwise be pushed through all of the above and repeat it.
    d = cut(d)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return d.withColumn("base_failed", failed)


def _pairs(docs: DataFrame, *keep: str) -> DataFrame:
    """A row for each word: its bucket ``one``, and ``two`` of it with the next word."""
    split = docs.select(*keep, words(F.col("text").cast("string")).alias("w"))
    zipped = F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))).alias("b"))
    each = split.select(*keep, F.explode(zipped).alias("g")).select(*keep, F.col("g").getField("a").alias("a"), F.col("g").getField("b").alias("b"))
    bucket = lambda *c: F.pmod(F.xxhash64(*c), F.lit(BUCKETS)).cast("int")
    return each.select(*keep, bucket("a").alias("one"), F.when(F.col("b").isNotNull(), bucket(F.lit(2), "a", "b")).alias("two"))


def ratio_table(docs: DataFrame, trusted: DataFrame, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """(bucket, weight): log of target over raw probability of every bucket.

    ``trusted`` holds doc_ids.  The target counts cover all documents of those
    ids, the raw counts all of ``docs``.  Without any trusted text all weights
    are zero.
    """
    ids = cut(trusted.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("__id")).distinct())
    ids = F.broadcast(ids) if ids.count() <= broadcast_ids else ids
    marked = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("__id"), "left")
    grams = _pairs(marked.withColumn("good", F.col("__id").isNotNull()), "good")
    both = grams.select("good", F.explode(F.array("one", "two")).alias("bucket")).where("bucket IS NOT NULL")
    counts = both.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count_if("good").alias("good"))
    counts = cut(counts)
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).first()
    if not total["good"]:
        return counts.select("bucket", F.lit(0.0).alias("weight"))
    share = lambda c: F.log((F.col(c) + SMOOTHING) / F.lit(float(total[c] + SMOOTHING * BUCKETS)))
    return cut(counts.select("bucket", (share("good") - share("raw")).alias("weight")))


def log_ratios(docs: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, log_ratio): mean weight of the n-grams of each doc_id with a word."""
    one = F.broadcast(table.select(F.col("bucket").alias("one"), F.col("weight").alias("w1")))  # BUCKETS rows at most
    two = F.broadcast(table.select(F.col("bucket").alias("two"), F.col("weight").alias("w2")))
    grams = _pairs(docs.select("doc_id", "text"), "doc_id").join(one, "one").join(two, "two", "left")
    n = F.count("w1") + F.count("w2")
    return grams.groupBy("doc_id").agg(((F.sum("w1") + F.coalesce(F.sum("w2"), F.lit(0.0))) / n).alias("log_ratio"))


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """The base counts of every row, ``log_ratio`` (null without words) and ``kept``.

    Rows that share a doc_id are counted one by one and share one ratio; so do
    rows with a null doc_id.  An empty table gives an empty result.
    """
    ratios = log_ratios(docs, ratio_table(docs, trusted, broadcast_ids)).withColumnRenamed("doc_id", "__id")
    both = base_rules(docs).join(ratios, F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    verdict = F.coalesce(F.col("log_ratio") >= threshold, F.lit(False))
    return both.withColumn("kept", ~F.col("base_failed") & verdict)
