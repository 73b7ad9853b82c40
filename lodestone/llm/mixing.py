"""Mixing documents to domain targets with soft memberships.

A classifier learned from a labelled table gives every document a posterior over
the domains; projected-gradient least squares then finds a rate for
each document (at least 1, or at least 0 for a given total) such that the expected tokens of each domain, summed over all
documents with posterior times rate, meet the targets.  All of it is DataFrame
code: counts and sums are partial aggregates, the learned table has a fixed
number of buckets, and the only values that reach the driver are one sum for
each domain and iteration.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import SPACE, fresh
from lodestone.plans.lineage import cut

#: Buckets that lower-cased words are hashed to.
BUCKETS = 4096
#: Added to every count.
SMOOTHING = 0.5
#: The evidence of a longer document counts as that of so many words.
EVIDENCE = 40
#: Iterations at most, the largest relative miss of a target to stop at, and the rounds after which rates are written.
ROUNDS, TOLERANCE, WRITTEN = 200, 1e-6, 8
#: Without a given total, the total grows while a round leaves less than this part of the miss.
GAIN = 0.95
#: The search ends when a round leaves more than this part of the squared misses.
SETTLED = 0.9999
#: A domain with less than this share of all expected tokens counts as absent.
LEAST_SHARE = 1e-6
#: Shares of the token total that the registered query and the pipeline aim at.
TARGETS = {"en": 0.55, "fr": 0.17, "de": 0.17, "es": 0.11}


def _tokens(text: str | Column, *keep: str | Column) -> list[Column]:
    word = F.explode(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE)).alias("word")
    return [*keep, word]


def _bucketed(df: DataFrame, *keep: str) -> DataFrame:
    return df.where("word <> ''").select(*keep, F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int").alias("bucket"))


def domain_table(labelled: DataFrame, domains: list[str]) -> DataFrame:
    """(bucket, l0, l1, ...): log-probability of each bucket under each domain.

    ``labelled``: text, domain.  Rows of other or null domains teach nothing; a
    domain without rows gets a flat distribution.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col("domain").isin(domains)).select(*_tokens(F.col("text"), "domain"))
    counts = _bucketed(rows, "domain").groupBy("domain", "bucket").agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"), F.explode(F.array(*map(F.lit, domains))).alias("domain"))
    full = grid.join(counts, ["domain", "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + SMOOTHING)
    log_p = full.withColumn("l", F.log(F.col("n") / F.sum("n").over(Window.partitionBy("domain"))))
    return log_p.groupBy("bucket").agg(*[F.max(F.when(F.col("domain") == d, F.col("l"))).alias(f"l{i}") for i, d in enumerate(domains)])


def posteriors(docs: DataFrame, table: DataFrame, domains: list[str]) -> DataFrame:
    """(doc_id, n_tokens, p0, p1, ...) of the documents that hold a word."""
    words = _bucketed(docs.select(*_tokens(F.col("text"), "doc_id")), "doc_id")
    # BUCKETS rows of one number a domain: a fixed size.
    scored = words.join(F.broadcast(table), "bucket").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), *[F.sum(f"l{i}").alias(f"s{i}") for i in range(len(domains))])
    scale = F.least(F.lit(float(EVIDENCE)), F.col("n_tokens")) / F.col("n_tokens")
    top = F.greatest(*[F.col(f"s{i}") for i in range(len(domains))]) if len(domains) > 1 else F.col("s0")
    raw = scored.select("doc_id", "n_tokens", *[F.exp((F.col(f"s{i}") - top) * scale).alias(f"e{i}") for i in range(len(domains))])
    total = sum((F.col(f"e{i}") for i in range(1, len(domains))), F.col("e0"))
    return raw.select("doc_id", "n_tokens", *[(F.col(f"e{i}") / total).alias(f"p{i}") for i in range(len(domains))])


def _sums(members: DataFrame, rate: Column, k: int) -> list[float]:
    n = F.col("n_tokens")
    row = members.agg(F.sum(n).alias("n"), *[F.sum(n * F.col(f"p{i}") * rate).alias(f"a{i}") for i in range(k)]).first()
    return [float(x or 0.0) for x in row]


def document_rates(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], total: float | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, n_tokens (words), rate and the posterior of each domain.

    ``targets``: weight of each domain; they are scaled to sum to one over the
    domains that any document belongs to.  ``total``: tokens to aim at; documents
    may then be thinned out.  Without it no rate is less than 1, so that mixing
    repeats documents and loses none; the total starts as the least for which no
    domain must give up expected tokens and grows by what documents of several
    domains, raised for one of them, add to the others.  Rows of one doc_id are one
    document (null ids too) and get one row.  Documents without a word get
    n_tokens 0, rate 1 and null posteriors.  A domain with less than LEAST_SHARE of
    all expected tokens can't be raised to a target and counts as absent; that, and
    targets that are missed by more than a thousandth at the end, give a warning.
    An empty table gives an empty result.
    """
    domains = [d for d, w in targets.items() if w > 0]
    if not domains:
        raise ValueError("targets must give some domain a positive weight")
    k = len(domains)
    table = cut(domain_table(labelled, domains))
    members = cut(posteriors(docs, table, domains))
    n, *mass = _sums(members, F.lit(1.0), k)
    share = [m / n if n else 0.0 for m in mass]
    here = [i for i in range(k) if share[i] >= LEAST_SHARE]
    weight = sum(targets[domains[i]] for i in here)
    aim = {i: targets[domains[i]] / weight for i in here}
    size = total / n if total is not None and n else max((share[i] / aim[i] for i in here), default=1.0)
    rate, least, growing, missed = F.lit(1.0), float(total is None), total is None, float("inf")
    miss, lost = 0.0, float("inf")
    absent = [domains[i] for i in range(k) if i not in here]
    if n and absent:
        warnings.warn(f"no documents to speak of for {', '.join(absent)}: their targets are left out", stacklevel=2)
    for done in range(rounds if here else 0):
        if done and done % WRITTEN == 0:  # the rates so far become a column, so that no expression outgrows the plan
            members = cut(members.withColumn("rate", rate))
            rate = F.col("rate")
        now = _sums(members, rate, k)[1:]
        if growing:  # no domain is over its target, so that all rates only rise
            size = max(size, max(now[i] / n / aim[i] for i in here))
        off = {i: (now[i] / n - aim[i] * size) / share[i] for i in here}
        miss = max(abs(o) * share[i] / (aim[i] * size) for i, o in off.items())
        if miss <= tolerance:
            break
        loss = sum(o * o * share[i] for i, o in off.items())
        if not growing and loss > SETTLED * lost:
            break
        lost = loss if not growing else float("inf")
        # Targets that no rates reach would let the total grow without end.
        growing, missed = growing and miss < GAIN * missed, miss
        # Rows are weighted by 1 / share and rates by tokens; the step of one is then safe.
        rate = F.greatest(F.lit(least), rate - sum((F.col(f"p{i}") * F.lit(o) for i, o in off.items()), F.lit(0.0)))
    if miss > 1e-3:
        warnings.warn(f"the targets are missed by up to {miss:.3g} of their size", stacklevel=2)
    rated = members.select("doc_id", "n_tokens", rate.alias("rate"), *[F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)])
    ids = docs.select("doc_id").distinct().withColumnRenamed("doc_id", "id")
    joined = ids.join(rated, F.col("id").eqNullSafe(F.col("doc_id")), "left")
    return joined.select(F.col("id").alias("doc_id"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("rate", F.lit(1.0)).alias("rate"), *[f"p_{d}" for d in domains])


def copies(rate: Column, doc_id: Column) -> Column:
    """A rate, to four places, as a whole number: its fraction is a chance, drawn from the id."""
    rate = F.round(rate, 4)
    chance = F.pmod(F.xxhash64(F.lit("mixing"), doc_id), F.lit(1 << 24)) / F.lit(float(1 << 24))
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).cast("int")


def mix(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], **how) -> DataFrame:
    """``docs``, all columns kept, each row as often as its document's rate says."""
    rates = document_rates(docs.select("doc_id", "text"), labelled, targets, **how)
    id_name, times_name, each_name = (fresh(n, docs.columns) for n in ("id", "times", "each"))
    times = rates.select(F.col("doc_id").alias(id_name), copies(F.col("rate"), F.col("doc_id")).alias(times_name)).where(F.col(times_name) > 0)
    joined = docs.join(times, F.col("doc_id").eqNullSafe(F.col(id_name)))
    return joined.withColumn(each_name, F.explode(F.sequence(F.lit(1), F.col(times_name)))).select(*docs.columns)

