"""Scores of candidate pairs: one for each column pair, their weighted mean, a label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.similarity import similarity
from lodestone.functions.text import normalize
from lodestone.plans.specs import PairSpec, Settings

#: Algorithms inside whole-stage code generation, which are worth computing first.
NATIVE = ("levenshtein", "numeric_similarity", "date_similarity")


def score_names(specs: Sequence[PairSpec]) -> list[str]:
    """``score_<left>``, with the right column added where a left one occurs twice."""
    lefts = [s.left for s in specs]
    return [f"score_{s.left}" if lefts.count(s.left) == 1 else f"score_{s.left}_{s.right}" for s in specs]


def normal_forms(df: DataFrame, columns: Sequence[tuple[str, str]], prefix: str) -> DataFrame:
    """``__idx`` and the normal form of each (column, type), as ``prefix<i>``: all that scoring reads."""
    return df.select("__idx", *[normalize(kind, F.col(f"`{c}`")).alias(f"{prefix}{i}") for i, (c, kind) in enumerate(columns)])


def classify(score: Column, settings: Settings) -> Column:
    low, high = settings.bounds()
    return F.when(score >= high, "accept").when(score <= low, "reject").otherwise("undecided")


def weighted_mean(scores: Sequence[Column], specs: Sequence[PairSpec]) -> Column:
    """Null if all weights are zero."""
    weight = sum(s.weight for s in specs)
    if not weight:
        return F.lit(None).cast("double")
    return sum((F.lit(s.weight) * c for s, c in zip(specs, scores, strict=True)), F.lit(0.0)) / F.lit(weight)


def score_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, specs: Sequence[PairSpec], at_least: float | None = None) -> DataFrame:
    """``pairs`` (idx1, idx2) with a column ``s<i>`` for each column pair.

    ``left`` and ``right`` are normal forms (``a<i>``, ``b<i>``).  With ``at_least``
    rows that cannot reach that mean by their native scores go before the Python
    kernels run; rows below it may be missing.
    """
    joined = pairs.join(left.withColumnRenamed("__idx", "idx1"), "idx1").join(right.withColumnRenamed("__idx", "idx2"), "idx2")
    native = [i for i, s in enumerate(specs) if s.how in NATIVE]
    scored = joined.withColumns({f"s{i}": similarity(specs[i].how, F.col(f"a{i}"), F.col(f"b{i}")) for i in native}) if native else joined
    rest = [i for i in range(len(specs)) if i not in native]
    total = sum(s.weight for s in specs)
    if at_least is not None and native and rest and total:
        best = sum((F.lit(specs[i].weight) * F.col(f"s{i}") for i in native), F.lit(sum(specs[i].weight for i in rest)))
        scored = scored.where(best / total >= at_least - 1e-9)
    if rest:
        scored = scored.withColumns({f"s{i}": similarity(specs[i].how, F.col(f"a{i}"), F.col(f"b{i}")) for i in rest})
    return scored.select("idx1", "idx2", *[f"s{i}" for i in range(len(specs))])


def early_mean(specs: Sequence[PairSpec], perfect: float) -> tuple[Column, list[Column]]:
    """The mean of the first columns whose running mean reaches ``perfect``, else of
    all, and the scores with those after the stop null."""
    scores = [F.col(f"s{i}") for i in range(len(specs))]
    prefixes = []
    for k in range(1, len(specs) + 1):
        prefixes.append(weighted_mean(scores[:k], specs[:k]))
    mean, kept, stopped = prefixes[-1], [], F.lit(False)
    for p in reversed(prefixes[:-1]):
        mean = F.when(F.coalesce(p >= perfect, F.lit(False)), p).otherwise(mean)
    for s, p in zip(scores, prefixes, strict=True):
        kept.append(F.when(~stopped, s))
        stopped = stopped | F.coalesce(p >= perfect, F.lit(False))
    return mean, kept
