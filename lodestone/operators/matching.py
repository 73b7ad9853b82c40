"""Fuzzy matching of two tables: the best right row of each left row, or all of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.blocking import candidate_pairs
from lodestone.operators.scoring import classify, early_mean, normal_forms, score_names, score_pairs, weighted_mean
from lodestone.plans.specs import PairSpec, Settings, analyze_columns
from lodestone.sources.loaders import clean_strings, with_index


def prepare(df: DataFrame, key: str | None) -> DataFrame:
    """Cleaned strings and ``__idx``."""
    return df if "__idx" in df.columns else with_index(clean_strings(df), key)


def match_pairs(left: DataFrame, right: DataFrame, specs: Sequence[PairSpec], settings: Settings) -> DataFrame:
    """(idx1, idx2, score columns, overall_score) of the matches of prepared tables.

    In best-match mode the highest score wins, then the smaller idx2; a row whose
    best is 0 has no match.  With early termination a candidate at or above the
    perfect threshold beats all others, the smallest idx2 first.
    """
    pairs = candidate_pairs(left, right, specs, settings)
    a = normal_forms(left, [(s.left, s.left_type) for s in specs], "a")
    b = normal_forms(right, [(s.right, s.right_type) for s in specs], "b")
    names, low = score_names(specs), settings.bounds()[0]
    scored = score_pairs(pairs, a, b, specs, low if settings.return_all_matches else None)
    plain = [F.col(f"s{i}") for i in range(len(specs))]
    early = settings.early_termination and not settings.return_all_matches
    mean, kept = early_mean(specs, settings.perfect_match_threshold) if early else (weighted_mean(plain, specs), plain)
    whole = scored.select("idx1", "idx2", *[c.alias(n) for c, n in zip(kept, names, strict=True)], mean.alias("overall_score")).where("overall_score IS NOT NULL")
    if settings.return_all_matches:
        return whole.where(F.col("overall_score") >= low)
    score = F.col("overall_score")
    perfect = F.lit(early) & (score >= settings.perfect_match_threshold)
    order = F.struct(perfect.alias("p"), F.when(perfect, F.lit(0.0)).otherwise(score).alias("s"), (-F.col("idx2")).alias("i"))
    best = whole.where(score > 0).groupBy("idx1").agg(F.max_by(F.struct("idx2", *names, "overall_score"), order).alias("x"))
    return best.select("idx1", "x.idx2", *[f"x.{n}" for n in names], "x.overall_score")


def match(left: DataFrame, right: DataFrame, columns: Sequence[Mapping] | None = None, settings: Settings | Mapping | None = None, left_key: str | None = None, right_key: str | None = None) -> DataFrame:
    """Matches with the columns of both rows, the scores, the label and both indices.

    ``columns`` lists mappings of source1, source2 and weight; without it columns
    of equal names are compared.  Indices are row positions, or the given keys.
    Nulls and blanks score 0 and keep their weight; empty tables give no rows.
    """
    settings = settings if isinstance(settings, Settings) else Settings.of(settings)
    left, right = prepare(left, left_key), prepare(right, right_key)
    specs = analyze_columns(left, right, columns)
    if not specs:
        raise ValueError("no columns to compare")
    found = match_pairs(left, right, specs, settings)
    side = lambda df, p: df.select(*[F.col(f"`{c}`").alias(f"{p}_{c}") for c in df.columns if c != "__idx"], F.col("__idx").alias(f"{p}_index"))
    one, two = side(left, "source1"), side(right, "source2")
    joined = found.join(one, found["idx1"] == one["source1_index"]).join(two, found["idx2"] == two["source2_index"])
    return joined.select(
        *[c for c in one.columns if c != "source1_index"], *[c for c in two.columns if c != "source2_index"],
        *score_names(specs), "overall_score", classify(F.col("overall_score"), settings).alias("match_result"), "source1_index", "source2_index",
    )


def label_histogram(matches: DataFrame) -> DataFrame:
    """(match_result, n)."""
    return matches.groupBy("match_result").agg(F.count(F.lit(1)).alias("n"))
