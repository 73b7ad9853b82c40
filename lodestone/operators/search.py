"""Search of one record in a master table: scored, sorted, the best ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.similarity import similarity
from lodestone.functions.text import clean, normalize
from lodestone.operators.blocking import blocking_keys
from lodestone.operators.matching import prepare
from lodestone.operators.scoring import classify, score_names, weighted_mean
from lodestone.plans.profile import column_types
from lodestone.plans.specs import PairSpec, Settings, map_query


def search(record: Mapping, master: DataFrame, columns: Sequence[Mapping] | None = None, settings: Settings | Mapping | None = None, max_results: int = 10, key: str | None = None, threshold: float | None = None) -> DataFrame:
    """The rows of ``master`` that score at least ``threshold`` less the undecided range.

    ``threshold`` is that of the settings unless given; labels always follow the settings.
    The record is folded into the plan as constants, so the master is read once
    without a join.  Types are those of the master's columns; mappings of columns
    that it lacks are left out.  Without a row in any of the record's blocks all
    rows are scored if there are at most ``fallback_rows``.  Sorted by falling
    score, then index; ``max_results`` of 0 or less gives all.
    """
    settings = settings if isinstance(settings, Settings) else Settings.of(settings)
    master = prepare(master, key)
    chosen = [m for m in (columns or map_query(record, master)) if m["source2"] in master.columns and m["source1"] in record]
    if not chosen:
        raise ValueError("no column of the master fits the query record")
    types = column_types(master, [m["source2"] for m in chosen])
    specs = [PairSpec(m["source1"], m["source2"], types[m["source2"]], types[m["source2"]], float(m.get("weight", 1.0)), m.get("algorithm", "")) for m in chosen]

    def asked(s: PairSpec):
        value = record[s.left]
        return clean(F.lit(None if value is None else str(value)))

    rows = master
    if settings.use_blocking:
        strategies = settings.blocking_strategies
        meets = F.lit(False)
        for s in specs:
            own = blocking_keys(F.coalesce(F.col(f"`{s.right}`").cast("string"), F.lit("")), strategies)
            meets = meets | F.coalesce(F.arrays_overlap(own, blocking_keys(asked(s), strategies)), F.lit(False))
        rows = master.where(meets)
        if rows.limit(1).count() == 0:
            few = master.limit(settings.match_fallback() + 1)
            rows = master if few.count() <= settings.match_fallback() else master.limit(0)
    names = score_names(specs)
    scores = [similarity(s.how, normalize(s.type, asked(s)), normalize(s.type, F.col(f"`{s.right}`"))) for s in specs]
    scored = rows.withColumns(dict(zip(names, scores, strict=True))).withColumn("overall_score", weighted_mean([F.col(n) for n in names], specs))
    low = settings.bounds()[0] if threshold is None else threshold - settings.undecided_range
    out = scored.where(F.col("overall_score") >= low).select(
        "overall_score", classify(F.col("overall_score"), settings).alias("match_result"), F.col("__idx").alias("master_index"),
        *[F.col(f"`{c}`").alias(f"master_{c}") for c in master.columns if c != "__idx"], *names,
        *[F.lit(v).alias(f"query_{k}") for k, v in record.items()],
    )
    ordered = out.orderBy(F.col("overall_score").desc(), "master_index")
    return ordered.limit(max_results) if max_results > 0 else ordered
