"""lodestone: record linkage and deduplication as lazy Spark plans."""

from lodestone.functions.similarity import (
    batch_similarity,
    date_similarity,
    jaro_winkler_similarity,
    levenshtein_similarity,
    numeric_similarity,
    register,
    token_set_ratio,
    token_sort_ratio,
)
from lodestone.operators.clustering import cluster
from lodestone.operators.evaluate import evaluate
from lodestone.operators.matching import match
from lodestone.operators.search import search
from lodestone.plans.config import check_config, validate_config
from lodestone.plans.runner import run
from lodestone.plans.specs import PairSpec, Settings
from lodestone.sources.loaders import load_source
from lodestone.sources.sinks import write_cluster_results, write_cluster_summary, write_results

__all__ = [
    "PairSpec", "Settings", "batch_similarity", "check_config", "cluster", "date_similarity", "evaluate",
    "jaro_winkler_similarity", "levenshtein_similarity", "load_source", "match", "numeric_similarity", "register",
    "run", "search", "token_set_ratio", "token_sort_ratio", "validate_config", "write_cluster_results",
    "write_cluster_summary", "write_results",
]
