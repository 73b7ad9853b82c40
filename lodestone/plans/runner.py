"""A checked configuration as one plan, from sources to sink."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lodestone.operators.clustering import cluster
from lodestone.operators.matching import match
from lodestone.operators.search import search
from lodestone.plans.config import check_config
from lodestone.plans.specs import Settings
from lodestone.sources.loaders import load_source
from lodestone.sources.sinks import write_cluster_summary, write_results


def run(spark: SparkSession, config: Mapping[str, Any], record: Mapping | None = None, write: bool = True, max_results: int = 10, check_files: bool = True) -> DataFrame:
    """Run a configuration; its result is returned, and written unless ``write`` is false.

    ``check_files`` looks for the sources on this machine first; on a cluster they may lie elsewhere.
    """
    config = check_config(config, check_files)
    mode = config.get("mode", "matching")
    credentials, s3 = config.get("mysql_credentials"), config.get("s3_credentials")

    def source(name: str) -> DataFrame:
        return load_source(spark, config[name], credentials, s3, multi_line=bool(config.get("multi_line_csv")))

    if mode == "clustering":
        section = config.get("clustering", {})
        out = cluster(source("source1"), section.get("columns"), Settings.of(section))
    elif mode == "search":
        if not record:
            raise ValueError("search mode needs a query record")
        section = config.get("matching", {})
        out = search(record, source("source2"), section.get("columns"), Settings.of(section), max_results)
    else:
        section = config.get("matching", {})
        out = match(source("source1"), source("source2"), section.get("columns"), Settings.of(section))
    if write:
        write_results(out, config["output"], credentials, s3)
        if mode == "clustering" and config.get("summary_output"):
            write_cluster_summary(out, config["summary_output"])
    return out
