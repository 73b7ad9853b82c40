"""python -m lodestone.cli CONFIG [--query JSON] [--max-results N] [--check]"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from lodestone.operators.matching import label_histogram
from lodestone.plans.config import validate_config
from lodestone.plans.runner import run


#: Found rows that are printed; all of them are written.
SHOWN = 10


def shown(found: DataFrame) -> str:
    """The first rows of a search, each with its score, its label and the master's columns that hold something."""
    lines = []
    for n, row in enumerate(found.limit(SHOWN).collect(), 1):
        lines.append(f"{n}. {row['overall_score']:.3f} {row['match_result']}")
        lines += [f"   {c.removeprefix('master_')}: {row[c]}" for c in found.columns if c.startswith("master_") and c != "master_index" and row[c] not in (None, "")]
    return "\n".join(lines) or "No row reaches the threshold."


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Record linkage and deduplication on Spark.")
    p.add_argument("config", help="JSON configuration")
    p.add_argument("--env-file", help="file of NAME=value lines")
    p.add_argument("--query", help="JSON record for search mode")
    p.add_argument("--max-results", type=int, default=10)
    p.add_argument("--check", action="store_true", help="only check the configuration")
    a = p.parse_args(args)
    config = validate_config(a.config, a.env_file)
    if a.check:
        print("The configuration is valid.")
        return 0
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    out = run(spark, config, json.loads(a.query) if a.query else None, max_results=a.max_results)
    if config.get("mode") == "search":
        print(shown(out))
    elif "match_result" in out.columns:
        label_histogram(out).show()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
