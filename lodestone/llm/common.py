"""What the operators of this subpackage share."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a Java and Python pattern.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark only."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null or blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def tokenizer_path() -> str:
    """Where the public byte-level BPE vocabulary lies: the environment's
    TOKENIZER_PATH, or the installed ``public_tokenizers`` package."""
    if os.environ.get("TOKENIZER_PATH"):
        return os.environ["TOKENIZER_PATH"]
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def fresh(name: str, taken: list[str]) -> str:
    """A column name that is not taken."""
    name = f"__{name}"
    while name in taken:
        name += "_"
    return name
