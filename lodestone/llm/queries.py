"""The registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import chat, exact_dedup, langid, mixing, packing, quality, secrets, simhash, topk, toxicity
from lodestone.llm.common import fold, table, tokenizer_path
from lodestone.llm.oracles import ORACLES

#: Folds held out by the queries: (folds, the one held out).
TOXIC_FOLD, LANGUAGE_FOLD = (5, 0), (4, 2)


def _held_out(which: tuple[int, int], doc_id: str = "doc_id"):
    return F.coalesce(fold(F.col(doc_id), which[0]) == which[1], F.lit(True))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality.judge(docs, labels.where("quality = 1").select("doc_id"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("log_ratio", 6).alias("log_ratio"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_lexed")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), use=~_held_out(TOXIC_FOLD))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", _held_out(TOXIC_FOLD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = langid.collect_samples(docs, use=~_held_out(LANGUAGE_FOLD))
    return langid.identify(docs, samples).select("doc_id", _held_out(LANGUAGE_FOLD).alias("held_out"), "lang_pred", "score")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_preferences(chat.swapped_replies(table(spark, sf_dir, "conversations")))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rates = mixing.document_rates(docs, docs.select("text", F.col("lang").alias("domain")), mixing.TARGETS)
    return rates.select("doc_id", "n_tokens", "rate", mixing.copies(F.col("rate"), F.col("doc_id")).alias("copies"), *[f"p_{d}" for d in mixing.TARGETS])


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_secret_scans, op3_toxicity, op4_language_id, op5_chat_formatting,
        op6_exact_topk, op7_simhash_dedup, op8_suffix_dedup, op9_mixing, op10_packing,
    )
}

__all__ = ["ORACLES", "QUERIES"]
