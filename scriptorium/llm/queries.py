"""The operators applied to their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chat, decontaminate, fim, licenses, metric_search, ngram_join, packing, quality, rules, secrets, shards, toxicity
from .common import read, scratch


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.size_tiered_compaction(read(spark, sf_dir, "documents"), scratch(spark, "store"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_search.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_formatting(read(spark, sf_dir, "conversations"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(read(spark, sf_dir, "documents"), special_ids=True)


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(read(spark, sf_dir, "documents"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(read(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.cross_tokenizer_alignment(read(spark, sf_dir, "documents"), digest=True)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.fill_in_middle(read(spark, sf_dir, "documents")))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sharding,
        op2_exact_topk,
        op3_toxicity,
        op4_chat_formatting,
        op5_best_fit_packing,
        op6_license_scans,
        op7_benchmark_decontamination,
        op8_ngram_jaccard_join,
        op9_secret_scans,
        op10_quality_classifier,
        op11_cross_tokenizer_alignment,
        op12_fill_in_middle,
        op13_quality_rules,
    )
}
ORACLES: dict[str, str] = {
    "op2_exact_topk": metric_search.ORACLE,
    "op4_chat_formatting": chat.ORACLE,
    "op6_license_scans": licenses.ORACLE,
    "op8_ngram_jaccard_join": ngram_join.ORACLE,
    "op9_secret_scans": secrets.ORACLE,
    "op12_fill_in_middle": fim.ORACLE,
}
