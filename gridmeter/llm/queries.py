"""The operators' queries over whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, filter_audit, line_dedup, mixing, ngram_join, sharding, site_style, stable_projection, substring_dedup, time_partitions, token_counts, token_files, toxicity
from .storage import shared_folder


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated(_read(spark, sf_dir, "documents"), width=20, digest=True)


def op1_site_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style.extract(_read(spark, sf_dir, "pages"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(_read(spark, sf_dir, "documents"), k=3, percent=90)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the committed version after arrival and compaction; the hash is of the text read back."""
    store = sharding.shard(_read(spark, sf_dir, "documents"), shared_folder(spark))
    return store.read().select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(_read(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("distance")


def op4_stable_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stable_projection.search(_read(spark, sf_dir, "embeddings"), every=50, k=5)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_read(spark, sf_dir, "documents")).drop("source")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interactions(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_time_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_partitions.rewritten_clicks(_read(spark, sf_dir, "clicks"), cutoff="2024-05-01 00:00:00")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_site_style": op1_site_style,
    "op2_ngram_join": op2_ngram_join,
    "op3_sharding": op3_sharding,
    "op7_line_dedup": op7_line_dedup,
    "op8_decontamination": op8_decontamination,
    "op4_stable_projection": op4_stable_projection,
    "op5_source_mixing": op5_source_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_token_files": op10_token_files,
    "op6_substring_dedup": op6_substring_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_time_partitions": op12_time_partitions,
    "op13_token_counts": op13_token_counts,
}
