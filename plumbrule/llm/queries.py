"""Registered queries: each operator with its production settings on its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbrule.llm import chat_format, decontaminate, html_extract, licenses, mixing, ngram_join, quality, secrets, spelling, substring_dedup, token_counts, vector_dedup, whitening
from plumbrule.plans.registered import Registry
from plumbrule.plans.registered.data import table

registry = Registry()


@registry.add("op1_compression_quality")
def compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality_scores(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@registry.add("op2_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


@registry.add("op4_token_counts")
def count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@registry.add("op7_suffix_decontamination")
def suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), longest=True)


@registry.add("op10_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


@registry.add("op8_embedding_near_dedup")
def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.vector_components(table(spark, sf_dir, "embeddings"))


@registry.add("op9_html_main_text")
def html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


@registry.add("op5_chat_windows")
def chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    turns = table(spark, sf_dir, "conversations").select(own.columns).unionByName(own)
    return chat_format.read_back(chat_format.format_windows(turns))


@registry.add("op3_raked_mixture", mixing.oracle())
def raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("_margin_topic").alias("topic"), F.col("_tokens").alias("n_tokens"),
        F.round("_share", 6).alias("share"), F.col("_kept").alias("kept"))


@registry.add("op6_license_scan", licenses.oracle())
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"), licenses.known(spark, licenses.TEXTS))


@registry.add("op11_spelling_variants")
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@registry.add("op12_embedding_whitening")
def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


@registry.add("op13_substring_dedup", substring_dedup.ORACLE_SQL)
def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents")).select(
        F.col("_id").alias("doc_id"), F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"),
        F.sha2("_kept", 256).alias("kept_sha256"))
