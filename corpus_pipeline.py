"""The corpus pipeline: classify, deduplicate, decontaminate, scan for secrets, mix.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it
kept, and returns a DataFrame; :func:`run` applies them to ``documents`` and writes what
a stage keeps to the checkpoint folder before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbrule.functions.storage import cut_lineage
from plumbrule.llm import decontaminate, mixing, ngram_join, quality, secrets
from plumbrule.plans.registered.data import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs.select(*COLUMNS), model)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return ngram_join.one_per_component(docs.select(*COLUMNS))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold benchmark passages."""
    return decontaminate.without_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind."""
    return secrets.without_secrets(docs.select(*COLUMNS), count_col="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample that follows the target weights, with each document's token count and sampling share."""
    return mixing.mixture(docs.select(*COLUMNS)).where("_kept").select(
        *COLUMNS, F.col("_tokens").alias("n_tokens"), F.round("_share", 6).alias("share"))


STAGES = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", deduplicate),
    ("benchmark decontamination", remove_benchmark),
    ("secret scans", remove_secrets),
    ("mixing", mix),
]

#: The classifier's scores cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, cut_lineage(docs) if number else docs, sf_dir)
    return docs
