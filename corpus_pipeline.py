"""From raw documents to packed training sequences, one written table per stage.

Every stage works on all that its predecessor kept and is judged on its own input. Defined results:
a null or empty text has no recognised language and goes at the second stage; texts of any length
are read, compared and packed whole; null and repeated ids are rows like any others, of which near
copies keep one per group; further columns pass through all stages but the last, whatever their
names; an empty table gives an empty result; without labels the first stage rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallygrid.llm import language_id, ngram_join, packing, quality_classifier
from tallygrid.llm.common import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on these documents and their labels, does not reject."""
    return quality_classifier.reject_poor(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language that agrees with their own label."""
    return language_id.reject_unknown(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies."""
    return ngram_join.one_of_each_group(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token pieces and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality),
    ("language_id", language),
    ("ngram_join", near_duplicates),
    ("best_fit_packing", pack),
]

#: SQL states neither the trees, the tokenizer nor the packing; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
