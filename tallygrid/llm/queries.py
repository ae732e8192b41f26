"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallygrid.llm import (
    chat_format, divergence_audit, language_id, ngram_join, order_minhash, packing, piece_encoding, quality_classifier,
    quality_rules, simhash_index, token_counts, treap_search, warc,
)
from tallygrid.llm.common import vocabulary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_quality_rules", quality_rules.ORACLE)
def op1(spark, sf):
    return quality_rules.quality_rules(table(spark, sf, "documents"))


@query("op2_quality_classifier")
def op2(spark, sf):
    return quality_classifier.quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op3_order_minhash")
def op3(spark, sf):
    return order_minhash.edit_likeness(table(spark, sf, "documents"))


@query("op4_chat_format")
def op4(spark, sf):
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat_format.read_back(chat_format.formatted(rows, vocabulary("byte_bpe_50k.json")))


@query("op5_ngram_join")
def op5(spark, sf):
    return ngram_join.near_duplicates(table(spark, sf, "documents"))


@query("op6_warc", warc.ORACLE)
def op6(spark, sf):
    return warc.archived_pages(table(spark, sf, "pages"))


@query("op7_token_counts")
def op7(spark, sf):
    return token_counts.token_counts(table(spark, sf, "documents"), vocabulary("piece_bpe_32k.model"))


@query("op8_best_fit_packing")
def op8(spark, sf):
    return packing.pack(table(spark, sf, "documents"))


@query("op9_sentencepiece")
def op9(spark, sf):
    return piece_encoding.digests(table(spark, sf, "documents"), vocabulary("piece_bpe_32k.model"))


@query("op10_language_id")
def op10(spark, sf):
    return language_id.languages(table(spark, sf, "documents"))


@query("op11_simhash_index")
def op11(spark, sf):
    return simhash_index.near_duplicates(table(spark, sf, "documents"))


@query("op12_treap_search", treap_search.ORACLE)
def op12(spark, sf):
    return treap_search.ranked(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op13_divergence_audit", divergence_audit.ORACLE)
def op13(spark, sf):
    return divergence_audit.audit(table(spark, sf, "documents"))
