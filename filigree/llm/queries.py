"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from filigree.llm import ann, fingerprint, langid, lm, mixing, packing, pii, quality, search, sharding, simhash, toxicity, turns, turns_sql
from filigree.session import load_table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(load_table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(load_table(spark, sf_dir, "documents"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_pairs(load_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(load_table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(load_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "labels"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(load_table(spark, sf_dir, "embeddings"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(load_table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked_search(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "benchmark"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(load_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(load_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_simhash, op2_packing, op3_sharding, op4_fingerprint, op5_mixing, op6_language, op7_toxicity, op8_quality, op9_neighbours, op10_language_model, op11_lexical_search, op12_personal_data, op13_conversation_repair)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    """Two can be written in SQL; tests/llm holds the others against brute-force versions."""
    return {"op11_lexical_search": search.SQL, "op13_conversation_repair": turns_sql.SQL}
