"""Registered queries of the training-data operators: whole tables, production
parameters. Keys without SQL are tested in tests/llm against brute force, exact
round trips or held-out accuracy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from starlayer.llm import (chat, convrepair, exactdup, fim, jaccard, langid, mixing, packing, quality, sharding, tokenbin, toxicity,
                           vecdedup)
from starlayer.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op1(spark, table(spark, sf_dir, "documents"))


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op2(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op3(table(spark, sf_dir, "conversations"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdedup.op5(table(spark, sf_dir, "embeddings"))


def op6_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op6(table(spark, sf_dir, "documents"))


def op7_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op7(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op8(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.op9(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.op10(table(spark, sf_dir, "documents"))


def op11_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.op11(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.op12(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convrepair.op13(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_line_quality, op3_chat_format, op4_source_mix, op5_near_vectors, op6_best_fit_pack,
                             op7_hash_tree_shards, op8_toxicity, op9_token_orc, op10_jaccard_join, op11_content_sort, op12_fill_in_middle,
                             op13_conversation_repair)
}

ORACLE_SQL: dict[str, str] = {"op11_content_sort": exactdup.OP11_SQL, "op12_fill_in_middle": fim.OP12_SQL,
                             "op13_conversation_repair": convrepair.OP13_SQL}
