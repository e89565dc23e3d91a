"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``docs`` as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starlayer.llm import jaccard, langid, mixing, packing, toxicity
from starlayer.llm.common import Store, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a determined language; texts without letters go."""
    return langid.keep_identified(docs, langid.fit(table(spark, sf_dir, "documents")))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose calibrated probability of label 1 is below 0.5."""
    return toxicity.keep_clean(docs, toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.8)."""
    return jaccard.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the sources' target weights take it."""
    return mixing.emit(docs)


def best_fit_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents with their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("toxicity", toxicity_filter), ("ngram_jaccard_join", near_duplicates),
          ("source_mix", source_mix), ("best_fit_pack", best_fit_pack)]

#: the learned stages can't be expressed in SQL; tests/llm compares with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with Store(spark) as store:
        for name, stage in STAGES[:-1]:
            docs = store.put(stage(spark, docs, sf_dir), name)
        return STAGES[-1][1](spark, docs, sf_dir)
