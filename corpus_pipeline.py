"""A corpus pipeline over ``documents``: quality rules, language, exact and near duplicates, packing.

Each stage takes the table that the one before it left, judges every row of it, and is written as Parquet before the next
reads it. A stage decides on its own input alone: thresholds, models and groups are computed anew from it. All stages but
the last keep or drop rows and leave every column as it is, whatever its name.

Defined cases, by stage. Quality: null, empty and short texts go; a null lang is a stratum of its own; repeated or contradicting
labels count once or not at all. Language: texts without a letter go, and those whose language can't be told (all, where no row
has a lang). Exact dedup: of equal texts the longest original, then the least doc_id stays (null after all others), of repeated rows one.
Near dedup: rows are told apart by doc_id and text; of rows repeated in both one stays; texts without words and rows without a doc_id
stay. Packing: null text is the end id alone, repeated rows are packed each. Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from treeledger.llm import exactdup, langid, neardup, packing, quality
from treeledger.llm.storage import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep(docs, langid.trained(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exactdup.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("language ID", language), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("best-fit packing", best_fit_packing)]

#: Trained models, tokenizers and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
