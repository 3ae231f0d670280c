"""Corpus pipeline: language identification, quality rules, near-duplicate removal, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return documents with their columns; a
stage's result is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrichor.llm import language_id, near_dedup, packing, quality_rules
from petrichor.llm.queries import remainder
from petrichor.session import ensure_checkpoint_dir


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: without a letter, or coded no better than by uniform bytes in each language, they go.

    With nothing to learn from, only documents without a letter go.
    """
    model = language_id.train(docs.select("doc_id", "text", "lang").filter(remainder("doc_id", 4) != 2))
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return language_id.flagged(docs, model).filter("_lang_pred <> 'und'").select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the cascade, the base rules in it."""
    return quality_rules.filtered(docs).filter("_failed IS NULL").select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words a shingle, similarity 0.8."""
    return near_dedup.deduplicated(docs, width=5, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in sequences of at most 2048 tokens."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_stage), ("quality_rules", quality_stage), ("near_dedup", dedup_stage), ("packing", packing_stage)]

#: Trained models and tokenizers are beyond SQL; tests compare the stages with plain versions of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; stage results are tables in the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
