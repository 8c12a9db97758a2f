"""From raw documents to packed sequences: each stage calls one operator and hands what it keeps to the next.

A stage's result is written before the next stage starts, so the next one first removes what the one before has staged.

Cases, in every stage: a null or empty text fails the quality rules; null languages and sources form groups of their own;
very long texts are read whole; repeated rows are near duplicates, of which one stays; columns beyond those of `documents`,
whatever their names, are kept up to the mix; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revtrack.llm import jaccard, langid, mixing, packing, quality
from revtrack.llm.common import configure_batches
from revtrack.session import remove, stage_at, step

# What the latest stage has staged.
_PAST: list[str] = []


def _stage(fn: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with step(configure_batches(spark), _PAST):
            return fn(spark, docs, sf_dir)

    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return quality.keep(docs)


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: neither undetermined nor ambiguous. Columns stay as they are."""
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    told = docs.select(F.struct(*docs.columns).alias("_row"), langid.identify(model, F.col("text")).alias("_told"))
    return told.where((F.col("_told.lang_pred") != langid.UNDETERMINED) & ~F.col("_told.ambiguous")).select("_row.*")


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity of 0.75 or more."""
    return jaccard.representatives(docs)


@_stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights: documents repeated for whole epochs, each source's last one cut at its budget."""
    return mixing.mixed_documents(docs)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("packing", packed),
]

# Estimates, models and the tokenizer are beyond SQL; tests hold some stages against expected ids, see the README.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, fn in STAGES[:-1]:
        docs, path = stage_at(fn(spark, docs, sf_dir))
        remove(spark, before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
