"""From documents to packed sequences: five stages, each of one of the training-data operators.

Every stage takes the documents that its predecessor kept and returns documents, but for
the last, which returns the packed pieces. ``run`` writes each stage's result as Parquet in
the shared folder and hands it to the next.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import bin_packing, common, language_codes, pii_offsets, quality_subword, shingle_join
from corpusflow.llm.queries import CAPACITY, END_ID, fold


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality_subword.learn(docs, common.table(spark, sf_dir, "labels"), fold(3) != 1)
    return quality_subword.keep(docs, model)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go."""
    return language_codes.keep(docs, language_codes.learn(docs, fold(4) != 2))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return shingle_join.keep(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets."""
    return common.change_texts(docs, pii_offsets.redact).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, each with its sequence and place."""
    parts = bin_packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), CAPACITY, END_ID)
    return bin_packing.pack(common.materialize(parts, "pipeline-pieces"), CAPACITY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("pii", pii),
    ("packing", packing),
]

#: The stages learn from samples and search, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
