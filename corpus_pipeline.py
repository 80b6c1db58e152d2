"""A training corpus from raw documents: five stages, each one operator of ``heldout.llm``.

Every stage takes the documents that its predecessor kept and returns the rows
it keeps with the columns of ``documents``; the last returns the packed pieces.
Between stages the rows are written as Parquet below the shared checkpoint
folder and read again, so a lost executor repeats a part of one stage at most.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from heldout.functions.materialize import checkpoint_root
from heldout.llm import decontaminate, near_dedup, packing, quality_model, quality_rules
from heldout.llm.queries import table, vocabulary_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3; the labels of the given folder teach the trees."""
    return quality_model.accepted(docs, table(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and every rule of the cascade."""
    return quality_rules.accepted(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates."""
    return near_dedup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item to three quarters of its shingles."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents, packed into sequences of 4096 tokens."""
    return packing.pack(docs, vocabulary_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("minhash_near_dedup", dedup),
    ("benchmark_decontamination", decontamination),
    ("packing", pack),
]

#: Trained models and the tokenizer are beyond SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of the folder.

    A null or empty text fails the base of the rules; an empty table gives no
    row at any stage; repeated rows of one document end as one.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = f"{checkpoint_root(spark)}/pipeline/{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
