"""The corpus pipeline: stages over ``documents``, each reading what the one before has written.

Null texts count as empty and null sources as one source. Rows with null or repeated ids are judged as the stages' operators say: rows that share an id
are one document to near duplicates and decontamination, and stay or go together; repeated rows are near duplicates of
each other. Nulls in other columns and columns beyond those of ``documents`` are passed on. Documents without words have no size and get no copy in
the last stage. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tillage.llm import chosenpath, decontaminate, mixing, secrets, toxicity
from tillage.plans.lineage import work_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. The model is fitted on labelled documents of the stage's input."""
    return toxicity.reject(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return chosenpath.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mask; all documents stay."""
    found = secrets.find(docs, carry=tuple(docs.columns))
    return secrets.mask_secrets(found, secrets.learn(docs, found))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with all its columns as often as its source's target weight asks for, numbered in ``copy``; documents with no copy go."""
    return mixing.repeat(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", keep_one_of_each),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
]

# Similarity joins, fitted models and Newton steps are beyond SQL; tests/llm checks the stages one by one and the whole on odd tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order. Every result but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{work_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        path = f"{folder}/{number}-{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
