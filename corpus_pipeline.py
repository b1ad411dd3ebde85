"""A training-data pipeline over ``documents``: five stages, each written and read again.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame. All but the last keep the columns of ``documents``; the last returns the tokens'
digests of every document that stayed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import queries
from corpusloom.llm.bpe import encode_digests
from corpusloom.llm.common import delete, shared_folder
from corpusloom.llm.decontaminate import drop_leaks
from corpusloom.llm.exact_dedup import drop_copies
from corpusloom.llm.language_id import keep_known
from corpusloom.llm.near_dedup import drop_near_copies


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language."""
    return keep_known(docs)


def deduplicate_exactly(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set that differs in white space at most."""
    return drop_copies(docs)


def deduplicate_nearly(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return drop_leaks(docs, queries.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers and digests of the tokens."""
    return encode_digests(docs, queries.tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", deduplicate_exactly),
    ("near_dedup", deduplicate_nearly),
    ("decontamination", decontaminate),
    ("bpe", encode),
]

#: Trained models and alignment have no SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what is between them goes through the shared folder.

    What a stage wrote is deleted once the next has written; the last of them is read by the result.
    """
    docs = queries.table(spark, sf_dir, "documents")
    folder, read = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if read:
            delete(spark, read)
        read = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
