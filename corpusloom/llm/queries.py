"""The operators of this package bound to the driver's tables, with production parameters."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import fill_in_middle, license_scan


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The vocabulary of the token queries, from the installed package of public tokenizers."""
    return importlib.import_module("public_tokenizers").path("word_bpe_49k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages; a row has a doc_id or a page_id."""
    from corpusloom.llm.language_id import identify

    found = identify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))
    return found.select(F.when(F.col("kind") == "document", F.col("id")).alias("doc_id"), F.when(F.col("kind") == "page", F.col("id")).alias("page_id"), "language", F.round("posterior", 6).alias("posterior"), "text_language", "kept")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.license_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST) AS kept,
       sha256(t) AS text_sha256
FROM d
"""


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.suffix_dedup import repeated_spans

    return repeated_spans(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.bpe import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"), n_shards=24)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import quality

    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.hmm import language_model_scores

    return language_model_scores(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents")))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.conversation_repair import audit, damage

    return audit(damage(table(spark, sf_dir, "conversations")))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm import secrets

    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_license_scan": op2_license_scan,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_near_dedup": op4_near_dedup,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_bpe": op6_bpe,
    "op7_sharding": op7_sharding,
    "op8_decontamination": op8_decontamination,
    "op9_quality": op9_quality,
    "op10_language_model": op10_language_model,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_secret_scan": op13_secret_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": license_scan.duckdb_sql(),
    "op3_exact_dedup": OP3_SQL,
    "op11_fill_in_middle": fill_in_middle.duckdb_sql(),
}
