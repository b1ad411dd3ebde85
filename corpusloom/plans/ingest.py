"""From page texts to searchable passages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import pages, retrieval, segment
from corpusloom.plans.models import Models
from corpusloom.sources.store import stored


def numbered(page_texts: DataFrame) -> DataFrame:
    """(doc_id, page, text, printed, imputed): pages with their printed numbers, found or filled in."""
    found = page_texts.select("doc_id", F.col("page").alias("physical"), "text", pages.footer_number(F.col("text")).alias("printed"))
    filled = pages.impute(found)
    return filled.select("doc_id", F.col("physical").alias("page"), "text", "printed", "imputed")


def passages(page_texts: DataFrame, every_line: bool = False) -> DataFrame:
    """Passages of documents given as (doc_id, page, text)."""
    # Found once and stored without the text: filling in reads them twice.
    found = stored(page_texts.select("doc_id", F.col("page").alias("physical"), pages.footer_number(F.col("text")).alias("printed")))
    return segment.text_chunks(page_texts, every_line, numbers=pages.impute(found).select("doc_id", F.col("physical").alias("page"), "printed"))


def vectors(own: DataFrame, models: Models | None = None, *scopes: str) -> DataFrame:
    """The vectors of ``indexes`` alone."""
    return stored(own.select("id", *scopes, (models or Models()).embed(F.col("text")).alias("vector")))


def indexes(own: DataFrame, models: Models | None = None, *scopes: str) -> tuple[DataFrame, DataFrame]:
    """(vectors, postings) of passages, with scopes such as the tenant, as stored tables; ``own`` should be stored."""
    return vectors(own, models, *scopes), stored(retrieval.postings(own, *scopes), "term")
