"""Books that are done again or taken away: their tasks, catalogue rows, jobs and stored indexes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import ids
from corpusloom.plans import ingest
from corpusloom.plans.models import Models
from corpusloom.sources.index_store import IndexStore
from corpusloom.sources.store import stored


@dataclass(frozen=True)
class Changed:
    """The catalogue and the jobs as they are then, and (task_id) of the tasks to stop."""

    books: DataFrame
    jobs: DataFrame
    revoked: DataFrame


def _found(books: DataFrame, asked: DataFrame, tenant: object) -> DataFrame:
    """(book) of the books that are asked for and belong to the tenant, each once; other requests find nothing."""
    return books.where(F.col("tenant") == F.lit(tenant)).select("book").join(asked.select("book").distinct(), "book", "left_semi")


def _stopped(jobs: DataFrame, found: DataFrame) -> DataFrame:
    return jobs.where("task_id IS NOT NULL").join(found, "book", "left_semi").select("task_id").distinct()


def reprocessed(books: DataFrame, jobs: DataFrame, asked: DataFrame, tenant: object, run: str) -> Changed:
    """The books of a tenant that are asked for (book) go back to the start.

    ``books`` has book, tenant, status, total_chunks and total_pages; ``jobs`` has job, book, tenant, status and task_id. A
    book is pending, without pages and chunks; its jobs go and one that is queued comes, whose id follows from the
    book and from ``run``, so that the same request made twice gives the same job. Other columns of a new job are null.
    """
    found = _found(books, asked, tenant)
    mark = found.withColumn("_again", F.lit(True))
    again = books.join(mark, "book", "left").withColumn("_again", F.coalesce("_again", F.lit(False)))
    for name, value in (("status", F.lit("pending")), ("total_chunks", F.lit(0)), ("total_pages", F.lit(None))):
        kind = books.schema[name].dataType
        again = again.withColumn(name, F.when(F.col("_again"), value.cast(kind)).otherwise(F.col(name)))
    new = found.select(ids.uuid5(F.concat_ws("|", F.lit("job"), F.col("book").cast("string"), F.lit(run))).alias("job"), "book", F.lit(tenant).cast(jobs.schema["tenant"].dataType).alias("tenant"), F.lit("queued").alias("status"))
    left = jobs.join(found, "book", "left_anti").select(*jobs.columns)
    return Changed(again.select(*books.columns), left.unionByName(new, allowMissingColumns=True), _stopped(jobs, found))


def removed(books: DataFrame, jobs: DataFrame, asked: DataFrame, tenant: object) -> Changed:
    """The books of a tenant that are asked for, and their jobs, are gone."""
    found = _found(books, asked, tenant)
    return Changed(books.join(found, "book", "left_anti").select(*books.columns), jobs.join(found, "book", "left_anti").select(*jobs.columns), _stopped(jobs, found))


@contextmanager
def as_task(spark: SparkSession, task_id: str) -> Iterator[None]:
    """The jobs that this thread starts on Spark inside are the work of a task, and are stopped with it."""
    spark.sparkContext.addJobTag(f"task-{task_id}")
    spark.sparkContext.setInterruptOnCancel(True)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(f"task-{task_id}")


def revoke(spark: SparkSession, tasks: Iterable[str]) -> None:
    """Stops the jobs that run for some tasks, such as ``Changed.revoked`` read row by row; a task without any is left alone."""
    for task in tasks:
        spark.sparkContext.cancelJobsWithTag(f"task-{task}")


@dataclass(frozen=True)
class Indexes:
    """Stored passages, vectors and postings, all with doc_id as their key."""

    passages: IndexStore
    vectors: IndexStore
    postings: IndexStore

    @classmethod
    def at(cls, spark: SparkSession, path: str, buckets: int) -> Indexes:
        return cls(*(IndexStore(spark, f"{path}/{name}", "doc_id", sort, buckets) for name, sort in (("passages", ("doc_id", "chunk_no")), ("vectors", ()), ("postings", ("term",)))))


def reingested(indexes: Indexes, page_texts: DataFrame, asked: DataFrame, models: Models | None = None, cut: Callable[[DataFrame], DataFrame] = ingest.passages) -> DataFrame:
    """Puts passages made anew in place of all that was stored of the documents in ``asked`` (doc_id); gives (doc_id, total_pages, total_chunks).

    Only the pages of these documents are worked on, and only the buckets they lie in are written. A document without pages
    is left without passages. Each index changes in one step, passages last; after a failure the same call again leads to the same end.
    """
    wanted = stored(asked.select("doc_id").distinct())
    pages = page_texts.join(wanted, "doc_id", "left_semi")
    own = stored(cut(pages))
    vectors, postings = ingest.indexes(own, models, "doc_id")
    indexes.vectors.replace(vectors, wanted)
    indexes.postings.replace(postings, wanted)
    indexes.passages.replace(own, wanted)
    n_pages = pages.groupBy("doc_id").agg(F.countDistinct("page").alias("total_pages"))
    n_chunks = own.groupBy("doc_id").agg(F.count("*").alias("total_chunks"))
    return wanted.join(n_pages, "doc_id", "left").join(n_chunks, "doc_id", "left").na.fill(0)
