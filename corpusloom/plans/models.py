"""Model calls as replaceable column functions, with offline defaults.

A deployment passes its own; each takes and returns columns, so that a Pandas UDF with
batching, bounded concurrency and retries fits. The defaults need no network.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

DIMENSIONS = 64


def hashed_vector(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Term frequencies of a text hashed into a vector; a batch of texts is counted at once, as a model would take it."""

    @F.pandas_udf("array<double>")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for places in batches:
            rows = []
            for own in places:
                row = np.bincount(np.asarray(own, dtype=np.int64), minlength=dimensions).astype(float)
                row[0] += 1e-6
                rows.append(row)
            yield pd.Series(rows, dtype=object)

    return counted(F.transform(T.tokens(F.coalesce(text, F.lit(""))), lambda t: F.pmod(F.xxhash64(t), F.lit(dimensions))))


def same(text: Column) -> Column:
    return text


def extract(question: Column, passages: Column) -> Column:
    """The best passage's first sentences, cited."""
    best = F.get(passages, F.lit(0))
    said = F.array_join(F.slice(F.split(best["text"], r"(?<=[.!?])\s+"), 1, 2), " ")
    return F.when(best.isNotNull(), F.concat(said, F.lit(" [P1, Page "), best["page_start"].cast("string"), F.lit("]")))


def agrees(question: Column, answer: Column, passages: Column) -> Column:
    return F.lit("CONSISTENT")


@dataclass(frozen=True)
class Models:
    embed: Callable[[Column], Column] = hashed_vector
    translate: Callable[[Column], Column] = same
    generate: Callable[[Column, Column], Column] = extract
    rewrite: Callable[[Column, Column], Column] = field(default=lambda answer, language: answer)
    #: Whether the passages that an answer cites agree: a verdict that begins with CONTRADICT if not.
    check: Callable[[Column, Column, Column], Column] = agrees


def with_cached_vectors(questions: DataFrame, cache: DataFrame, embed: Callable[[Column], Column] = hashed_vector) -> DataFrame:
    """``vector`` for each question: from the cache (key, vector), computed only where missing."""
    keyed = questions.withColumn("key", F.sha2(F.lower(F.trim("question")), 256))
    # Only questions that are not cached go through the model at all.
    known = keyed.join(cache.select("key", "vector"), "key").drop("key")
    missing = keyed.join(cache.select("key"), "key", "left_anti").drop("key")
    return known.unionByName(missing.withColumn("vector", embed(F.col("question"))))


def provider_order(wanted: list[str], keys: dict[str, str | None]) -> list[str]:
    """The listed providers that have a key, in order."""
    return [name for name in wanted if keys.get(name)]


def call_chain(calls: list[tuple[str, Callable[[], str]]], tries: int = 3, wait: Callable[[int], None] = lambda n: None) -> str:
    """The first provider's text that is not empty.

    A call that raises an error with status 429 is tried again up to ``tries`` times, any other
    error or an empty text goes to the next provider; the last error is raised if none answers.
    """
    last: Exception | None = None
    for _, call in calls:
        for attempt in range(tries):
            try:
                text = call()
                if text:
                    return text
                break
            except Exception as error:  # any failure of a provider leads to the next
                last = error
                if getattr(error, "status", None) != 429:
                    break
                wait(attempt)
    raise last or ValueError("no provider answered")
