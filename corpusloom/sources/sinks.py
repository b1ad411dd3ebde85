"""Sinks: partitioned tables, events and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_partitioned(rows: DataFrame, path: str, *keys: str) -> None:
    """Replace the partitions that ``rows`` has and leave the others."""
    rows.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_pages(pages: DataFrame, path: str) -> None:
    pages.write.mode("overwrite").json(path)


def event_message(kind: str, *columns: str) -> Column:
    """A message of the event stream."""
    return F.concat(F.lit(f"event: {kind}\ndata: "), F.to_json(F.struct(*columns)), F.lit("\n\n"))


def answer_tokens(answers: DataFrame) -> DataFrame:
    """(q, n, kind, data): a finished answer word by word, then its trailer."""
    tokens = answers.select("q", F.posexplode(F.split("answer", " ")).alias("n", "data")).withColumn("kind", F.lit("token"))
    last = F.size(F.split("answer", " "))
    nothing = answers.where("no_result").select("q", last.alias("n"), F.lit("").alias("data"), F.lit("no_result").alias("kind"))
    sources = answers.select("q", (last + 1).alias("n"), F.to_json("sources").alias("data"), F.lit("sources").alias("kind"))
    done = answers.select("q", (last + 2).alias("n"), F.lit("").alias("data"), F.lit("done").alias("kind"))
    return tokens.unionByName(nothing).unionByName(sources).unionByName(done)


def log_line(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))
