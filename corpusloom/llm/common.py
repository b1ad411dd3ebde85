"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that count as white space in the contracts: space and U+0009 to U+000D.
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def text_or_empty(column: str = "text") -> Column:
    """The text column, null as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, or the folder that was set; a local session without one takes its warehouse."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if found is None:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        sc.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the reliable checkpoint folder, its lineage cut."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of the shared file system."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


def forget(*done: DataFrame) -> None:
    """Delete the files of checkpoints that nothing reads any more."""
    for df in done:
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            delete(df.sparkSession, file.get())


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def require(df: DataFrame, columns: Sequence[str]) -> None:
    """Raise for a table without one of ``columns``."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")


#: Facts of up to this many keys are broadcast whole.
FEW_KEYS = 1000


def join_hot(rows: DataFrame, facts: DataFrame, key: str, weight: str, spread: Column, heavy: int = 1000, few: int = FEW_KEYS) -> DataFrame:
    """``rows`` left-joined to ``facts`` by ``key``, safe for keys that hold a large part of the rows.

    ``facts`` has one row per key; ``weight`` is its number of ``rows``. Up to ``few`` facts
    are broadcast. Beyond that, fewer than ``heavy`` keys can hold more than 1/``heavy`` of the
    rows each: their facts are broadcast, and their rows are dealt by ``spread`` in the
    shuffled join for the other keys. ``spread`` should differ between rows and must not
    change when a task is repeated.
    """
    total, n = facts.agg(F.sum(weight), F.count("*")).first()
    others = [c for c in facts.columns if c != key]
    if n <= few:
        own = facts.select(F.col(key).alias("_hot"), F.struct(*others).alias("_hot_facts"))
        found = rows.join(F.broadcast(own), rows[key] == F.col("_hot"), "left")
        return found.select(*[F.col(c) for c in rows.columns], *[F.col("_hot_facts")[c].alias(c) for c in others])
    is_heavy = F.col(weight) * heavy > (total or 0)
    hot = facts.where(is_heavy).select(F.col(key).alias("_hot"), F.struct(*others).alias("_hot_facts"))
    light = facts.where(~is_heavy).select(F.col(key).cast("string").alias("_light"), F.struct(*others).alias("_light_facts"))
    marked = rows.join(F.broadcast(hot), rows[key] == F.col("_hot"), "left")
    own = F.concat(F.lit("\0#"), F.coalesce(spread.cast("string"), F.lit("")))
    marked = marked.withColumn("_find", F.when(F.col("_hot_facts").isNull() & F.col(key).isNotNull(), F.col(key).cast("string")).otherwise(own))
    found = marked.join(light, F.col("_find") == F.col("_light"), "left")
    facts_of = F.coalesce("_hot_facts", "_light_facts")
    return found.select(*[F.col(c) for c in rows.columns], *[facts_of[c].alias(c) for c in others])
