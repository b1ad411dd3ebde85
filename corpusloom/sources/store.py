"""Stored tables: results that several later steps read, written once where every executor sees them.

A plan that goes on from a stored table begins with a scan; it is not analysed, optimised and
computed again for every step that uses it, as the plan behind ``persist`` is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, or the checkpoint folder that was set.

    Where neither is, a local session takes its warehouse; on a cluster, where that may be any
    machine's own folder, it is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if found is None and sc._jsc.sc().getCheckpointDir().isDefined():
        found = sc._jsc.sc().getCheckpointDir().get()
    if found is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir")
    return found.rstrip("/")


def stored(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` written to the shared folder and read from there; with ``keys`` rows of one key lie in one file."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    (rows.repartition(*keys) if keys else rows).write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
