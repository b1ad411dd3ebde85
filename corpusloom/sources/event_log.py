"""Events as a sink with commit and abort: each event is there once, whatever tasks, batches or queries are repeated.

A task writes its events to a file of its own. Only the driver's commit, one file that is renamed into place once all
tasks have ended, makes the files of a batch part of the log; files that no commit names are never read. A batch that is
repeated after a restart finds its commit and leaves it as it is. The folder has to be on a file system whose renames are
atomic and seen by all executors.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from corpusloom.sources.files import listed, opened

EVENTS = "task int, n long, message string"
COMMIT = "channel string, batch long, files array<string>"


@dataclass
class Written(WriterCommitMessage):
    """The file one task has written, none if it had no rows."""

    file: str | None


class _Files:
    """What the batch and the stream form share: files of tasks, commits and their undoing."""

    def __init__(self, path: str, channel: str) -> None:
        self.path, self.channel = path.rstrip("/"), channel

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = opened(self.path)
        system.create_dir(f"{root}/events", recursive=True)
        task = TaskContext.get().partitionId()
        name, n, out = f"{uuid.uuid4().hex}.json", 0, None
        try:
            for batch in iterator:
                messages = pc.cast(batch.column(batch.schema.get_field_index("message")), pa.string()).to_pylist()
                if messages and out is None:
                    out = system.open_output_stream(f"{root}/events/{name}")
                for message in messages:
                    out.write(json.dumps({"task": task, "n": n, "message": message}, ensure_ascii=False).encode() + b"\n")
                    n += 1
        finally:
            if out is not None:
                out.close()
        return Written(name if out is not None else None)

    def _committed(self, messages: list[Written | None], name: str, batch: int) -> None:
        system, root = opened(self.path)
        folder = f"{root}/commits"
        if system.get_file_info(f"{folder}/{name}.json").is_file:
            self._undone(messages)  # the batch is there already: this was a repeat
            return
        system.create_dir(folder, recursive=True)
        draft = f"{folder}/.{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as out:
            out.write(json.dumps({"channel": self.channel, "batch": batch, "files": [m.file for m in messages if m and m.file]}).encode())
        system.move(draft, f"{folder}/{name}.json")

    def _undone(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        for message in messages:
            if message and message.file:
                system.delete_file(f"{root}/events/{message.file}")


class _StreamWriter(_Files, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self._committed(messages, f"{self.channel}-{batchId:012d}", batchId)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self._undone(messages)


class _BatchWriter(_Files, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self._committed(messages, f"{self.channel}-{uuid.uuid4().hex}", 0)

    def abort(self, messages: list[Written | None]) -> None:
        self._undone(messages)


class EventLog(DataSource):
    """A sink for rows with a string column ``message``; options ``path`` and ``channel``, one for each streaming query."""

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return "message string"

    def _files(self, schema: StructType) -> tuple[str, str]:
        if "message" not in schema.fieldNames():
            raise ValueError("events need a column message")
        return self.options["path"], self.options.get("channel", "events")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("a log is only added to")
        return _BatchWriter(*self._files(schema))

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(*self._files(schema))


def publish(events: DataFrame, path: str, channel: str = "events") -> None:
    """Adds the ``message`` of each row to the log, all of them or none; null is an event without a text."""
    events.sparkSession.dataSource.register(EventLog)
    events.select("message").write.format("event_log").mode("append").option("channel", channel).save(path)


def publish_stream(events: DataFrame, path: str, checkpoint: str, channel: str, **trigger) -> StreamingQuery:
    """Starts a query that adds each event once. Its checkpoint and its channel belong together."""
    events.sparkSession.dataSource.register(EventLog)
    made = events.select("message").writeStream.format("event_log").outputMode("append").option("path", path).option("channel", channel).option("checkpointLocation", checkpoint)
    return made.trigger(**(trigger or {"availableNow": True})).start()


def published(spark: SparkSession, path: str) -> DataFrame:
    """(channel, batch, task, n, message): the events whose commit is there; ``n`` is their order in a task."""
    commits = spark.read.schema(COMMIT).json(f"{path}/commits").select("channel", "batch", F.explode("files").alias("file"))
    events = spark.read.schema(EVENTS).json(f"{path}/events").select("*", F.col("_metadata.file_name").alias("file"))
    return events.join(commits, "file").select("channel", "batch", "task", "n", "message")


def clear_unnamed(spark: SparkSession, path: str, before: float) -> int:
    """Deletes files of tasks that ended without a commit and were last written before ``before`` (seconds since 1970).

    The time has to lie ahead of the start of every batch at work. Returns how many files there were.
    """
    system, root = opened(path)
    named = spark.read.schema(COMMIT).json(f"{path}/commits").select(F.explode("files").alias("file"))
    old = [(f.base_name,) for f in listed(f"{path}/events") if f.mtime.timestamp() < before]
    gone = spark.createDataFrame(old, "file string").join(named, "file", "left_anti").toLocalIterator()
    n = 0
    for n, row in enumerate(gone, 1):
        system.delete_file(f"{root}/events/{row['file']}")
    return n
