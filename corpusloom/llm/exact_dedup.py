"""Exact deduplication by Grace hashing.

Texts are equal when they are identical once white space is deleted. Three steps:

1. Each scan task merges equal texts of its own in an open-addressing table, so a text that
   fills a third of the corpus leaves the task as one record, not as many.
2. The records are dealt by digest. A task that gets more than fits its table partitions
   its records to spill files by further digest bits, again and again, until each bucket
   fits; then the table compares complete contents. The spill files belong to one task
   attempt: they are deleted when it ends and nothing else reads them, so a lost executor
   costs a repetition of the task and nothing more.
3. The groups (digest, row that stays, size) are joined to the rows by digest, safely for
   groups that hold a large part of all rows.

To drop copies, the records carry the whole best row of their group through the first two
steps, so exactly one row of each group comes out and no join by id is needed.
"""

from __future__ import annotations

import hashlib
import pickle
import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.llm.blocks import text_pieces
from corpusloom.llm.common import FEW_KEYS, checkpoint, join_hot, partitions, require, text_or_empty

#: Bytes of content in a table before a task flushes (first step) or spills (second step).
TABLE_BYTES = 64 << 20
#: Spill files per level: the fan-out of one recursive partitioning.
FAN_OUT_BITS = 4

RECORDS = "digest binary, content binary, best_chars long, best_id long, n_rows long"
GROUPS = "digest binary, keep_id long, group_size long"

#: digest, content, code points of the best row, its id, rows, and if rows are carried, that row.
Record = tuple


def better(record: Record, than: Record) -> bool:
    """Whether a row goes before another: more code points, then the smaller id, null last, then the row itself."""
    if record[2] != than[2]:
        return record[2] > than[2]
    if record[3] != than[3]:
        return record[3] is not None and (than[3] is None or record[3] < than[3])
    return tuple(record[5:]) < tuple(than[5:])


class ContentTable:
    """An open-addressing table (linear probing) from complete contents to their merged record."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.entries: list[list] = []
        self.n_bytes = 0

    def add(self, record: Record) -> None:
        digest, content = record[:2]
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[8:16], "big") & mask
        while (found := self.slots[at]) >= 0:
            entry = self.entries[found]
            if entry[1] == content:
                rows = entry[4] + record[4]
                if better(record, entry):
                    entry[:] = record
                entry[4] = rows
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.entries)
        self.entries.append(list(record))
        self.n_bytes += len(content) + sum(map(len, record[5:])) + 200
        if len(self.entries) * 2 > len(self.slots):
            self._grow()

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for n, entry in enumerate(self.entries):
            at = int.from_bytes(entry[0][8:16], "big") & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = n


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Record]:
    for batch in batches:
        columns = [batch.column(n) for n in range(5)]
        for row in range(batch.num_rows):
            yield tuple(c[row].as_py() for c in columns)


def _record_batches(entries: list[list], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    part: list[list] = []
    size = 0
    for entry in entries:
        part.append(entry)
        size += len(entry[1])
        if size > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


_RECORD_SCHEMA = pa.schema([("digest", pa.binary()), ("content", pa.binary()), ("best_chars", pa.int64()), ("best_id", pa.int64()), ("n_rows", pa.int64())])
_GROUP_SCHEMA = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def combine(batches: Iterator[pa.RecordBatch], table_bytes: int = TABLE_BYTES) -> Iterator[pa.RecordBatch]:
    """Merge equal texts of one scan task; a full table is emitted and begun anew."""
    table = ContentTable()
    for record in _rows(batches):
        table.add(record)
        if table.n_bytes > table_bytes:
            yield from _record_batches(table.entries, _RECORD_SCHEMA)
            table = ContentTable()
    yield from _record_batches(table.entries, _RECORD_SCHEMA)


def grace(records: Iterator[Record], folder: Path, table_bytes: int = TABLE_BYTES, depth: int = 0) -> Iterator[list]:
    """The merged records of a stream of any length, in bounded memory."""
    table, files = ContentTable(), None
    shift = 256 - FAN_OUT_BITS * (depth + 1)

    def bucket(digest: bytes) -> int:
        return (int.from_bytes(digest, "big") >> max(shift, 0)) & ((1 << FAN_OUT_BITS) - 1)

    try:
        for record in records:
            if files is None:
                table.add(record)
                if table.n_bytes <= table_bytes or len(table.entries) < 2 or shift < 0:
                    continue
                level = folder / f"level{depth}"
                level.mkdir(parents=True, exist_ok=True)
                files = [(level / str(n)).open("w+b") for n in range(1 << FAN_OUT_BITS)]
                for entry in table.entries:
                    pickle.dump(tuple(entry), files[bucket(entry[0])], protocol=5)
                table = ContentTable()
            else:
                pickle.dump(record, files[bucket(record[0])], protocol=5)
        if files is None:
            yield from table.entries
        for n, file in enumerate(files or ()):
            file.seek(0)
            yield from grace(_unpickled(file), folder / f"{depth}-{n}", table_bytes, depth + 1)
            file.truncate(0)
    finally:
        for file in files or ():
            file.close()


def _unpickled(file) -> Iterator[Record]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _merge(table_bytes: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Path(tempfile.mkdtemp(prefix="grace-"))
        try:
            part: list[tuple] = []
            for digest, _, _, keep_id, rows in grace(_rows(batches), folder, table_bytes):
                part.append((digest, keep_id, rows))
                if len(part) == 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), _GROUP_SCHEMA)], schema=_GROUP_SCHEMA)
                    part = []
            if part:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), _GROUP_SCHEMA)], schema=_GROUP_SCHEMA)
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return merge


def exact_groups(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(rows, groups)``: every row with its digest, and one record per distinct text."""
    require(docs, ["doc_id", "text"])
    squeezed = F.regexp_replace(text_or_empty(), "[\\x20\\x09-\\x0D]+", "")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text_or_empty()).cast("long").alias("chars"), squeezed.cast("binary").alias("content"))
    digest = F.unhex(F.sha2(F.col("content"), 256))
    records = keyed.select(digest.alias("digest"), "content", F.col("chars").alias("best_chars"), F.col("doc_id").alias("best_id"), F.lit(1).cast("long").alias("n_rows"))
    merged = records.mapInArrow(lambda it: combine(it, table_bytes), RECORDS).repartition(partitions(docs.sparkSession), "digest").mapInArrow(_merge(table_bytes), GROUPS)
    return keyed.select("doc_id", digest.alias("digest")), merged


def exact_dedup(docs: DataFrame, table_bytes: int = TABLE_BYTES, few: int = FEW_KEYS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the most code points in the original text, then the smallest ``doc_id``,
    stays. A null text counts as empty, and empty texts are equal to one another. A null
    ``doc_id`` goes last among ties. Rows that repeat both text and ``doc_id`` count in
    ``group_size`` and are marked alike. Texts are compared whole, however long. An empty
    table gives an empty result; columns other than ``doc_id`` and ``text`` are neither read
    nor returned.
    """
    rows, groups = exact_groups(docs, table_bytes)
    # The running number deals the rows of hot groups; written down, it is the same in a repeated task.
    rows = checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))
    found = join_hot(rows, checkpoint(groups), "digest", "group_size", F.col("row"), few=few)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _with_row(text: str | None, doc_id: int | None, row: bytes) -> Record:
    content = (text or "").encode().translate(None, b"\t\n\v\f\r ")
    return hashlib.sha256(content).digest(), content, len(text or ""), doc_id, 1, row


def drop_copies(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``docs`` with one row of each set of equal texts, columns unchanged.

    The row that stays is that of ``exact_dedup``; among rows that tie in code points and
    ``doc_id`` (repeated or null ids) exactly one stays, the same one in every run. A null
    text counts as empty and is kept as it is if its row stays.
    """
    require(docs, ["doc_id", "text"])
    at_text, at_id = docs.columns.index("text"), docs.columns.index("doc_id")
    schema = to_arrow_schema(docs.schema)

    def merge_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[Record]:
            for batch in batches:
                for piece in text_pieces(batch, "text", 4 << 20):
                    for row in zip(*[c.to_pylist() for c in piece.columns]):
                        yield _with_row(row[at_text], row[at_id], pickle.dumps(row, protocol=5))

        table = ContentTable()
        for record in records():
            table.add(record)
            if table.n_bytes > table_bytes:
                yield from rows_of(table.entries)
                table = ContentTable()
        yield from rows_of(table.entries)

    def rows_of(entries: list[list]) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(entries), 256):
            part = entries[start : start + 256]
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in part], pa.binary()), pa.array([e[5] for e in part], pa.binary())], names=["digest", "row"])

    def keep_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[Record]:
            for batch in batches:
                for value in batch.column(1):
                    own = value.as_py()
                    row = pickle.loads(own)
                    yield _with_row(row[at_text], row[at_id], own)

        folder = Path(tempfile.mkdtemp(prefix="grace-"))
        try:
            part, size = [], 0
            for entry in grace(records(), folder, table_bytes):
                part.append(pickle.loads(entry[5]))
                size += len(entry[5])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)
                    part, size = [], 0
            if part:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    merged = docs.mapInArrow(merge_task, "digest binary, row binary").repartition(partitions(docs.sparkSession), "digest")
    return merged.mapInArrow(keep_task, docs.schema)
