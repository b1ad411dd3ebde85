"""Blocks: runs of whole documents packed into one compressed row.

Operators that look words (or hashes) up in a table that grows with the corpus cannot
broadcast that table, and exploding every occurrence into a row would shuffle many times the
text. Instead the documents of a scan task are packed into blocks of some megabytes; a block
asks for each *distinct* word once, the questions are dealt by word, answered where all
questions about that word meet, and the answers go back to the block that asked. A word that
fills a third of the corpus is then one question per block, and a task holds one block and
its own share of the words, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.ipc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from corpusloom.llm.common import partitions

#: Bytes of text after which a block is closed; one longer document is a block of its own.
BLOCK_BYTES = 8 << 20

BLOCKS = "block long, payload binary"
QUESTIONS = "block long, bucket int, asked binary, given binary"
ANSWERS = "block long, bucket int, answer binary"
ANSWER_SCHEMA = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("answer", pa.binary())])
_BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("payload", pa.binary())])
_QUESTION_SCHEMA = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("asked", pa.binary()), ("given", pa.binary())])


@cache
def _codecs() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """Made once in a process: for short data, making them takes longer than using them."""
    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def squeeze(data: bytes) -> bytes:
    return _codecs()[0].compress(data)


def unsqueeze(data: bytes) -> bytes:
    return _codecs()[1].decompress(data)


def seal(batches: list[pa.RecordBatch]) -> bytes:
    """Record batches as a compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        for batch in batches:
            writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unseal(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(payload)).read_all()


def text_pieces(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``limit`` bytes of text."""
    start, size = 0, 0
    lengths = pc.binary_length(batch.column(column)).to_pylist()
    for row, length in enumerate(lengths):
        size += length or 0
        if size >= limit:
            yield batch.slice(start, row + 1 - start)
            start, size = row + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _packer(column: str, block_bytes: int, make: Callable[[list[pa.RecordBatch]], bytes]):
    def pack_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([make(held)], pa.binary())], schema=_BLOCK_SCHEMA)

        for batch in batches:
            for piece in text_pieces(batch, column, block_bytes):
                held.append(piece)
                size += piece.column(column).nbytes
                if size >= block_bytes:
                    yield closed()
                    number, held, size = number + 1, [], 0
        if held:
            yield closed()

    return pack_task


def pack(docs: DataFrame, column: str = "text", block_bytes: int = BLOCK_BYTES, make: Callable[[list[pa.RecordBatch]], bytes] = seal) -> DataFrame:
    """Blocks of ``docs``, dealt by block number so that every user of them shares one exchange.

    ``make`` turns the rows of a block into its payload, which ``read`` of the functions below turns back.
    """
    return docs.mapInArrow(_packer(column, block_bytes, make), BLOCKS).repartition(partitions(docs.sparkSession), "block")


def ask(blocks: DataFrame, questions_of: Callable[..., Iterable[tuple[int, bytes, bytes]]], read: Callable = unseal) -> DataFrame:
    """The questions of each block, (bucket, asked, given), dealt by bucket."""
    n = partitions(blocks.sparkSession)

    def ask_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [(block, bucket, squeeze(asked), squeeze(given)) for bucket, asked, given in questions_of(read(payload.as_buffer()), n)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _QUESTION_SCHEMA)], schema=_QUESTION_SCHEMA)

    return blocks.mapInArrow(ask_task, QUESTIONS).repartition(n, "bucket")


def resolve(blocks: DataFrame, answers: DataFrame, resolve_block: Callable[..., pa.Table], schema: str, numbered: bool = False, read: Callable = unseal) -> DataFrame:
    """Each block with the answers to its questions, (bucket, answer), through ``resolve_block``.

    With ``numbered`` the block's number goes before the other two arguments.
    """

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        replies = [(k, unsqueeze(a)) for k, a in zip(right.column("bucket").to_pylist(), right.column("answer").to_pylist())]
        out = [resolve_block(*([k] if numbered else []), read(p.as_buffer()), replies) for k, p in zip(left.column("block").to_pylist(), left.column("payload"))]
        return pa.concat_tables(out)

    answers = answers.repartition(partitions(blocks.sparkSession), "block")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(both, schema)
