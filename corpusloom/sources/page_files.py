"""Files of pages as a data source: ``spark.read.format("page_files").option("decoder", ...).load(folder)``.

Tasks are planned from the sizes of files alone. Small files share a task; a large one is read by several, each of
which takes an equal range of its pages or, where a decoder reads lines, the lines that begin in an equal range of its
bytes. What a page holds is a decoder's matter: the one for OCR tables is here, those for PDF files or images are
brought by a deployment and named in an option. A schema given to the reader
(``.schema("path string, page_num int, text string")``) is what the decoder is asked for, so columns that are not
wanted are not decoded.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from fnmatch import fnmatch
from importlib import import_module
from itertools import batched
from typing import BinaryIO, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpusloom.sources.files import listed, opened
from corpusloom.sources.readers import OCR_SCHEMA

#: Bytes that a task reads, from small files together or from a part of a large one.
BYTES_A_TASK = 32 << 20
#: Lines whose fields are held at once.
LINES_AT_ONCE = 8192


class Decoder(Protocol):
    """Reads the pages of one file. ``ValueError`` says that the file, or a range of its pages, cannot be read."""

    #: The columns a row has, and their types in DDL.
    columns: dict[str, str]

    def count(self, file: BinaryIO) -> int:
        """The number of pages; asked only of files that several tasks read."""

    def rows(self, file: BinaryIO, first: int, end: int | None, columns: Sequence[str]) -> Iterator[tuple]:
        """The values of ``columns`` for the pages from the ``first``-th (0 is the start of the file) up to ``end``, or to the last."""


class LineDecoder(Protocol):
    """Reads files of lines, from any byte on. ``ValueError`` says that a file, or a part of it, cannot be read."""

    columns: dict[str, str]

    def check(self, file: BinaryIO, first: int, end: int) -> None:
        """Raises for lines that begin in the bytes ``first`` to ``end`` and make the whole file unreadable; asked only of files that several tasks read."""

    def batches(self, file: BinaryIO, first: int, end: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The columns of ``schema`` for the lines that begin in the bytes ``first`` to ``end``."""


class OcrTable:
    """OCR output in tab-separated form, one word a line."""

    columns = dict(column.split() for column in OCR_SCHEMA.split(", "))
    kinds: dict[str, Callable[[str], object]] = {"int": int, "double": float, "string": str}

    def _lines(self, file: BinaryIO, first: int, end: int) -> tuple[dict[str, int], Iterator[list[str]]]:
        """The place of each column, and the fields of each line that begins in the bytes ``first`` to ``end`` below the header."""
        own = io.BufferedReader(file)
        header = own.readline()
        places = {name: n for n, name in enumerate(header.decode().rstrip("\r\n").split("\t"))}
        if "page_num" not in places:
            raise ValueError("no column page_num in the first line")
        at = len(header)
        if first > at:  # what is left of the line that began before is another task's
            own.seek(first - 1)
            at = first - 1 + len(own.readline())
        data = own.read(end - at) if at < end else b""
        if data and not data.endswith(b"\n"):
            data += own.readline()
        return places, self._fields(data.decode().split("\n"), places["page_num"])

    def _fields(self, lines: list[str], page_num: int) -> Iterator[list[str]]:
        for line in lines:
            fields = line.rstrip("\r").split("\t")
            if fields == [""]:
                continue
            if len(fields) <= page_num:
                raise ValueError(f"a line of {len(fields)} fields")
            yield fields

    def check(self, file: BinaryIO, first: int, end: int) -> None:
        for _ in self._lines(file, first, end)[1]:
            pass

    def batches(self, file: BinaryIO, first: int, end: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        places, lines = self._lines(file, first, end)
        for some in batched(lines, LINES_AT_ONCE):
            try:
                values = [pa.array(self._values(own.name, some, places), own.type) for own in schema]
            except OverflowError as reason:
                raise ValueError(str(reason)) from reason
            yield pa.RecordBatch.from_arrays(values, schema=schema)

    def _values(self, column: str, lines: Sequence[list[str]], places: dict[str, int]) -> list[object]:
        kind, at = self.kinds[self.columns[column]], places.get(column)
        if at is None:
            return [None] * len(lines)
        return [None if at >= len(f) or (f[at] == "" and column != "text") else kind(f[at]) for f in lines]


@dataclass
class Part(InputPartition):
    """Files read whole, or one ``share`` of the pages, or bytes, of one file cut in ``shares``."""

    paths: list[str]
    share: int = 0
    shares: int = 1

    def range(self, units: int) -> tuple[int, int]:
        """Where the share begins and ends in so many pages or bytes."""
        return units * self.share // self.shares, units * (self.share + 1) // self.shares


def planned(sizes: Sequence[tuple[str, int]], most: int = BYTES_A_TASK) -> list[Part]:
    """Parts for (path, bytes): files of at most ``most`` bytes fill a part together, larger ones are cut evenly."""
    parts: list[Part] = []
    held: list[str] = []
    total = 0
    for path, size in sizes:
        if size > most:
            shares = -(-size // most)
            parts += [Part([path], share, shares) for share in range(shares)]
            continue
        if held and total + size > most:
            parts.append(Part(held))
            held, total = [], 0
        held, total = [*held, path], total + size
    return [*parts, Part(held)] if held else parts


class _Reader(DataSourceReader):
    def __init__(self, folder: str, pattern: str, most: int, decoder: Decoder | LineDecoder, schema: StructType, checks: bool) -> None:
        self.folder, self.pattern, self.most, self.decoder, self.columns, self.checks = folder, pattern, most, decoder, schema.fieldNames(), checks
        self.asked = [c for c in self.columns if c not in ("path", "error")]
        self.schema = to_arrow_schema(schema)

    def partitions(self) -> Sequence[InputPartition]:
        parts = planned([(f.path, f.size) for f in listed(self.folder) if fnmatch(f.base_name, self.pattern)], self.most)
        return [p for p in parts if not self.checks or p.shares > 1] or [Part([])]

    def read(self, partition: Part) -> Iterator[tuple] | Iterator[pa.RecordBatch]:
        """Rows of the part. A file, or a share of it, that cannot be read has one row with the reason and no others."""
        if self.checks:
            return self._checked(partition)
        return self._batches(partition) if hasattr(self.decoder, "batches") else self._rows(partition)

    def _checked(self, partition: Part) -> Iterator[tuple]:
        """The reason why the file of a share cannot be read, if this share has one."""
        system, _ = opened(self.folder)
        for path in partition.paths:
            try:
                with system.open_input_file(path) as file:
                    self.decoder.check(file, *partition.range(file.size()))
            except ValueError as reason:
                yield self._row(path, [None] * len(self.asked), str(reason) or "not readable")

    def _batches(self, partition: Part) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.folder)
        wanted = pa.schema([self.schema.field(c) for c in self.asked])
        for path in partition.paths:
            try:  # the batches of a share are held until all of it is known to be good
                with system.open_input_file(path) as file:
                    found, error = list(self.decoder.batches(file, *partition.range(file.size()), wanted)), None
            except ValueError as reason:
                found, error = [pa.RecordBatch.from_arrays([pa.nulls(1, own.type) for own in wanted], schema=wanted)], str(reason) or "not readable"
            for batch in found:
                said = {"path": pa.array([path] * batch.num_rows, pa.string()), "error": pa.array([error] * batch.num_rows, pa.string())}
                yield pa.RecordBatch.from_arrays([said[c] if c in said else batch.column(self.asked.index(c)) for c in self.columns], schema=self.schema)

    def _rows(self, partition: Part) -> Iterator[tuple]:
        system, _ = opened(self.folder)
        for path in partition.paths:
            try:
                first, end = 0, None
                if partition.shares > 1:
                    with system.open_input_file(path) as file:
                        first, end = partition.range(self._counted(file, partition))
                    if first == end:
                        continue
                # A share has BYTES_A_TASK at most, pages being alike: its rows are held until all of them are known to be good.
                with system.open_input_file(path) as file:
                    found = list(self.decoder.rows(file, first, end, self.asked))
            except ValueError as reason:
                found = None
                yield self._row(path, [None] * len(self.asked), str(reason) or "not readable")
            for values in found or []:
                yield self._row(path, values, None)

    def _counted(self, file: BinaryIO, partition: Part) -> int:
        """The number of pages; a file without a count is reported by its first share alone."""
        try:
            return self.decoder.count(file)
        except ValueError:
            if partition.share:
                return 0
            raise

    def _row(self, path: str, values: Sequence[object], error: str | None) -> tuple:
        known = dict(zip(self.asked, values)) | {"path": path, "error": error}
        return tuple(known[c] for c in self.columns)


def _decoder(named: str | None) -> Decoder | LineDecoder:
    module, _, name = (named or f"{__name__}:OcrTable").partition(":")
    return getattr(import_module(module), name)()


class PageFiles(DataSource):
    """``path`` (within its file system), the decoder's columns, ``error``.

    Options: ``path``; ``decoder``, as ``module:name`` (OCR tables where none is named); ``pattern`` of file names;
    ``bytes``, how many a task reads; ``checks``, for a decoder of lines: rows of nothing but the reasons why files that
    several tasks read cannot be read. An empty folder has no rows; one that is not there is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "page_files"

    def _decoder(self) -> Decoder | LineDecoder:
        return _decoder(self.options.get("decoder"))

    def schema(self) -> str:
        return ", ".join(f"{name} {kind}" for name, kind in ({"path": "string"} | self._decoder().columns | {"error": "string"}).items())

    def reader(self, schema: StructType) -> DataSourceReader:
        decoder = self._decoder()
        if unknown := [c for c in schema.fieldNames() if c not in {"path", "error", *decoder.columns}]:
            raise ValueError(f"the decoder has no columns {unknown}")
        return _Reader(self.options["path"], self.options.get("pattern", "*"), int(self.options.get("bytes", BYTES_A_TASK)), decoder, schema, self.options.get("checks") == "true")


def page_files(spark: SparkSession, path: str, columns: str | None = None, **options: str) -> DataFrame:
    """The pages of files below ``path``; ``columns`` (DDL) are those to decode, all where none are given.

    A file that several tasks read by ranges of bytes is checked in a pass of its own: if one of them meets a
    fault the file has one row, and what the others read of it is dropped.
    """
    spark.dataSource.register(PageFiles)
    reader = spark.read.format("page_files").options(**options)
    found = (reader.schema(columns) if columns else reader).load(path)
    if not hasattr(_decoder(options.get("decoder")), "check"):
        return found
    wanted = [f for f in found.schema if f.name not in ("path", "error")]
    whole = spark.read.format("page_files").options(**options).schema(StructType(wanted).add("path", "string").add("error", "string")).load(path)
    faults = spark.read.format("page_files").options(**options, checks="true").schema("path string, error string").load(path)
    broken = faults.groupBy("path").agg(F.min("error").alias("error"))
    good = whole.join(F.broadcast(broken.select("path")), "path", "left_anti")
    return good.unionByName(broken, allowMissingColumns=True).select(*found.columns)
