"""Sources: blobs, page dumps, OCR output and tables, all with explicit schemas."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.calls import Again, Calls, in_order, tried

OCR_SCHEMA = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left double, top double, width double, height double, conf double, text string"
PAGES_SCHEMA = "physical_page int, page_num int, printed_page_num int, footer_extracted boolean, words array<struct<text string, bbox array<double>, line string, para_start boolean>>"
SEPARATOR = r"\*\*Page\s+\d+\*\*|\[Page\s+\d+\]|---+"
WORDS_NEEDED = 10


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def blobs(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length and content of files; unread columns cost nothing."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def blob_or_null(wanted: DataFrame, own: DataFrame) -> DataFrame:
    """The content of each wanted path, null where the file is missing."""
    return wanted.join(own.select("path", "content"), "path", "left")


#: Megabytes that a passage stands for where no file sizes are known.
MEGABYTES_A_CHUNK = 0.05


def stored_megabytes(own: DataFrame, n_chunks: int = 0) -> DataFrame:
    """The size of all files in MB, two decimals; without any file an estimate from the number of passages."""
    size = F.when(F.count("length") > 0, F.sum("length") / (1024 * 1024)).otherwise(n_chunks * MEGABYTES_A_CHUNK)
    return own.agg(F.round(size, 2).alias("megabytes"))


PDF_WORDS = "path string, page int, line string, word_no int, text string, x0 double, y0 double, x1 double, y1 double, error string"


def pdf_words(own: DataFrame, read: Callable[[bytes], Iterable[tuple]]) -> DataFrame:
    """Words of PDF files through a decoder that a deployment brings.

    ``read`` takes the bytes of one file and gives (page, line, word number, text, box of four); it
    runs where the file is read. A file that it cannot read has one row with its path and the reason in ``error``.
    """

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows = [(path, *row, None) for row in read(bytes(content))]
                except ValueError as reason:
                    rows = [(path, *[None] * 8, str(reason) or "not readable")]
                yield pd.DataFrame(rows, columns=["path", "page", "line", "word_no", "text", "x0", "y0", "x1", "y1", "error"]).astype({"page": "Int32", "word_no": "Int32"})

    return own.select("path", "content").mapInPandas(words, PDF_WORDS)


def image_texts(own: DataFrame, recognise: Callable[[bytes], str], tries: int = 10, at_once: int = 4, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """(path, text, tries) of page images, one request for each, several at once; an empty text is asked for again after a pause.

    A text that stays empty is the empty string. Files are dealt evenly, as requests take longer than reading.
    """
    how = Calls(size=1, at_once=at_once, tries=tries, pause=pause)

    def asked(contents: list[bytes]) -> list[tuple[str, int]]:
        n = 0

        def once(rows: list[bytes]) -> list[str]:
            nonlocal n
            n += 1
            text = recognise(rows[0]) or ""
            if not text.strip() and n < tries:
                raise Again("empty text")
            return [text if text.strip() else ""]

        return [(tried(once, contents, how)[0], n)]

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = list(in_order([bytes(c) for c in batch["content"]], asked, how))
            yield pd.DataFrame({"path": list(batch["path"]), "text": [t for t, _ in found], "tries": [n for _, n in found]})

    return own.select("path", "content").repartition("path").mapInPandas(texts, "path string, text string, tries int")


def valid_pdf(own: DataFrame, name: str = "path", content_type: str | None = None) -> DataFrame:
    """Files with the suffix, the first bytes and, where a column says one, the content type of a PDF."""
    own = own.where(F.col(content_type) == "application/pdf") if content_type else own
    return own.where(F.lower(name).endswith(".pdf") & (F.length("content") >= 5) & (F.substring("content", 1, 4) == F.unhex(F.lit("25504446"))))


def ocr_words(spark: SparkSession, path: str, dpi: int = 300) -> DataFrame:
    """Words of OCR output in tab-separated form: sure, sized, of at most 40 characters, in points."""
    rows = spark.read.csv(path, sep="\t", header=True, schema=OCR_SCHEMA, quote="")
    return clean_ocr_words(rows, dpi)


def clean_ocr_words(rows: DataFrame, dpi: int = 300) -> DataFrame:
    text, scale = F.trim("text"), 72.0 / dpi
    kept = rows.withColumn("text", text).where((F.col("text") != "") & (F.col("conf") > 0) & (F.col("width") > 0) & (F.col("height") > 0) & ~F.col("text").rlike("[\n\t]") & (F.length("text") <= 40))
    x0, y0 = F.col("left") * scale, F.col("top") * scale
    return kept.select("page_num", F.concat_ws("-", "block_num", "par_num", "line_num").alias("line_key"), "word_num", "text", x0.alias("x0"), y0.alias("y0"), (x0 + F.col("width") * scale).alias("x1"), (y0 + F.col("height") * scale).alias("y1"))


def pages_dump(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=PAGES_SCHEMA, multiLine=True)


def split_response(texts: DataFrame, expected: str = "expected") -> DataFrame:
    """(id, page, text): one OCR answer over several images, at its separators or in equal parts."""
    has = F.col("text").rlike(SEPARATOR)
    # What begins with a separator keeps all of it but its first character.
    marked = F.split(F.regexp_replace("text", f"({SEPARATOR})", "\x00$1"), "\x00")
    cut = F.transform(marked, lambda t, n: F.trim(F.when(n > 0, F.substring(t, 2, 1 << 30)).otherwise(t)))
    lines = F.split(F.trim("text"), "\n")
    per = F.greatest(F.lit(1), F.floor(F.size(lines) / F.greatest(F.col(expected), F.lit(1)))).cast("int")
    last = lambda n: F.when(n == F.col(expected) - 1, F.greatest(F.size(lines) - n * per, F.lit(0))).otherwise(per)
    equal = F.transform(F.sequence(F.lit(0), F.col(expected) - 1), lambda n: F.trim(F.array_join(F.slice(lines, n * per + 1, last(n)), "\n")))
    parts = F.when(has, F.transform(F.sequence(F.lit(0), F.col(expected) - 1), lambda n: F.coalesce(F.get(cut, n), F.lit("")))).otherwise(equal)
    return texts.select("id", F.posexplode(parts).alias("page", "text"))


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """Page texts of one engine, or of another where the first has fewer than ten words."""
    both = first.join(second.withColumnRenamed("text", "_second"), ["doc_id", "page"], "left")
    few = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"(?U)\s+"), lambda w: w != "")) < WORDS_NEEDED
    return both.withColumn("text", F.when(few, F.coalesce("_second", "text")).otherwise(F.col("text"))).drop("_second")
