"""Passages: packing paragraphs into overlapping chunks, and what each chunk carries.

Packing depends on where the last chunk ended, so it runs in one task per document, but over
lengths alone: (start, end) ranges of word indexes come out, and texts, boxes and offsets are
joined back by the engine.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import ids
from corpusloom.functions import text as T
from corpusloom.operators import layout
from corpusloom.sources.store import stored

CEILING, TARGET, LEAST, OVERLAP, SHORT = 900, 420, 200, 63, 150

RANGES = "doc_id long, chunk_no int, from_idx int, to_idx int"


def pack(lengths: list[int]) -> list[tuple[int, int]]:
    """Chunks as ranges of paragraphs [from, to), each found by binary search over running totals.

    A chunk takes what fits the target, at least one paragraph. A chunk of ``LEAST`` words or
    more is overlapped by the next: that begins with the paragraph ahead of the shortest tail of
    ``OVERLAP`` words, but never with the same paragraph again.
    """
    total = [0, *accumulate(lengths)]
    out, start = [], 0
    while start < len(lengths):
        fits = bisect_right(total, total[start] + TARGET) - 1
        out.append((start, max(fits, start + 1)))
        if fits == len(lengths):
            break
        if fits > start and total[fits] - total[start] >= LEAST:
            tail = bisect_right(total, total[fits] - OVERLAP) - 1
            start = max(tail - 1, start + 1)
        else:
            start = out[-1][1]
    return out


def sentence_pieces(low: int, high: int, ends: list[int]) -> list[tuple[int, int]]:
    """A long range of words [low, high) cut at the first sentence end from the target on."""
    out, start = [], low
    for end in ends:
        if low <= end < high and end - start + 1 >= TARGET:
            out.append((start, end + 1))
            start = end + 1
    if start < high:
        out.append((start, high))
    return out


def merged(pieces: list[tuple[int, int]], ends: set[int]) -> list[list[tuple[int, int]]]:
    """Short or unfinished pieces joined with what follows, up to the target."""
    out: list[list[tuple[int, int]]] = []
    for piece in pieces:
        if out:
            size = sum(b - a for a, b in out[-1])
            unfinished = size < SHORT or out[-1][-1][1] - 1 not in ends
            if unfinished and size + piece[1] - piece[0] <= TARGET:
                out[-1].append(piece)
                continue
        out.append([piece])
    return out


def chunk_ranges(parts: list[tuple[int, int]], ends: list[int], packed: bool, repeat: bool = False) -> list[tuple[int, int, int]]:
    """(chunk, from, to) word ranges of one document from its paragraphs or marked parts.

    ``repeat`` keeps the words of an overlap twice when chunks that overlap are merged.
    """
    pieces: list[tuple[int, int]] = []
    if packed:
        for first, last in pack([b - a for a, b in parts]):
            low, high = parts[first][0], parts[last - 1][1]
            pieces += sentence_pieces(low, high, ends) if last == first + 1 and high - low > TARGET else [(low, high)]
    else:
        pieces = parts
    pieces = [(k, min(k + CEILING, b)) for a, b in pieces for k in range(a, b, CEILING)]
    out = []
    for n, group in enumerate(merged(pieces, set(ends))):
        at = group[0][0]
        for a, b in group:
            if repeat or at < b:  # nothing is left of a piece that lies inside the ones before it
                out.append((n, a if repeat else max(a, at), b))
            at = max(at, b)
    return out


def _chunked(repeat: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r.doc_id, n, a, b) for r in batch.itertuples() for n, a, b in chunk_ranges([(int(p["a"]), int(p["b"])) for p in r.parts], [int(e) for e in r.ends], r.packed, repeat)]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "from_idx", "to_idx"])

    return run


def _line_ranges(own: DataFrame, ends: DataFrame, every_line: bool, repeat: bool) -> DataFrame:
    """The word ranges of chunks from lines (``layout.lines``) and the places of words that end a sentence (doc_id, ends)."""
    own = layout.number_paragraphs(own, every_line)
    own = layout.split_before(own).withColumnRenamed("part", "hadith")
    own = layout.split_after(own).withColumnRenamed("part", "ayah")
    own = own.join(layout.strategy(own), "doc_id")
    part = F.when(F.col("strategy") == "hadith", F.col("hadith")).when(F.col("strategy") == "quran", F.col("ayah")).otherwise(F.col("paragraph"))
    parts = own.groupBy("doc_id", part.alias("part")).agg(F.min("from_idx").alias("a"), (F.max("to_idx") + 1).alias("b"), F.first("strategy").alias("strategy"))
    per_doc = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("parts"), (~F.first("strategy").isin("hadith", "quran")).alias("packed"))
    return per_doc.join(ends, "doc_id", "left").select("doc_id", "parts", F.coalesce("ends", F.array().cast("array<int>")).alias("ends"), "packed").mapInPandas(_chunked(repeat), RANGES)


def ranges(words: DataFrame, every_line: bool = False, repeat: bool = False) -> DataFrame:
    """The word ranges [from_idx, to_idx) of the chunks of every document."""
    own = stored(layout.lines(words if "line" in words.columns else layout.number_lines(words)))
    ends = words.where(T.ends_sentence(F.col("text"))).groupBy("doc_id").agg(F.array_sort(F.collect_list("idx")).alias("ends"))
    return _line_ranges(own, ends, every_line, repeat)


def row_ranges(rows: DataFrame, every_line: bool = False) -> DataFrame:
    """``ranges`` of ``layout.text_rows``: what decides them is stored without the text."""
    at = F.filter(F.transform("words", lambda w, k: F.when(T.ends_sentence(w), F.col("from_idx") + k)), lambda x: x.isNotNull())
    lines = layout.row_lines(rows.withColumn("own", at), "own").drop("raw", "n_words", "page")
    own = stored(lines.withColumn("line_text", layout.marked(F.col("line_text"))))
    ends = own.select("doc_id", "from_idx", "own").groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("from_idx", "own"))), lambda x: x["own"])).alias("ends"))
    return _line_ranges(own.drop("own"), ends, every_line, False)


def _placed(own: DataFrame) -> DataFrame:
    """``at``: where a word or run of words (text or size) begins in the text of its chunk."""
    order = Window.partitionBy("doc_id", "chunk_no").orderBy("idx")
    size = (F.col("size") if "size" in own.columns else F.length("text")) + 1
    return own.withColumn("at", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size)


def chunk_words(words: DataFrame, own_ranges: DataFrame) -> DataFrame:
    """The words of each chunk, with their place in its text."""
    wide = own_ranges.select("doc_id", "chunk_no", F.explode(F.sequence("from_idx", F.col("to_idx") - 1)).alias("idx"))
    return _placed(wide.join(words, ["doc_id", "idx"]))


def _as_text(pieces: DataFrame) -> DataFrame:
    """Runs of words as ``chunk_words`` has words: idx, text."""
    return pieces.withColumn("text", F.array_join("words", " ")).withColumnRenamed("from_idx", "idx").drop("words", "para_start")


def chunk_parts(rows: DataFrame, own_ranges: DataFrame) -> DataFrame:
    """What each chunk has of each line of ``layout.text_rows``: doc_id, chunk_no, idx, n, text, page, line, box.

    Lines stay where their document was dealt; the ranges, a few numbers each, come to them.
    """
    wanted = own_ranges.select(F.col("doc_id").alias("_doc"), "chunk_no", F.col("from_idx").alias("_a"), F.col("to_idx").alias("_b"))
    end = F.col("from_idx") + F.col("n")
    met = layout.row_parts(rows).join(wanted, (F.col("doc_id") == F.col("_doc")) & (F.col("_a") < end) & (F.col("_b") > F.col("from_idx")))
    met = met.withColumn("_low", F.greatest("from_idx", "_a")).withColumn("_high", F.least(end, F.col("_b")))
    return _as_text(layout.part_of_piece(met, F.col("_low"), F.col("_high")).drop("_doc", "_a", "_b", "_low", "_high"))


def fixed_pieces(pieces: DataFrame, size: int = CEILING) -> DataFrame:
    """``chunk_pieces`` with slices of ``size`` words as chunks; nothing is shuffled."""
    own = pieces.select("*", F.explode(F.sequence(F.floor(F.col("from_idx") / size).cast("int"), F.floor((F.col("from_idx") + F.col("n") - 1) / size).cast("int"))).alias("chunk_no"))
    low, high = F.greatest(F.col("from_idx"), F.col("chunk_no") * size), F.least(F.col("from_idx") + F.col("n"), (F.col("chunk_no") + 1) * size)
    return _as_text(layout.part_of_piece(own.withColumn("_low", low).withColumn("_high", high), F.col("_low"), F.col("_high")).drop("_low", "_high"))


def whole_pieces(pieces: DataFrame) -> DataFrame:
    """``chunk_pieces`` with whole documents as chunks."""
    return _placed(_as_text(pieces.withColumn("chunk_no", F.lit(0))).withColumn("size", F.length("text")).drop("text"))


def page_offsets(own: DataFrame) -> DataFrame:
    """Character ranges of a chunk by page: runs of one page, ends inclusive, first printed number."""
    own = own if "size" in own.columns else own.withColumn("size", F.length("text"))
    order = Window.partitionBy("doc_id", "chunk_no").orderBy("idx")
    new = F.when(F.lag("page").over(order).eqNullSafe(F.col("page")), 0).otherwise(1)
    runs = own.withColumn("run", F.sum(new).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    printed = F.min(F.when(F.col("printed").isNotNull(), F.struct("idx", "printed")))["printed"] if "printed" in own.columns else F.lit(None).cast("int")
    last = F.max("at") + F.max_by("size", "idx")
    end = Window.partitionBy("doc_id", "chunk_no").orderBy("run")
    found = runs.groupBy("doc_id", "chunk_no", "run").agg(F.min("page").alias("page"), F.min("at").alias("start_char"), last.alias("stop"), printed.alias("printed_page_num"))
    # But for the last one, a range takes in the space after it.
    return found.withColumn("end_char", F.when(F.lead("run").over(end).isNull(), F.col("stop") - 1).otherwise(F.col("stop"))).drop("stop", "run")


def page_boxes(own: DataFrame) -> DataFrame:
    """One box per chunk and page."""
    return own.where("x0 IS NOT NULL").groupBy("doc_id", "chunk_no", "page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def _assembled(own: DataFrame, own_lines: DataFrame) -> DataFrame:
    """Passages from words or runs of words, and the lines of their documents."""
    texts = own.groupBy("doc_id", "chunk_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda w: w["text"]), " ").alias("text"),
        F.sum("n").alias("token_count"), F.min_by("page", "idx").alias("page_start"), F.max_by("page", "idx").alias("page_end"), F.min_by("line", "idx").alias("line"),
    )
    boxes = page_boxes(own).groupBy("doc_id", "chunk_no").agg(F.array_sort(F.collect_list(F.struct("page", F.array("x0", "y0", "x1", "y1").alias("bbox")))).alias("page_bboxes"))
    sizes = own.select("doc_id", "chunk_no", "idx", "page", *[c for c in own.columns if c == "printed"], F.length("text").alias("size"))
    offsets = page_offsets(_placed(sizes)).groupBy("doc_id", "chunk_no").agg(F.array_sort(F.collect_list(F.struct("start_char", "end_char", "page", "printed_page_num"))).alias("page_offsets"))
    named = layout.chapters(own_lines).select("doc_id", "line", "chapter")
    out = texts.join(boxes, ["doc_id", "chunk_no"], "left").join(offsets, ["doc_id", "chunk_no"], "left").join(named, ["doc_id", "line"], "left")
    return out.withColumn("bbox", F.get("page_bboxes", F.lit(0))["bbox"]).withColumn("id", ids.chunk_id(F.col("text"), F.col("page_start"), F.col("page_end"))).drop("line")


def chunks(words: DataFrame, every_line: bool = False, repeat: bool = False) -> DataFrame:
    """Passages with their id, text, pages, boxes, offsets and chapter."""
    # Lines, ranges and chapters are all made from the numbered words, three aggregations from the chunks' words.
    words = stored(layout.number_lines(words) if "line" not in words.columns else words)
    own = stored(chunk_words(words, ranges(words, every_line, repeat)).withColumn("n", F.lit(1)))
    return _assembled(own, layout.lines(words))


def _with_numbers(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """``printed`` of the page of each line. Bounds instead of equal pages: the lines stay where their document was dealt."""
    own = numbers.groupBy(F.col("doc_id").alias("_doc"), F.col("page").alias("_page")).agg(F.min("printed").alias("printed"))
    same = (F.col("page") <= F.col("_page")) & (F.col("page") >= F.col("_page")) | (F.col("page").isNull() & F.col("_page").isNull())
    return rows.join(own, (F.col("doc_id") == F.col("_doc")) & same, "left").drop("_doc", "_page")


def text_chunks(pages: DataFrame, every_line: bool = False, *keep: str, numbers: DataFrame | None = None) -> DataFrame:
    """``chunks`` of page texts (doc_id, page, text), by lines: no row is a word.

    ``numbers`` are printed page numbers (doc_id, page, printed), where the pages have no such column to keep. The text is
    dealt by document twice, for the ranges and for the passages, and neither stored nor sorted by chunk.
    """
    rows = layout.text_rows(pages, "text", *keep)
    if numbers is not None:
        rows, keep = _with_numbers(rows, numbers), (*keep, "printed")
    order = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    titled = rows.withColumn("chapter", F.last(T.chapter(F.array_join("words", " ")), ignorenulls=True).over(order))
    own = chunk_parts(titled, row_ranges(layout.text_rows(pages), every_line))
    # Words of a document are in the order of its pages, so a page is one run of them.
    first = lambda c: F.min_by(c, "idx").alias(c)
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda w: w["text"]), " ").alias("text")
    printed = F.min(F.when(F.col("printed").isNotNull(), F.struct("idx", "printed")))["printed"] if "printed" in keep else F.first(F.lit(None).cast("int"))
    by_page = own.groupBy("doc_id", "chunk_no", "page").agg(
        said, F.sum("n").alias("n"), F.sum(F.length("text") + 1).alias("size"), first("chapter"), printed.alias("printed_page_num"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.min("idx").alias("idx"),
    )
    place = Window.partitionBy("doc_id", "chunk_no").orderBy("idx")
    placed = by_page.withColumn("start_char", F.sum("size").over(place.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    # But for the last one, a range takes in the space after it.
    placed = placed.withColumn("end_char", F.col("start_char") + F.col("size") - F.when(F.lead("idx").over(place).isNull(), 2).otherwise(1))
    boxes = F.array_sort(F.collect_list(F.struct("page", F.array("x0", "y0", "x1", "y1").alias("bbox"))))
    offsets = F.array_sort(F.collect_list(F.struct("start_char", "end_char", "page", "printed_page_num")))
    out = placed.groupBy("doc_id", "chunk_no").agg(
        said, F.sum("n").alias("token_count"), F.min_by("page", "idx").alias("page_start"), F.max_by("page", "idx").alias("page_end"),
        boxes.alias("page_bboxes"), offsets.alias("page_offsets"), first("chapter"),
    )
    return out.withColumn("bbox", F.get("page_bboxes", F.lit(0))["bbox"]).withColumn("id", ids.chunk_id(F.col("text"), F.col("page_start"), F.col("page_end")))


def fixed_chunks(words: DataFrame, size: int = CEILING) -> DataFrame:
    """Slices of ``size`` words."""
    return words.withColumn("chunk_no", F.floor(F.col("idx") / size).cast("int"))


def fixed_slices(texts: DataFrame, size: int = CEILING) -> DataFrame:
    """(doc_id, chunk_no, token_count, text): slices of ``size`` words of whole texts (doc_id, text).

    Each text is cut in its own row; nothing is shuffled.
    """
    # The words are bound once inside the generator; as a column of their own they would be made again for the filter and the slices.
    none = F.array().cast("array<array<string>>")
    cut = T.let(layout.page_words(F.col("text")), lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / size).cast("int")), lambda n: F.slice(w, n * size + 1, F.lit(size)))).otherwise(none))
    own = texts.select("doc_id", F.posexplode(cut).alias("chunk_no", "part"))
    return own.select("doc_id", "chunk_no", F.size("part").cast("long").alias("token_count"), F.array_join("part", " ").alias("text"))


def chunk_statistics(own: DataFrame) -> DataFrame:
    """Number, total, mean and largest size of the chunks of each document."""
    return own.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum("token_count").alias("n_tokens"), F.round(F.avg("token_count"), 4).alias("avg_tokens"), F.max("token_count").alias("max_tokens"))


def page_statistics(words: DataFrame) -> DataFrame:
    """Number of pages with words, and total, mean and largest number of words of a page, of each document."""
    return words.groupBy("doc_id", "page").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum("n").alias("n_words"), F.round(F.avg("n"), 4).alias("avg_words"), F.max("n").alias("max_words"))
