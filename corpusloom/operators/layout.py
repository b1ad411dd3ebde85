"""From text to words, lines, paragraphs and chapters, as windows over ordered rows.

Tables are keyed by ``doc_id``; words are ordered by ``idx``, lines by ``line``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

LINE_HEIGHT, PARAGRAPH_GAP, CHARACTER, SPACE = 18.0, 54.0, 10, 5
SAME_LINE = 8
#: Words of a line that are one row at most.
PIECE = 64
HADITH = r"(?U)(?:حديث\s*رقم|باب\s+\d+|رقم\s*\d+)"
AYAH_CLOSE = "[\ufefe\ufd3e]"
AYAH_ANY = "[\ufefd\ufefe\ufd3e\ufd3f]"
GAP_TIMES, GAP_MORE = 1.5, 6.0


def text_lines(pages: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """(doc_id, page, keep, raw, line_text, y, para_start): the lines of page texts that hold words.

    A line is 18 points high, an empty one 54 and begins a paragraph with the next. Texts are
    dealt by document once; the windows of this and the next steps need no further exchange.
    """
    raw = pages.select("doc_id", "page", *keep, text).repartition("doc_id").select("doc_id", "page", *keep, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("raw", "line_text"))
    raw = raw.withColumn("line_text", F.trim(T.without_markup(F.col("line_text"))))
    order = Window.partitionBy("doc_id", "page").orderBy("raw")
    height = F.when(F.col("line_text") == "", PARAGRAPH_GAP).otherwise(LINE_HEIGHT)
    raw = raw.withColumn("y", F.sum(height).over(order.rowsBetween(Window.unboundedPreceding, 0)) - height)
    raw = raw.withColumn("para_start", F.coalesce(F.lag(F.col("line_text") == "").over(order), F.lit(False)))
    return raw.where("line_text <> ''")


def text_rows(pages: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """(doc_id, page, keep, raw, y, para_start, words, n, from_idx, line): ``text_lines`` with their words as one array.

    ``from_idx`` is the index of the first word in its document. No row is a word: nothing of a word's own is shuffled or sorted.
    """
    own = text_lines(pages, text, *keep).select("doc_id", "page", *keep, "raw", "y", "para_start", T.words(F.col("line_text")).alias("words")).withColumn("n", F.size("words"))
    order = Window.partitionBy("doc_id").orderBy("page", "raw").rowsBetween(Window.unboundedPreceding, 0)
    # Lines without words are left out behind the window: a filter ahead of it would cut the words again, a generator would lose the order.
    own = own.withColumn("from_idx", (F.sum("n").over(order) - F.col("n")).cast("int")).withColumn("line", F.count(F.when(F.col("n") > 0, 1)).over(order) - 1)
    return own.where("n > 0")


def row_lines(rows: DataFrame, *keep: str) -> DataFrame:
    """``lines`` of ``text_rows``: each row is a line, for texts are laid out with lines at least eight points apart."""
    bottom = F.col("y") + LINE_HEIGHT
    return rows.select("doc_id", "line", "raw", F.array_join("words", " ").alias("line_text"), "from_idx", (F.col("from_idx") + F.col("n") - 1).alias("to_idx"), F.col("n").cast("long").alias("n_words"), "page", F.col("y").alias("top"), bottom.alias("bottom"), F.col("n").cast("long").alias("n_boxes"), F.col("y").alias("first_top"), "para_start", *keep)


def marked(line: Column) -> Column:
    """A line's text where paragraphs and the way of splitting may depend on it, else its leading digits or a dash.

    What ``number_paragraphs``, ``strategy`` and the splits look for has a letter from the Arabic block on or a colon at the
    end; a match that runs on into the next line takes no more of that than the number it begins with.
    """
    return F.when((T.beyond_ascii(line) & line.rlike(r"[\x{0600}-\x{10FFFF}]")) | line.endswith(":"), line).otherwise(F.coalesce(F.nullif(F.regexp_extract(line, r"^\d+", 0), F.lit("")), F.lit("-")))


def row_parts(rows: DataFrame) -> DataFrame:
    """``text_rows`` as ``row_pieces`` has them, each line whole: with its box instead of ``y``."""
    own = rows.withColumns({"x0": F.lit(0.0), "y0": F.col("y"), "y1": F.col("y") + LINE_HEIGHT})
    return own.withColumn("x1", (_letters(F.col("words")) * CHARACTER + (F.col("n") - 1) * SPACE).cast("double"))


def _letters(words: Column) -> Column:
    return F.length(F.array_join(words, ""))


def row_pieces(rows: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, page, keep, line, para_start, from_idx, n, words, x0, y0, x1, y1): ``text_rows`` cut into runs of up to ``PIECE`` words with their box."""
    size = F.lit(PIECE)

    def cut(words: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / size).cast("int")), lambda k: F.slice(words, k * size + 1, size))
        ahead = lambda sizes, k: F.aggregate(F.slice(sizes, F.lit(1), k), F.lit(0), lambda a, b: a + b)
        return T.let(parts, lambda own: T.let(F.transform(own, _letters), lambda sizes: F.transform(own, lambda p, k: F.struct(p.alias("words"), ahead(sizes, k).alias("ahead")))))

    whole = F.array(F.struct(F.col("words").alias("words"), F.lit(0).alias("ahead")))
    own = rows.select("doc_id", "page", *keep, "line", "y", "para_start", "from_idx", F.posexplode(F.when(F.col("n") <= size, whole).otherwise(cut(F.col("words")))).alias("no", "piece"))
    own = own.select("doc_id", "page", *keep, "line", (F.col("para_start") & (F.col("no") == 0)).alias("para_start"), (F.col("from_idx") + F.col("no") * size).alias("from_idx"), F.size("piece.words").alias("n"), F.col("piece.words").alias("words"), (F.col("piece.ahead") * CHARACTER + F.col("no") * size * SPACE).cast("double").alias("x0"), F.col("y").alias("y0"))
    return own.withColumn("x1", F.col("x0") + _letters(F.col("words")) * CHARACTER + (F.col("n") - 1) * SPACE).withColumn("y1", F.col("y0") + LINE_HEIGHT)


def part_of_piece(pieces: DataFrame, low: Column, high: Column) -> DataFrame:
    """``row_pieces`` with the words [low, high) of each alone; bounds count within the document."""
    skipped = low - F.col("from_idx")
    whole = (skipped == 0) & (high - low == F.col("n"))
    x0 = F.col("x0") + F.when(skipped > 0, _letters(F.slice("words", F.lit(1), skipped)) * CHARACTER + skipped * SPACE).otherwise(0)
    own = pieces.withColumns({"from_idx": low, "n": high - low, "words": F.when(whole, F.col("words")).otherwise(F.slice("words", skipped + 1, high - low)), "x0": x0})
    return own.withColumn("x1", F.col("x0") + _letters(F.col("words")) * CHARACTER + (F.col("n") - 1) * SPACE)


def text_words(pages: DataFrame, text: str = "text") -> DataFrame:
    """Words with a synthetic layout: doc_id, idx, page, text, x0, y0, x1, y1, para_start."""
    own = row_pieces(text_rows(pages, text))
    placed = T.let(F.col("words"), lambda words: F.transform(words, lambda w, k: F.struct(w.alias("text"), (_letters(F.slice(words, F.lit(1), k)) * CHARACTER + k * SPACE).alias("x"))))
    own = own.select("doc_id", "from_idx", "page", "x0", "y0", "y1", "para_start", F.posexplode(placed).alias("pos", "word"))
    x0 = F.col("x0") + F.col("word.x")
    return own.select("doc_id", (F.col("from_idx") + F.col("pos")).alias("idx"), "page", F.col("word.text").alias("text"), x0.alias("x0"), "y0", (x0 + F.length("word.text") * CHARACTER).alias("x1"), "y1", (F.col("para_start") & (F.col("pos") == 0)).alias("para_start"))


def page_words(text: Column) -> Column:
    """The words of a page text, without markup, in order."""
    return F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: T.words(T.without_markup(line))))


def word_index(words: DataFrame, *order: str) -> DataFrame:
    """``idx``: the running number of a word in its document."""
    return words.withColumn("idx", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1)


def number_lines(words: DataFrame) -> DataFrame:
    """``line``: words of one page whose tops differ by less than eight points in turn."""
    order = Window.partitionBy("doc_id").orderBy("idx")
    same = (F.lag("page").over(order) == F.col("page")) & (F.abs(F.col("y0") - F.lag("y0").over(order)) < SAME_LINE)
    new = F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)
    return words.withColumn("line", F.sum(new).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)


def lines(words: DataFrame) -> DataFrame:
    """One row per line: its words joined, first and last index, box, count, and flags."""
    first = F.col("idx") == F.min("idx").over(Window.partitionBy("doc_id", "line"))
    own = words.withColumn("first", first)
    return own.groupBy("doc_id", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda w: w["text"]), " ").alias("line_text"),
        F.min("idx").alias("from_idx"), F.max("idx").alias("to_idx"), F.count("*").alias("n_words"), F.min("page").alias("page"),
        F.min("y0").alias("top"), F.max("y1").alias("bottom"), F.count("y0").alias("n_boxes"),
        F.max(F.when(F.col("first"), F.col("y0"))).alias("first_top"), F.bool_or(F.col("first") & F.coalesce("para_start", F.lit(False))).alias("para_start"),
    )



def median_line_height(own: DataFrame) -> DataFrame:
    """``median_height``: the upper median of the heights of lines with two boxes or more."""
    heights = F.array_sort(F.collect_list(F.when(F.col("n_boxes") >= 2, F.col("bottom") - F.col("top"))))
    return own.groupBy("doc_id").agg(heights.alias("h")).select("doc_id", F.get("h", (F.floor(F.size("h") / 2)).cast("int")).alias("median_height"))


def number_paragraphs(own: DataFrame, every_line: bool = False) -> DataFrame:
    """``paragraph``: lines between blank lines, colon headings and large gaps; or each line its own."""
    if every_line:
        return own.withColumn("paragraph", F.row_number().over(Window.partitionBy("doc_id").orderBy("line")) - 1)
    order = Window.partitionBy("doc_id").orderBy("line")
    before = F.when(F.lag("first_top").over(order).isNotNull(), F.lag("bottom").over(order))
    gap = F.col("first_top") - before
    placed = own.join(median_line_height(own), "doc_id", "left").withColumn("gap", gap)
    large = (F.col("median_height") > 0) & (F.col("gap") > F.col("median_height") * GAP_TIMES + GAP_MORE)
    new = F.when(F.col("para_start") | T.is_colon_heading(F.col("line_text")) | F.coalesce(large, F.lit(False)), 1).otherwise(0)
    first = F.row_number().over(order) == 1
    return placed.withColumn("new", F.when(first, 0).otherwise(new)).withColumn("paragraph", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new", "gap", "median_height")


def chapters(own: DataFrame) -> DataFrame:
    """``chapter``: the last chapter heading at or before each line."""
    order = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumn("chapter", F.last(T.chapter(F.col("line_text")), ignorenulls=True).over(order))


def strategy(own: DataFrame) -> DataFrame:
    """How each document is split: hadith, quran, fiqh or fallback."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "line_text"))), lambda x: x["line_text"]), " ")
    marks = own.groupBy("doc_id").agg(text.alias("t"), F.count_if(F.trim("line_text").endswith(":")).alias("colons"))
    kind = F.when(F.col("t").rlike(HADITH), "hadith").when(F.col("t").rlike(AYAH_ANY), "quran").when(F.col("colons") >= 3, "fiqh").otherwise("fallback")
    return marks.select("doc_id", kind.alias("strategy"))


def split_before(own: DataFrame, pattern: str = HADITH) -> DataFrame:
    """``part``: a new one at each marked line but the first marked one."""
    order = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumn("part", F.greatest(F.lit(1), F.sum(F.col("line_text").rlike(pattern).cast("int")).over(order)) - 1)


def split_after(own: DataFrame, pattern: str = AYAH_CLOSE) -> DataFrame:
    """``part``: a new one after each marked line."""
    order = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return own.withColumn("part", F.coalesce(F.sum(F.col("line_text").rlike(pattern).cast("int")).over(order), F.lit(0)))
