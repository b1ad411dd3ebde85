"""Printed page numbers: found in footers, checked, and filled in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

# Digits of other scripts, words of a printing date, and a number that stands alone.
DIGITS_FROM, DIGITS_TO = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"
DATE_WORDS = ["سنة", "عام", "طبع", "طبعة", "مـ"]
STANDALONE = r"[\s\-–—\[(]([0-9]{1,4})[\s\-–—\])]"


def footer_number(text: Column) -> Column:
    """The page number printed in the last five or first two lines of a page, or null.

    A number that occurs more than once wins (of several the first seen), else the last.
    """
    own = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r]"), lambda x: F.trim(x)), lambda x: x != "")
    # The lines are cut once, not for each use.
    edge = T.let(own, lambda rows: F.concat(F.when(F.size(rows) > 5, F.slice(rows, -5, 5)).otherwise(rows), F.slice(rows, 1, 2)))

    def plain(line: Column) -> Column:
        dated = F.lit(False)
        for word in DATE_WORDS:
            dated = dated | F.contains(line, F.lit(word))
        return (F.size(T.words(line)) <= 4) & ~dated

    found = F.flatten(F.transform(F.filter(edge, plain), lambda x: F.regexp_extract_all(F.concat(F.lit(" "), F.translate(x, DIGITS_FROM, DIGITS_TO), F.lit(" ")), F.lit(STANDALONE), F.lit(1))))
    numbers = F.filter(F.transform(found, lambda n: n.cast("int")), lambda n: n >= 1)

    def chosen(own: Column) -> Column:
        repeats = F.transform(F.array_distinct(own), lambda n: F.struct(F.size(F.filter(own, lambda m: m == n)).alias("n"), (-F.array_position(own, n)).alias("first"), n.alias("v")))
        return T.let(F.array_max(repeats), lambda most: F.when(most["n"] > 1, most["v"]).otherwise(F.when(F.size(own) > 0, F.element_at(own, -1))))

    return T.let(numbers, chosen)


def modal_offset(pages: DataFrame) -> DataFrame:
    """(doc_id, offset, reliable): the commonest printed minus physical number; ties go to the first seen."""
    known = pages.where("printed IS NOT NULL").withColumn("offset", F.col("printed") - F.col("physical"))
    counts = known.groupBy("doc_id", "offset").agg(F.count("*").alias("n"), F.min("physical").alias("first"))
    best = Window.partitionBy("doc_id").orderBy(F.desc("n"), "first", "offset")
    total = F.sum("n").over(Window.partitionBy("doc_id"))
    ranked = counts.withColumn("place", F.row_number().over(best)).withColumn("total", total)
    return ranked.where("place = 1").select("doc_id", "offset", (F.col("n") >= F.greatest(F.lit(1), F.floor(F.col("total") * 0.8))).alias("reliable"))


def impute(pages: DataFrame) -> DataFrame:
    """``printed`` filled in by the modal offset where half of the pages have it and it is reliable."""
    own = Window.partitionBy("doc_id")
    with_counts = pages.withColumn("n", F.count("*").over(own)).withColumn("found", F.count("printed").over(own))
    joined = with_counts.join(modal_offset(pages), "doc_id", "left")
    able = (F.col("found") > 0) & (F.col("found") >= F.greatest(F.lit(1.0), F.col("n") * 0.5)) & F.coalesce("reliable", F.lit(False))
    filled = F.when(F.col("printed").isNull() & able, F.col("physical") + F.col("offset"))
    return joined.select(*pages.columns[: pages.columns.index("printed")], F.coalesce("printed", filled).alias("printed"), filled.isNotNull().alias("imputed"))


def violations(pages: DataFrame) -> DataFrame:
    """(doc_id, violations): printed numbers below the last one before them."""
    order = Window.partitionBy("doc_id").orderBy("physical", "printed")
    known = pages.where("printed IS NOT NULL").withColumn("down", F.col("printed") < F.lag("printed").over(order))
    return known.groupBy("doc_id").agg(F.count_if("down").alias("violations"))


def report(pages: DataFrame, min_rate: float = 0.5, max_violation_rate: float = 0.1) -> DataFrame:
    """The quality of the page numbers of each document, and whether it suffices."""
    total = pages.groupBy("doc_id").agg(F.count("*").alias("total"), F.count("printed").alias("extracted"))
    out = total.join(violations(pages), "doc_id", "left").join(modal_offset(pages), "doc_id", "left")
    out = out.withColumn("violations", F.coalesce("violations", F.lit(0)))
    rate = F.round(F.col("extracted") / F.col("total"), 6)
    bad = F.round(F.when(F.col("extracted") > 0, F.col("violations") / F.col("extracted")).otherwise(0.0), 6)
    return out.select("doc_id", "total", "extracted", rate.alias("extraction_rate"), "violations", bad.alias("violation_rate"), "offset", ((rate >= min_rate) & (bad <= max_violation_rate)).alias("acceptable"))


def offset_sanity(pages: DataFrame) -> DataFrame:
    """Median and deviation of the offsets, and whether more than a tenth are over five off."""
    known = pages.withColumn("o", F.col("physical") - F.col("printed"))
    medians = known.groupBy("doc_id").agg(F.median("o").alias("median_offset"), F.coalesce(F.stddev_samp("o"), F.lit(0.0)).alias("deviation"), F.count("*").alias("n"))
    off = known.join(medians.select("doc_id", "median_offset"), "doc_id").groupBy("doc_id").agg(F.count_if(F.abs(F.col("o") - F.col("median_offset")) > 5).alias("suspicious"))
    return medians.join(off, "doc_id").select("doc_id", "median_offset", F.round("deviation", 6).alias("deviation"), "suspicious", (F.col("suspicious") > F.col("n") * 0.1).alias("warn"))


def backfill(points: DataFrame, mapping: DataFrame) -> DataFrame:
    """Page numbers of stored passages replaced by printed ones: both looked up, kept where unknown."""
    start = mapping.select(F.col("doc_id"), F.col("physical").alias("page_start"), F.col("printed").alias("new_start"))
    end = mapping.select(F.col("doc_id"), F.col("physical").alias("page_end"), F.col("printed").alias("new_end"))
    out = points.join(start, ["doc_id", "page_start"], "left").join(end, ["doc_id", "page_end"], "left")
    new_start, new_end = F.coalesce("new_start", "page_start"), F.coalesce("new_end", "page_end")
    changed = ~(new_start.eqNullSafe(F.col("page_start")) & new_end.eqNullSafe(F.col("page_end")))
    others = [c for c in points.columns if c not in ("page_start", "page_end")]
    return out.select(*others, new_start.alias("page_start"), new_end.alias("page_end"), changed.alias("patched"))
