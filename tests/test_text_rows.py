"""Texts are laid out and cut into chunks by lines and runs of words, with the results that words one by one give."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import layout, segment


def pages_of(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeß") for _ in range(rng.randrange(1, 9))) + rng.choice(["", "", "", ".", ":"])
    line = lambda n: " ".join(word() for _ in range(n))
    sizes = [0, 1, 3, 12, 63, 64, 65, 200, 1000]
    rows = [(d, p, "\n".join(line(rng.choice(sizes)) for _ in range(rng.randrange(1, 12))), rng.choice([None, p + 10])) for d in range(6) for p in range(1, 4)]
    return spark.createDataFrame([*rows, (6, 1, None, 1), (7, 1, " \n \n", 2), (8, 1, " \nHead:\nx", 3)], "doc_id long, page int, text string, printed int")


def test_rows_give_what_words_give(spark):
    pages = pages_of(spark)
    words = layout.number_lines(layout.text_words(pages)).cache()
    rows = layout.text_rows(pages).cache()
    assert rows.count() == words.select("doc_id", "line").distinct().count()
    got = sorted(map(tuple, layout.lines(words).select(*(own := [c for c in layout.row_lines(rows).columns if c != "raw"])).collect()))
    assert got == sorted(map(tuple, layout.row_lines(rows).select(*own).collect()))
    # Against a plain program: places of words in lines.
    for (doc, page), own in {(r["doc_id"], r["page"]): r["text"] for r in pages.where("doc_id < 6").collect()}.items():
        lines = [layout_line.split() for layout_line in own.split("\n")]
        expected = [(w, float(sum(len(v) * 10 + 5 for v in ws[:k]))) for ws in lines for k, w in enumerate(ws)]
        assert [(r["text"], r["x0"]) for r in words.where((F.col("doc_id") == doc) & (F.col("page") == page)).orderBy("idx").collect()] == expected


def test_chunks_of_texts(spark):
    pages = pages_of(spark)
    words = layout.text_words(pages).join(pages.select("doc_id", "page", "printed"), ["doc_id", "page"])
    for every_line in (False, True):
        made = segment.text_chunks(pages, every_line, "printed")
        own, other = (sorted(map(str, x.select(*sorted(made.columns)).collect())) for x in (made, segment.chunks(words, every_line)))
        assert own == other and len(own) > 20
    boxes = segment.page_boxes(segment.fixed_pieces(layout.row_pieces(layout.text_rows(pages)), 100))
    other = segment.page_boxes(segment.fixed_chunks(layout.text_words(pages), 100))
    assert sorted(map(tuple, boxes.collect())) == sorted(map(tuple, other.select(*boxes.columns).collect()))


def test_words_are_not_sorted(spark):
    plan = layout.text_words(pages_of(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count(" Sort [") == 1 and "pos" not in plan.split(" Sort [")[1].split("]")[0], plan


def test_a_piece_inside_another_adds_no_words():
    # The second chunk, [100, 300), lies in the first.
    parts = [(0, 100), (100, 300), (300, 800)]
    assert segment.chunk_ranges(parts, [], True)[0] == (0, 0, 300)
    assert all(a < b for _, a, b in segment.chunk_ranges(parts, [], True))


def test_text_is_dealt_by_document_alone(spark):
    plan = segment.text_chunks(pages_of(spark))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and "hashpartitioning(doc_id#" in plan.replace(" ", "")
    assert not [line for line in plan.splitlines() if "Exchange" in line and "chunk_no" in line], plan


def test_ranges_without_the_text(spark):
    """A mark may run on into the number that the next line begins with."""
    lines = ["one two three.", "باب", "12 more words", "رقم", "7", "a head:", "text ﴾one﴿ and", "other ﴿", "last one"]
    pages = spark.createDataFrame([(d, 1, "\n".join(lines[d:] + lines[:d])) for d in range(len(lines))] + [(20, 1, "x\nباب\nmore"), (21, 1, "x:\ny:\nz:\n")], "doc_id long, page int, text string")
    rows = layout.text_rows(pages).cache()
    own = layout.row_lines(rows)
    short = own.withColumn("line_text", layout.marked(F.col("line_text")))
    for made in (layout.strategy, layout.number_paragraphs, layout.split_before, layout.split_after):
        one, other = (sorted(map(str, made(x).drop("line_text").collect())) for x in (own, short))
        assert one == other, made
    assert {r["strategy"] for r in layout.strategy(short).collect()} >= {"hadith", "fiqh"}
    made = segment.text_chunks(pages)
    other = segment.chunks(layout.text_words(pages))
    assert sorted(map(str, made.select(*sorted(made.columns)).collect())) == sorted(map(str, other.select(*sorted(made.columns)).collect()))
