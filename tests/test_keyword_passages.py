"""The keyword leg over texts: the rows of ``keyword_leg``, with neither texts nor postings shuffled; letters counted as before."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import ranking, retrieval
from corpusloom.plans import ask, ingest, queries


def _texts():
    rng = random.Random(3)
    base = ["silver", "Silver,", "thornbush", "horn", "ÉTUDE", "etude", "كتاب", "كتابٌ", "(river)", "--", "quarrelsome"]
    spaces = [" ", "\n", " ", "　"]
    return ["".join(rng.choice(base) + rng.choice(spaces) for _ in range(rng.randint(1, 20))) for _ in range(150)] + ["", None]


def test_keyword_passages_are_those_of_the_leg(spark, monkeypatch):
    rows = [(f"p{n % 60}:{n}", text, None if n % 11 == 0 else f"t{n % 3}") for n, text in enumerate(_texts())]
    passages = spark.createDataFrame(rows, "id string, text string, tenant string").repartition(3)
    asked = [(1, "silver thornbush river", "t0"), (2, "quarrelsome étude", "t1"), (3, "كتاب silver silver", "t2"), (4, "the of", "t0"), (5, "river", None), (6, "horn etude", "t9")]
    questions = spark.createDataFrame(asked, "q long, question string, tenant string")
    words = ranking.words_of(passages)
    columns = ("q", "id", "tier", "matched", "tf", "rank")
    sorted_rows = lambda made: sorted(tuple(r[c] for c in columns) for r in made.collect())
    for scope in (None, "tenant"):
        monkeypatch.setattr(ranking, "QUESTIONS_AT_ONCE", 1000)
        wanted = sorted_rows(retrieval.keyword_leg(questions, retrieval.postings(passages.fillna("", "text"), *([scope] if scope else [])), 6, scope=scope))
        assert wanted and sorted_rows(ranking.keyword_passages(questions, passages, words, 6, scope)) == wanted
        monkeypatch.setattr(ranking, "QUESTIONS_AT_ONCE", 2)
        monkeypatch.setattr(ranking, "SCORED_AT_ONCE", 7)
        made = ranking.keyword_passages(questions, passages, words, 6, scope)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(q") == plan.count("Exchange ") == 1, plan
        assert sorted_rows(made) == wanted
    assert ranking.keyword_passages(questions.where("q = 4"), passages, words, 6, "tenant").count() == 0


def test_answers_need_no_postings(spark):
    pages_ = spark.createDataFrame([(n, 1, f"The silver thornbush number {n} stands near the river.\nA horn was heard in valley {n % 4}.") for n in range(30)], "doc_id long, page int, text string")
    own = ingest.passages(pages_, every_line=True).withColumn("tenant", (F.col("doc_id") % 2).cast("string")).withColumn("book", F.col("doc_id").cast("string"))
    own = own.withColumn("printed_page_start", F.lit(None).cast("int")).withColumn("printed_page_end", F.lit(None).cast("int")).withColumn("id", F.concat_ws(":", "doc_id", "chunk_no")).localCheckpoint()
    asked = spark.createDataFrame([(1, "Where is the silver thornbush?", "0"), (2, "Who heard a horn in the valley?", "1")], "q long, question string, tenant string")
    vectors, postings = ingest.indexes(own, None, "tenant")
    with_postings = sorted(map(str, ask.answered(asked, own, vectors, postings).collect()))
    assert with_postings == sorted(map(str, ask.answered(asked, own, vectors, None).collect())) and "generate" in with_postings[0]


def test_letters_are_counted(spark):
    texts = ["", None, "Zebra aa", "ÀÉ K İ ß", "كتاب z" * 50]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    low = F.lower(F.coalesce("t", F.lit("")))
    plain = F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in "abcdefghijklmnopqrstuvwxyz"])
    made = rows.select(queries._letters(F.col("t")).alias("a"), plain.alias("b")).collect()
    assert len(made) == 5 and all(r["a"] == r["b"] for r in made)
