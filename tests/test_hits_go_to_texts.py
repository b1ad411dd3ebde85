"""Few hits go to the passages; what no question may mean is dropped where it is read."""

from corpusloom.operators import ranking, retrieval


def test_texts_of_hits_are_not_shuffled(spark):
    passages = spark.createDataFrame([(n, f"text {n}") for n in range(20)], "id long, text string")
    hits = spark.createDataFrame([(1, 3, 1), (1, 5, 2), (2, 3, 1)], "q long, id long, rank int")
    made = retrieval.at_hits(hits, passages)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan, plan
    assert sorted(map(tuple, made.select("q", "id", "rank", "text").collect())) == [(1, 3, 1, "text 3"), (1, 5, 2, "text 5"), (2, 3, 1, "text 3")]


def test_postings_of_what_questions_may_mean(spark):
    passages = spark.createDataFrame([(1, "silver thorn unrelated words"), (2, "silvr and thorn")], "id long, text string")
    asked = spark.createDataFrame([(1, "silver")], "q long, question string")
    assert sorted((r["term"], r["id"], r["positions"]) for r in ranking.asked_postings(asked, passages).collect()) == [("silver", 1, [0]), ("silvr", 2, [0])]
