"""Means, shares and coverage that do not depend on the order of rows or on how they are dealt."""

from pyspark.sql import functions as F

from corpusloom.operators import catalog, retrieval


def test_whole_means_do_not_depend_on_order(spark):
    cents = [1965, 681, 1690, 111, 99, 854]
    rows = spark.createDataFrame([(c / 100,) for c in cents], "value double").coalesce(1)
    for order in ("value", "-value", "rand(1)"):
        made = rows.orderBy(F.expr(order)).agg(catalog.whole_mean(catalog.exact_sum(F.col("value")), F.count("*")).alias("mean"))
        assert made.collect()[0]["mean"] == 9


def test_shares_are_rounded_as_the_sql_does(spark):
    rows = spark.createDataFrame([(631, 169), (1, 3), (577, 223), (0, 0)], "h long, m long").select(catalog.hit_rate(F.col("h"), F.col("m")).alias("r"))
    assert [r["r"] for r in rows.collect()] == [0.7887, 0.25, 0.7212, 0.0]


def test_coverage_shuffles_its_ngrams_once(spark):
    text = "a b c d e f g h i j"
    rows = spark.createDataFrame([(1, "s", text), (2, "s", text + " k"), (3, "t", text), (4, None, text), (5, None, text), (6, "", text), (7, "s", "too short"), (8, "s", None)], "id long, source string, text string")
    made = retrieval.covered(rows, "source")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, made.collect())) == [(1, 5, 0, 0.0, None, None), (2, 6, 5, 0.833333, 1, 0.833333), (3, 5, 0, 0.0, None, None), (4, 5, 0, 0.0, None, None), (5, 5, 5, 1.0, 4, 1.0), (6, 5, 0, 0.0, None, None)]
    assert "Join" not in plan and plan.count("Exchange hashpartitioning(a") == 1, plan
