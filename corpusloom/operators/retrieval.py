"""Retrieval: vector and keyword legs, fusion, scoring, suppression and the gate.

Every table is keyed by question (``q``) and passage (``id``); a rank is a column. Scoring
touches the candidates of a question only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import answers
from corpusloom.functions import text as T
from corpusloom.operators import vectors
from corpusloom.sources.store import stored

TERMS_AT_ONCE = 200_000
#: Hits that are sent to the passages; with more of them both are shuffled.
HITS_AT_ONCE = 200_000
RRF = 60
NGRAM, COVERAGE = 6, 0.12
FLOOR, TOP = 0.10, 8


def _top(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)


def vector_leg(questions: DataFrame, points: DataFrame, k: int = 20, scope: str | None = None, book: str | None = None) -> DataFrame:
    """(q, id, score, rank): the ``k`` points nearest to each question by cosine; ``vectors.nearest`` or, for large tables, ``vectors.search``."""
    return vectors.nearest(questions, points, k, scope, book)


def _in_book(rows: DataFrame, book: str | None) -> DataFrame:
    return rows.where(F.col(f"q_{book}").isNull() | (F.col(f"q_{book}") == F.col(book))) if book else rows


def question_terms(questions: DataFrame) -> DataFrame:
    """(q, term, ...) of (q, question, ...): the distinct content words."""
    return questions.withColumn("term", F.explode(F.array_distinct(T.query_terms(F.col("question"))))).drop("question")


def _among(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``rows`` with one of some terms; up to ``TERMS_AT_ONCE`` terms are broadcast."""
    distinct = terms.select("term").distinct()
    few = distinct.limit(TERMS_AT_ONCE + 1).count() <= TERMS_AT_ONCE
    return rows.join(F.broadcast(distinct) if few else distinct, "term", "left_semi")


def postings(passages: DataFrame, *scopes: str, terms: DataFrame | None = None) -> DataFrame:
    """(term, id, tf, scopes) of the words of passages as overlap compares them.

    With ``terms`` only those that some question has, dropped where they are read: what is
    shuffled then follows the matches, not the corpus.
    """
    words = T.term_rows(passages, "id", *scopes).drop("pos")
    words = words if terms is None else _among(words, terms)
    return words.groupBy("term", "id", *scopes).agg(F.count("*").alias("tf"))


def refreshed_postings(stored: DataFrame, passages: DataFrame, touched: DataFrame, *scopes: str, book: str = "book") -> DataFrame:
    """Stored postings with those of touched books made again; ``passages`` needs only those books.

    Postings carry ``book`` among their scopes. A book without passages loses its postings.
    """
    books = touched.select(book).distinct()
    return stored.join(books, book, "left_anti").unionByName(postings(passages.join(books, book, "left_semi"), *scopes))


def document_frequency(own: DataFrame, *scopes: str) -> DataFrame:
    return own.groupBy("term", *scopes).agg(F.count("*").alias("df"))


def keyword_leg(questions: DataFrame, own: DataFrame, k: int = 20, strict: bool = False, scope: str | None = None, book: str | None = None) -> DataFrame:
    """(q, id, tier, matched, tf, rank): passages by how many of the rarest terms they hold.

    Questions are (q, question), ``own`` is ``postings``. Terms are ordered from the rarest;
    a passage's tier is the largest p such that it holds the p rarest, which is what dropping
    the commonest term again and again finds. ``strict`` leaves tier 0 out. ``scope`` and ``book``
    as in ``vector_leg``: both tables have the columns, and rarity counts within the scope.
    """
    columns = [c for c in (scope, book) if c]
    scopes = [scope] if scope else []
    terms = question_terms(questions.select("q", "question", *scopes, *([F.col(book).alias(f"q_{book}")] if book else [])))
    matched = _among(own.select("term", "id", "tf", *columns), terms)
    # A count over tf, so that both uses of the postings are one exchange.
    frequency = matched.groupBy("term", *scopes).agg(F.count_if(F.col("tf") > 0).alias("df"))
    placed = terms.join(frequency, ["term", *scopes]).withColumn("pos", F.row_number().over(Window.partitionBy("q").orderBy("df", "term")))
    hits = _in_book(placed.join(matched, ["term", *scopes]), book).withColumn("n", F.row_number().over(Window.partitionBy("q", "id").orderBy("pos")))
    tier = F.max(F.when(F.col("n") == F.col("pos"), F.col("pos")).otherwise(0))
    scored = hits.groupBy("q", "id").agg(tier.alias("tier"), F.count("*").alias("matched"), F.sum("tf").alias("tf"))
    scored = scored.where("tier > 0") if strict else scored
    return _top(scored, k, F.desc("tier"), F.desc("matched"), F.desc("tf"), F.col("id"))


def at_hits(hits: DataFrame, passages: DataFrame) -> DataFrame:
    """``hits`` with the columns of their passages, by id. Up to ``HITS_AT_ONCE`` hits go to the passages: these are not shuffled."""
    hits = stored(hits)
    few = hits.limit(HITS_AT_ONCE + 1).count() <= HITS_AT_ONCE
    return passages.join(F.broadcast(hits) if few else hits, "id")


def merge_keyword_legs(first: DataFrame, second: DataFrame, k: int = 20) -> DataFrame:
    """Hits of the first query, then those only the second has, up to ``k``."""
    both = first.withColumn("leg", F.lit(1)).unionByName(second.withColumn("leg", F.lit(2)))
    seen = both.withColumn("n", F.row_number().over(Window.partitionBy("q", "id").orderBy("leg"))).where("n = 1")
    return _top(seen.withColumnRenamed("rank", "leg_rank"), k, F.col("leg"), F.col("leg_rank")).drop("n", "leg", "leg_rank")


def fuse(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    """(q, text, id, rrf, leg, leg_rank, top_vector): reciprocal ranks summed over equal texts.

    Both legs are (q, id, text, rank, score); the first occurrence of a text, in the vector
    leg before the keyword leg, gives its id.
    """
    both = vector.select("q", "id", "text", "rank", "score", F.lit(1).alias("leg")).unionByName(keyword.select("q", "id", "text", "rank", F.lit(None).cast("double").alias("score"), F.lit(2).alias("leg")))
    first = F.min(F.struct("leg", "rank", "id"))
    fused = both.groupBy("q", "text").agg(F.sum(1.0 / (F.col("rank") - 1 + RRF)).alias("rrf"), first.alias("first"), F.max("score").alias("best"))
    top = F.coalesce(F.max("best").over(Window.partitionBy("q")), F.lit(0.0))
    return fused.select("q", "text", F.col("first.id").alias("id"), "rrf", F.col("first.leg").alias("leg"), F.col("first.rank").alias("leg_rank"), top.alias("top_vector"))


def score(fused: DataFrame, questions: DataFrame) -> DataFrame:
    """Adds overlap, entity and score to candidates; questions are (q, question, other).

    ``other`` is the question in another language or null; the better overlap counts.
    """
    asked = questions.select("q", T.query_terms(F.col("question")).alias("terms"), T.query_terms(F.coalesce("other", F.lit(""))).alias("other_terms"), T.entities(F.col("question")).alias("names"))
    rows = fused.join(asked, "q").withColumn("hay", T.haystack(F.col("text")))
    rows = rows.withColumn("overlap", F.greatest(T.overlap(F.col("terms"), F.col("hay")), T.overlap(F.col("other_terms"), F.col("hay"))))
    rows = rows.withColumn("entity", T.entity_boost(F.col("names"), F.col("text")))
    return rows.withColumn("score", F.col("rrf") + 0.5 * F.col("overlap") + F.col("entity")).drop("terms", "other_terms", "names", "hay")


def above_floor(scored: DataFrame) -> DataFrame:
    return scored.where((F.col("overlap") > 0) & (F.col("score") >= FLOOR))


def grams(tokens: Column, n: int = NGRAM) -> Column:
    """The runs of ``n`` tokens, each as one text."""
    none = F.array().cast("array<string>")
    return T.let(tokens, lambda own: F.when(F.size(own) >= n, F.transform(F.sequence(F.lit(0), F.size(own) - n), lambda i: F.concat_ws(" ", *[F.get(own, i + k) for k in range(n)]))).otherwise(none))


def coverage(own: Column, kept: Column) -> Column:
    """The part of the n-grams of one text that another holds."""
    return F.when(F.size(own) > 0, F.size(F.filter(own, lambda g: F.array_contains(kept, g))) / F.size(own)).otherwise(F.lit(0.0))


def covered(passages: DataFrame, scope: str) -> DataFrame:
    """(id, size, shared, coverage, best, by_best): what part of each passage's n-grams earlier ones of its scope hold.

    ``passages`` has id, text and ``scope``; earlier is what has a smaller id. ``best`` is the passage that was first to
    have most of the n-grams, of equals the earliest, null if none are shared; passages without an n-gram have no row.
    Every n-gram is met with its first holder alone, so work and result grow with the text, not with pairs of passages.
    N-grams are shuffled once, as two numbers (the halves of the MD5 of scope and n-gram) and the id; what is
    held first by the passage itself is counted where the text is read and goes no further.
    """
    # The number of n-grams goes with the first of them, so that no passage is cut twice.
    own = passages.select("id", scope, grams(T.tokens(F.coalesce("text", F.lit("")))).alias("grams"))
    each = own.select("id", scope, F.size("grams").alias("size"), F.posexplode("grams").alias("pos", "gram"))
    # A null scope is one of its own, apart from the empty one.
    named = F.coalesce(F.concat(F.lit("="), F.col(scope).cast("string")), F.lit(""))
    digest = each.select("id", F.when(F.col("pos") == 0, F.col("size")).alias("size"), F.md5(F.concat_ws(" ", named, "gram").cast("binary")).alias("m"))
    half = lambda at: F.conv(F.substring("m", at, 16), 16, -10).cast("long")
    dealt = digest.select("id", "size", half(1).alias("a"), half(17).alias("b")).repartition("a", "b")
    held = dealt.withColumn("first", F.min("id").over(Window.partitionBy("a", "b")))
    earlier = F.col("first") < F.col("id")
    met = held.where(earlier | F.col("size").isNotNull()).groupBy("id", "first").agg(F.count(F.when(earlier, 1)).alias("n"), F.sum("size").alias("size"))
    best = F.max(F.when(F.col("n") > 0, F.struct("n", (-F.col("first")).alias("first"))))
    out = met.groupBy("id").agg(F.sum("size").alias("size"), F.sum("n").alias("shared"), best.alias("b"))
    return out.select("id", "size", "shared", F.round(F.col("shared") / F.col("size"), 6).alias("coverage"), (-F.col("b.first")).alias("best"), F.round(F.col("b.n") / F.col("size"), 6).alias("by_best"))


def suppress(ranked: DataFrame, top: int = TOP) -> DataFrame:
    """The best passages without those that repeat a better one of the same book and pages.

    ``ranked`` has q, id, text, score, book, page_start, page_end, leg, leg_rank, at most a few dozen
    rows a question. What part of a passage a better one covers is found by joining the n-grams of
    a question's passages; the fold over a question, as each passage is compared with those that
    were kept, then sees numbers alone.
    """
    order = Window.partitionBy("q").orderBy(F.desc("score"), "leg", "leg_rank", "id")
    numbered = ranked.withColumn("n", F.row_number().over(order))
    shared = numbered.where("book <> ''").select("q", "book", "n", "page_start", "page_end", grams(T.tokens(F.col("text"))).alias("grams"))
    each = shared.select("q", "book", "n", "page_start", "page_end", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    lower = each.groupBy("q", "book", "gram", "n", "page_start", "page_end", "size").agg(F.count("*").alias("times"))
    better = lower.select("q", "book", "gram", F.col("n").alias("higher"), F.col("page_start").alias("from"), F.col("page_end").alias("to"))
    met = lower.join(better, ["q", "book", "gram"]).where("higher < n AND from <= page_end AND page_start <= to")
    covered = met.groupBy("q", "n", "higher", "size").agg(F.sum("times").alias("times")).where(F.col("times") / F.col("size") >= COVERAGE)
    clashes = covered.groupBy("q", "n").agg(F.collect_list("higher").alias("clashes"))
    rows = numbered.select("q", "n").join(clashes, ["q", "n"], "left").select("q", "n", F.coalesce("clashes", F.array().cast("array<int>")).alias("clashes"))
    per = rows.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("n", "clashes"))).alias("rows"))
    kept = F.aggregate("rows", F.array().cast("array<int>"), lambda acc, r: F.when(F.arrays_overlap(acc, r["clashes"]), acc).otherwise(F.concat(acc, F.array(r["n"]))))
    places = per.select("q", F.posexplode(F.slice(kept, 1, top)).alias("place", "n"))
    return places.join(numbered, ["q", "n"]).select("q", (F.col("place") + 1).alias("rank"), "id", "text", "score", "book", "page_start", "page_end")


def gate(questions: DataFrame, ranked: DataFrame, fused: DataFrame, retries: Column | None = None) -> DataFrame:
    """(q, n_passages, best_score, top_vector, decision) of every question."""
    best = ranked.groupBy("q").agg(F.count("*").alias("n_passages"), F.max("score").alias("best_score"))
    top = fused.groupBy("q").agg(F.max("top_vector").alias("top_vector"))
    rows = questions.join(best, "q", "left").join(top, "q", "left")
    n, score_, vector = F.coalesce("n_passages", F.lit(0)), F.coalesce("best_score", F.lit(0.0)), F.coalesce("top_vector", F.lit(0.0))
    return rows.select("q", n.alias("n_passages"), score_.alias("best_score"), vector.alias("top_vector"), answers.decision(F.col("question"), n, score_, vector, F.lit(0) if retries is None else retries).alias("decision"))
