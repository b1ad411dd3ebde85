"""A batch of questions answered from passages, as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import answers as A
from corpusloom.functions import text as T
from corpusloom.operators import citations, ranking, retrieval
from corpusloom.plans.models import Models
from corpusloom.sources.store import stored


def valid_question(question: Column) -> Column:
    """Whether a question has from 1 to 4096 characters."""
    return F.length(question).between(1, 4096)


def enriched(questions: DataFrame, models: Models) -> DataFrame:
    """(q, question) with language, other form, keyword query and vector; bad lengths are left out."""
    rows = questions.where(valid_question(F.col("question")))
    rows = rows.withColumn("language", T.script_language(F.col("question"))).withColumn("other", models.translate(F.col("question")))
    primary, secondary = T.keyword_queries(F.col("question"), F.col("other"), F.col("question"))
    rows = rows.withColumn("primary", primary).withColumn("secondary", secondary)
    # Each leg and every later step starts from these rows.
    return stored(rows.withColumn("vector", models.embed(T.embedding_text(F.col("question"), F.col("other")))))


# Fixed value: the note ahead of an answer whose passages disagree.
DISAGREEMENT = "⚠️ Note: the source passages contain a disagreement on this point. Each passage's claim is stated separately below.\n\n"


def _placed(rows: DataFrame, passages: DataFrame) -> DataFrame:
    """A few rows with columns of their passages; their ids go to the passages, which are not shuffled."""
    return rows.join(retrieval.at_hits(rows.select("id").distinct(), passages), "id")


def ranked(questions: DataFrame, passages: DataFrame, vectors: DataFrame, own: DataFrame | None, k: int = 20, scope: str | None = "tenant", book: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(fused, ranked): candidates of both legs, and the best after scoring and suppression.

    Both legs see a question's own ``scope`` alone, and one book alone where ``book`` names a
    column and the question has a value in it. Without postings (``own``) the passages are read for the words asked for.
    """
    named, columns = passages.select("id", "text"), [c for c in (scope, book) if c]
    vector = retrieval.at_hits(retrieval.vector_leg(questions.select("q", "vector", *columns), vectors, k, scope, book), named)
    primary = questions.select("q", F.col("primary").alias("question"), *columns)
    secondary = questions.where("secondary IS NOT NULL").select("q", F.col("secondary").alias("question"), *columns)
    if own is None and book is None:
        known = stored(ranking.words_of(passages))
        first = ranking.keyword_passages(primary, passages, known, k, scope)
        second = ranking.keyword_passages(secondary, passages, known, k, scope) if len(secondary.take(1)) else first.limit(0)
    else:
        terms = retrieval.question_terms(primary.unionByName(secondary))
        own = stored(retrieval.postings(passages, *columns, terms=terms)) if own is None else own
        first = retrieval.keyword_leg(primary, own, k, scope=scope, book=book)
        second = retrieval.keyword_leg(secondary, own, k, scope=scope, book=book)
    keyword = retrieval.at_hits(retrieval.merge_keyword_legs(first, second, k), named)
    fused = stored(retrieval.fuse(vector, keyword))  # both the ranking and the gate read it
    scored = retrieval.above_floor(retrieval.score(fused, questions.select("q", "question", "other")))
    placed = _placed(stored(scored), passages.select("id", "book", "page_start", "page_end"))
    return fused, stored(retrieval.suppress(stored(placed)))


def answered(questions: DataFrame, passages: DataFrame, vectors: DataFrame, own: DataFrame | None, models: Models | None = None, scope: str | None = "tenant", book: str | None = None) -> DataFrame:
    """(q, decision, answer, language, needs_rewrite, no_result, sources) of every question.

    The steps are cut at stored tables of a few dozen rows a question; passages, vectors and postings
    should be stored too, as ``ingest.indexes`` leaves them, for the plan of each step reads them. ``own`` is the postings, or None for a
    batch that is all that will be asked: then no postings are made.

    ``passages`` has id, text, book, page_start, page_end, page_offsets and printed pages.
    Questions, vectors and postings have the column ``scope``; None stands for a corpus of one tenant.
    """
    models = models or Models()
    asked = enriched(questions, models)
    fused, best = ranked(asked, passages, vectors, own, scope=scope, book=book)
    gated = retrieval.gate(asked, best, fused)
    facts = passages.select("id", "page_offsets", "printed_page_start", "printed_page_end")
    entry = F.struct("rank", "id", "text", F.col("book").alias("book_name"), "page_start", "page_end", "page_offsets", "printed_page_start", "printed_page_end", "score")
    lists = _placed(best, facts).groupBy("q").agg(F.array_sort(F.collect_list(entry)).alias("passages"))
    rows = asked.join(gated, "q").join(lists, "q", "left")
    rows = rows.withColumn("answer", F.when(F.col("decision") == "generate", models.generate(F.col("question"), F.col("passages"))))
    rows = stored(citations.resolve_citations(stored(rows)))
    checked = A.needs_consistency_check(F.col("answer")) & F.upper(F.trim(models.check(F.col("question"), F.col("answer"), F.col("passages")))).startswith("CONTRADICT")
    final = A.without_placeholders(F.col("resolved"))
    rows = rows.withColumn("final", F.concat(F.when(checked, DISAGREEMENT).otherwise(""), final))
    rows = rows.withColumn("needs_rewrite", F.coalesce(T.answer_language(F.col("final")) != F.col("language"), F.lit(False)))
    rows = rows.withColumn("no_result", (F.col("decision") != "generate") | A.says_nothing_found(F.col("final")))
    text = F.when(F.col("no_result"), A.refusal(F.col("language"), F.col("decision") == "no_result")).otherwise(F.when(F.col("needs_rewrite"), models.rewrite(F.col("final"), F.col("language"))).otherwise(F.col("final")))
    sources = F.transform(F.coalesce("passages", F.array().cast(rows.schema["passages"].dataType)), lambda p: F.struct(p["rank"], p["id"], p["book_name"], p["page_start"], p["page_end"], p["score"], A.highlight_url(p["book_name"], p["page_start"], F.lit(None).cast("array<double>"), p["text"]).alias("highlight_url")))
    return rows.select("q", "decision", text.alias("answer"), "language", "needs_rewrite", "no_result", F.when(F.col("no_result"), F.slice(sources, 1, 0)).otherwise(sources).alias("sources"))
