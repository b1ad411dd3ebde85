"""Text functions on literal cases."""

import uuid

from pyspark.sql import functions as F

from corpusloom.functions import answers as A
from corpusloom.functions import ids
from corpusloom.functions import text as T


def values(spark, made, *rows):
    """The value of a column expression for each row of text columns a, b."""
    columns = "abc"[: len(rows[0])]
    table = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, " + ", ".join(f"{c} string" for c in columns))
    return [r["v"] for r in table.select("n", made(*[F.col(c) for c in columns]).alias("v")).orderBy("n").collect()]


def test_terms(spark):
    assert values(spark, T.query_terms, ("What is the difference between the Qiblah of Kinānah?",), ("vs pp 3 in the",), ("ما هو حكم الصلاة على الأرض",), ("",)) == [["difference", "qiblah", "kinanah"], [], ["حكم", "الصلاه", "الارض"], []]


def test_overlap(spark):
    made = lambda q, t: T.overlap(T.query_terms(q), T.haystack(t))
    found = values(spark, made, ("Who was al-Asqaʿ of Kinānah", "al-Asqa came to Kinanah"), ("volcano eruption", "a text on prayer"), ("the of", "anything"))
    assert found[0] > 0.5 and found[1:] == [0.0, 0.0]


def test_entities(spark):
    assert values(spark, T.entities, ("من هو برهان الشريعة وابن حجر والقرطبي",)) == [["برهان الشريعه", "ابن حجر", "والقرطبي"]]
    assert values(spark, lambda q, t: T.entity_boost(T.entities(q), t), ("برهان الشريعة", "قال برهان الشريعة"), ("nothing", "x")) == [0.15, 0.0]


def test_keyword_queries(spark):
    both = lambda a, b, c: F.array(*T.keyword_queries(a, b, c))
    assert values(spark, both, ("حكم الصلاة", "prayer ruling", "f"), ("prayer", "prayer", "f"), ("", "", "fallback"), ("", "the", "f")) == [["حكم الصلاه", "prayer ruling"], ["prayer", None], ["fallback", None], ["the", None]]
    assert values(spark, T.keyword_query, ("prayer ruling", "prayer rule", "f"), ("", "", "f")) == ["prayer ruling rule", "f"]


def test_languages(spark):
    assert values(spark, T.script_language, ("hello",), ("الصلاة",), ("یہ کتاب ہے",), ("123",)) == ["en", "ar", "ur", "ar"]
    assert values(spark, T.answer_language, ("abc",), ("الصلاة عماد الدين",), ("یہ کتاب ہے اور ٹوپی",), ("long latin text و",)) == ["en", "ar", "ur", "en"]


def test_source_questions(spark):
    assert values(spark, T.is_source_question, ("What is the source of this?",), ("Who narrated it",), ("من رواه",), ("What is prayer?",), (None,)) == [True, True, True, False, False]


def test_identifiers(spark):
    name = "الموسوعه الفقهيه الكويتيه|1|2"
    assert values(spark, lambda a: ids.chunk_id(a, F.lit(1), F.lit(2)), ("المَوْسُوعة الفقهيّة  الكويتيـــة",), ("الموسوعة الفقهية الكويتية",), ("Kinānah",), ("kinanah",)) == [str(uuid.uuid5(uuid.NAMESPACE_DNS, name))] * 2 + [str(uuid.uuid5(uuid.NAMESPACE_DNS, "kinanah|1|2"))] * 2


def test_headings(spark):
    assert values(spark, T.heading, ("## 12. The Book of Prayer",), ("A sentence that ends.",), ("(bracketed text)",), ("one",), ("* CHAPTER ONE *",)) == ["The Book of Prayer", None, None, None, "CHAPTER ONE"]
    assert values(spark, T.chapter, ("كتاب الصلاة",), ("CHAPTER one",), ("Chapter one",)) == ["كتاب الصلاة", "CHAPTER one", None]
    assert values(spark, T.is_colon_heading, ("الخلاف:",), ("label: content.",), ("a " * 13 + "b:",), (":",)) == [True, False, False, False]
    assert values(spark, T.without_markup, (" - **bold** `x`",), ("12. item",)) == ["bold x", "item"]


def test_citation_tags(spark):
    assert values(spark, A.cited, ("a [P1, Page 2; P2, Page 1] b [P99] c [P0] [note]",)) == [[1, 2, 99, 0]]
    assert values(spark, lambda a: A.invalid_citations(a, F.lit(2)), ("a [P1] [P99] [P0]",)) == [[99, 0]]
    assert values(spark, A.needs_consistency_check, ("[P1] [P1]",), ("[P1; P2]",)) == [False, True]
    assert values(spark, A.claim_sentence, ("First. Second one [P1] is here ",), ("",)) == ["Second one   is here", ""]
    assert values(spark, A.claim_tokens, ("وقال محمودا في الكتاب 122 a",)) == [["قال", "محمود", "الكتاب", "122"]]


def test_answers(spark):
    assert values(spark, A.without_placeholders, ("x [Book Name, y]",), (None,)) == ["x", ""]
    assert values(spark, A.says_nothing_found, ("No relevant information found.",), ("Found",), (None,)) == [True, False, False]
    assert values(spark, lambda a: A.plausible_box(A.parsed_box(a)), ("1,2,3,4",), ("3,2,1,4",), ("1,2,3",), ("a,b,c,d",), ("0,0,17800,20",)) == [True, False, False, False, False]
    url = values(spark, lambda a, b: A.highlight_url(a, F.lit(3), F.lit(None).cast("array<double>"), b), ("b1", "a  b/é*~"), ("", "x"))
    assert url == ["/highlight?book_id=b1&page=3&text=a%20b/%C3%A9%2A~", None]


def test_gate(spark):
    made = lambda q, n, b: A.decision(q, n.cast("int"), b.cast("double"), F.lit(0.62), F.lit(0))
    assert values(spark, made, ("plain", "3", "0.31"), ("plain", "3", "0.2"), ("source of this", "3", "0.2"), ("source of this", "0", "0.9")) == ["generate", "retry", "generate", "retry"]


def test_page_markers(spark):
    offsets = "array(named_struct('page', 5, 'start_char', 0, 'end_char', 5, 'printed_page_num', cast(null as int)), named_struct('page', 6, 'start_char', 6, 'end_char', 10, 'printed_page_num', 16))"
    assert values(spark, lambda a: A.annotated(a, F.expr(offsets)), ("first second",), ("first",)) == ["⟨Page 5⟩ first  ⟨Page 16⟩ secon", "first"]
    passages = f"array(named_struct('text', a, 'page_offsets', {offsets}, 'book_name', 'B', 'page_start', 5, 'page_end', 6, 'printed_page_start', 15, 'printed_page_end', 16))"
    assert values(spark, lambda a: A.formatted(F.expr(passages)), ("one",)) == ["[P1] one\n    Source: B, Page 15-16"]
