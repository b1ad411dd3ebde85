"""Passage formatting, citations, boxes and gates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import claim_token, is_source_question, words

# Phrases that say nothing was found, refusals by language, template leftovers.
NO_RESULT_PHRASES = [
    "no relevant information found",
    "no relevant information was found",
    "after multiple attempts, no relevant information",
    "لا توجد معلومات ذات صلة",
    "لا توجد معلومات",
    "لا معلومات",
    "لم يتم العثور على معلومات",
    "کوئی متعلقہ معلومات نہیں",
]
REFUSALS = {
    "ar": "لا توجد معلومات ذات صلة في المصادر المقدمة.",
    "ur": "فراہم کردہ ذرائع میں کوئی متعلقہ معلومات نہیں ملی۔",
    "en": "No relevant information found in the provided sources.",
}
PLACEHOLDER = r"\[(?:Book Name|Page X|Chapter Y)[^\]]*\]"
BRACKET = r"\[[^\]]*P\d[^\]]*\]"
TAG = r"P(\d+)(?:\s*,\s*Page\s+(\d+))?"
SENTENCE_BOUNDARY = "[.!؟۔\n]"
CLAIM_TOKEN = "([A-Za-z0-9]+|[؀-ۿ]+)"
CLAIM_STOPWORDS = [
    "في", "من", "إلى", "عن", "على", "أن", "إن", "كان", "كانت", "يكون",
    "تكون", "هو", "هي", "له", "لها", "ما", "ال", "ثم", "أو", "إذا", "كما",
    "هذا", "هذه", "ذلك", "التي", "الذي", "الذين", "وقد", "لم", "لا", "به",
    "منه", "عنه", "قد", "بل", "بعد", "قبل", "عند", "بين", "غير", "كل",
    "أنه", "إنه", "أي", "ولا", "ولم", "وأن", "حتى", "لأن",
    "ان", "الى", "اذ", "انه", "لن", "ليس",
]

PASSAGE_WORDS = 800
MIN_SCORE, MIN_VECTOR, MIN_VECTOR_SOURCE = 0.30, 0.65, 0.60


def truncated(text: Column, most: int = PASSAGE_WORDS) -> Column:
    """The first words of a text, with dots if some were cut."""
    own = words(text)
    return F.when(F.size(own) > most, F.concat(F.array_join(F.slice(own, 1, most), " "), F.lit(" ..."))).otherwise(text)


def annotated(text: Column, offsets: Column) -> Column:
    """A text over several pages with a marker before each page's part.

    ``offsets``: array of (page, start_char, end_char inclusive, printed_page_num).
    """
    visible = F.filter(offsets, lambda o: o["start_char"] < F.length(text))
    parts = F.transform(visible, lambda o: F.concat(F.lit("⟨Page "), F.coalesce(F.nullif(o["printed_page_num"], F.lit(0)), o["page"]).cast("string"), F.lit("⟩ "), F.substr(text, o["start_char"] + 1, o["end_char"] - o["start_char"] + 1)))
    return F.when(F.size(visible) > 1, F.array_join(parts, " ")).otherwise(text)


def source_line(book: Column, start: Column, end: Column) -> Column:
    """The book and its page or pages."""
    page = F.when(end.isNotNull() & (end != 0) & (end != start), F.concat(F.lit(", Page "), start.cast("string"), F.lit("-"), end.cast("string"))).otherwise(F.concat(F.lit(", Page "), start.cast("string")))
    return F.concat(book, F.when(start.isNotNull() & (start != 0), page).otherwise(""))


def formatted(passages: Column) -> Column:
    """Numbered passages with their sources, as a model is shown them.

    ``passages``: array of (text, page_offsets, book_name, page_start, page_end,
    printed_page_start, printed_page_end).
    """

    def one(p: Column, n: Column) -> Column:
        start, end = F.coalesce(p["printed_page_start"], p["page_start"]), F.coalesce(p["printed_page_end"], p["page_end"])
        return F.concat(F.lit("[P"), (n + 1).cast("string"), F.lit("] "), annotated(truncated(p["text"]), p["page_offsets"]), F.lit("\n    Source: "), source_line(p["book_name"], start, end))

    return F.array_join(F.transform(passages, one), "\n\n")


def cited(answer: Column) -> Column:
    """The numbers of the passages an answer cites, in order, repeats kept."""
    groups = F.regexp_extract_all(answer, F.lit(f"({BRACKET})"), F.lit(1))
    return F.transform(F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(TAG), F.lit(1)))), lambda n: n.cast("int"))


def invalid_citations(answer: Column, n_passages: Column) -> Column:
    return F.filter(cited(answer), lambda n: (n < 1) | (n > n_passages))


def needs_consistency_check(answer: Column) -> Column:
    return F.size(F.array_distinct(cited(answer))) >= 2


def claim_sentence(prefix: Column) -> Column:
    """The sentence that ends where a citation begins."""
    parts = F.filter(F.transform(F.split(prefix, SENTENCE_BOUNDARY), lambda x: F.trim(x)), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.trim(F.regexp_replace(F.element_at(parts, -1), BRACKET, " "))).otherwise(F.trim(prefix))


def claim_tokens(claim: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in CLAIM_STOPWORDS])
    own = F.transform(F.regexp_extract_all(claim, F.lit(CLAIM_TOKEN), F.lit(1)), claim_token)
    return F.filter(own, lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t))


def without_placeholders(answer: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(answer, F.lit("")), PLACEHOLDER, ""))


def says_nothing_found(answer: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    out = F.lit(False)
    for phrase in NO_RESULT_PHRASES:
        out = out | F.contains(low, F.lit(phrase))
    return out


def decision(question: Column, n_passages: Column, best_score: Column, top_vector: Column, retries: Column) -> Column:
    """generate, retry or no_result."""
    bar = F.when(is_source_question(question), MIN_VECTOR_SOURCE).otherwise(MIN_VECTOR)
    confident = (best_score >= MIN_SCORE) | (F.coalesce(top_vector, F.lit(0.0)) >= bar)
    return F.when((n_passages > 0) & confident, "generate").when(retries < 1, "retry").otherwise("no_result")


def refusal(language: Column, retried: Column) -> Column:
    text = F.when(language == "ar", REFUSALS["ar"]).when(language == "ur", REFUSALS["ur"]).otherwise(REFUSALS["en"])
    return F.when(retried, F.concat(text, F.lit(" Try rephrasing your question."))).otherwise(text)


def parsed_box(text: Column) -> Column:
    """Four numbers from a comma-separated text, or null."""
    parts = F.transform(F.split(text, ","), lambda p: p.try_cast("double"))
    return F.when((F.size(parts) == 4) & ~F.exists(parts, lambda p: p.isNull()), parts)


def plausible_box(box: Column) -> Column:
    """Whether a box lies on a page of at most 3000 points and has an area."""
    x0, y0, x1, y1 = (F.get(box, n) for n in range(4))
    return F.coalesce((F.size(box) == 4) & (x0 >= 0) & (y0 >= 0) & (x1 > x0) & (y1 > y0) & (x1 <= 3000) & (y1 <= 3000), F.lit(False))


def box_inside(box: Column, width: Column, height: Column) -> Column:
    return plausible_box(box) & (F.get(box, 2) <= width + 0.01) & (F.get(box, 3) <= height + 0.01)


def highlight_url(book: Column, page: Column, box: Column, text: Column) -> Column:
    """The address of a highlighted page, null without a book or page."""
    snippet = F.substring(F.array_join(words(text), " "), 1, 600)
    quoted = F.url_encode(snippet)
    for form, percent in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        quoted = F.replace(quoted, F.lit(form), F.lit(percent))
    boxed = F.when(plausible_box(box), F.concat(F.lit("&bbox="), F.array_join(F.transform(box, lambda v: v.cast("string")), ","))).otherwise("")
    said = F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit("&text="), quoted)).otherwise("")
    return F.when((F.coalesce(book, F.lit("")) != "") & page.isNotNull(), F.concat(F.lit("/highlight?book_id="), book, F.lit("&page="), page.cast("string"), boxed, said))


def retry_wait(attempt: Column, retry_after: Column, jitter: Column) -> Column:
    """Seconds to wait before another call."""
    return F.least(F.coalesce(retry_after, F.pow(F.lit(2.0), F.least(attempt, F.lit(4))) + jitter), F.lit(120.0))
