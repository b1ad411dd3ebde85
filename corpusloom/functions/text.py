"""Text normalisation, terms, entities and language, as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.normal_forms import composed, decomposed

# Function words that carry no meaning in a question.
ARABIC_STOPWORDS = [
    "من", "ما", "هو", "هي", "هم", "هن", "في", "على", "عن", "إلى", "الي",
    "الذي", "التي", "الذين", "و", "ف", "ثم", "أو", "او", "لم", "لن", "لا",
    "مع", "هذا", "هذه", "ذلك", "تلك", "كان", "كانت", "لماذا", "ما هو", "ما هي",
    "اذكر", "ماهو", "ماهي", "اي", "أي", "بان", "أن", "ان", "قد", "لقد",
]
ENGLISH_STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "of", "to", "in", "on", "at",
    "by", "for", "with", "from", "as", "is", "are", "was", "were", "be",
    "been", "being", "do", "does", "did", "have", "has", "had", "this",
    "that", "these", "those", "it", "its", "his", "her", "their", "there",
    "here", "what", "which", "who", "whom", "whose", "when", "where", "why",
    "how", "not", "no", "yes", "if", "then", "than", "so", "too", "very",
    "can", "could", "would", "should", "may", "might", "will", "shall",
    "must", "about", "over", "under", "between", "into", "during", "before",
    "after", "above", "below", "also", "only", "just", "such", "both",
    "each", "either", "neither", "some", "any", "all", "more", "most",
    "other", "another", "one", "two", "first", "last", "per", "etc",
    "against", "through", "upon", "among", "within", "without", "up",
    "down", "out", "off", "again", "further", "once",
    "say", "said", "says", "saying", "told", "asked", "tell", "state",
    "states", "stated", "wrote", "writes", "write", "according", "regarding",
    "regards", "mention", "mentions", "mentioned", "refer", "refers",
    "referred", "referring", "mean", "means", "meant",
    "please", "note", "noted", "similar", "like",
]

# Characters stripped from the ends of a token, Arabic marks, letter folds and
# transliteration signs.
EDGE_CHARACTERS = ".,;:!?()[]\"'«»،؛؟*#-"
ARABIC_MARKS = "[ً-ْٰـ]"
LETTERS_FROM, LETTERS_TO = "أإآىةؤئ", "ااايهوي"
MODIFIERS = "ʿʾʼʻ"
COMBINING = "[̀-ͯ]"
ID_MARKS = "[ً-ٰٕـ̀-ͯ]"
ARABIC = "[؀-ۿ]"

# Name patterns that earn a passage an entity boost.
COMPOUND_NAME = ARABIC + r"+\s+(?:الشريعة|الدين|الإسلام|الملة|الله|الرحمن|الحق|العلماء|الأئمة|الحديث|الفقه)"
SON_OF = r"(?:ابن|بن)\s+" + ARABIC + "+"
NISBA = r"(?U)^" + ARABIC + r"{4,}(?:ي|وي)\b"

# Signs of Urdu, and of a question about a statement's source.
URDU_LETTERS = r"[ٹ-ۿݐ-ݿ\x{FE70}-\x{FEFF}]"
URDU_WORDS = r"(?U)\b(?:ہے|کا|کی|کے|سے|میں|اور|یہ|اس|ان|تم|آپ|نے|کو|بھی|ہی|تو|کر|ہو|گی|گے)\b"
URDU_SPECIFIC = "[ٹ-ڀڈ-ڏڑ-ۿـئؤٱ]"
SOURCE_QUESTION = (
    r"(?iU)(?:source\s+(?:reference|of\s+this|of\s+that|of\s+the)|footnote|side\s+note|marginal\s+note|citation|cited\s+in"
    r"|reference\s+(?:for|of|to)|reported\s+by|narrated\s+by|transmitted\s+by|(?:who|من|کون)\s+(?:reported|narrated)"
    r"|who\s+(?:reports|narrates)\b|رواه|أخرجه|المصدر|المرجع|الحاشية|الهامش|مصدر|حوالہ)"
)


def _precomposed() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose into one letter and marks, and those letters."""
    pairs = []
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not "̀" <= c <= "ͯ")
        if len(base) == 1 and base != chr(code):
            pairs.append((chr(code), base))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


FOLD_FROM, FOLD_TO = _precomposed()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, also where ``use`` has it inside another lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Unicode white space beyond ASCII.
WIDE_SPACES = "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def beyond_ascii(text: Column) -> Column:
    """Whether a text has any character beyond ASCII, by its lengths alone."""
    return F.length(text) != F.octet_length(text)


def split_words(text: Column) -> Column:
    """A text cut at Unicode white space; the first and last part may be empty.

    Rarer spaces become plain ones first: an expression that matches them all is many times slower.
    """
    plain = let(text, lambda t: F.when(beyond_ascii(t), F.translate(t, WIDE_SPACES, " " * len(WIDE_SPACES))).otherwise(t))
    return F.split(plain, r"[\s\x1c-\x1f]+")


def words(text: Column) -> Column:
    """The words of a text: what Unicode white space separates."""
    return F.filter(split_words(text), lambda w: w != "")


def fold(text: Column) -> Column:
    """Latin letters without their marks, modifier letters dropped, curly quotes straight."""

    def folded(t: Column) -> Column:
        plain = F.regexp_replace(F.translate(t, FOLD_FROM, FOLD_TO), COMBINING, "")
        return F.when(beyond_ascii(t), F.translate(plain, "’‘" + MODIFIERS, "''")).otherwise(t)

    return let(text, folded)


def fold_arabic(text: Column) -> Column:
    """Arabic text without vowel marks, with variant letters made one."""

    def folded(t: Column) -> Column:
        plain = F.translate(F.regexp_replace(t, ARABIC_MARKS, ""), LETTERS_FROM, LETTERS_TO)
        return F.when(beyond_ascii(t) & t.rlike(ARABIC), plain).otherwise(t)

    return let(text, folded)


def normal(text: Column) -> Column:
    """A text as overlap compares it: each word stripped at its ends, lower case, folded; one space between.

    Arabic letters are folded too, which the decomposition of the original order would
    prevent. Words are stripped one by one, the rest is done to whole texts.
    """
    stripped = F.transform(split_words(text), lambda w: F.btrim(w, F.lit(EDGE_CHARACTERS)))
    return fold_arabic(fold(F.lower(F.array_join(stripped, " "))))


def term_rows(texts: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """(keep, pos, term): a row for each word of ``tokens``, its place among what white space separates ahead of it.

    Words are cut first and folded as rows: compiled expressions, each step made once, instead of functions over arrays. The
    last step is a generator, through which the optimizer pushes no filter that would make the steps again.
    """
    rows = texts.select(*keep, F.posexplode(split_words(F.col(text))).alias("pos", "term"))
    rows = rows.withColumn("term", F.lower(F.btrim("term", F.lit(EDGE_CHARACTERS))))
    term = F.col("term")
    plain = F.regexp_replace(F.translate(term, FOLD_FROM, FOLD_TO), COMBINING, "")
    rows = rows.withColumn("term", F.when(beyond_ascii(term), F.translate(plain, "’‘" + MODIFIERS, "''")).otherwise(term))
    arabic = F.translate(F.regexp_replace(term, ARABIC_MARKS, ""), LETTERS_FROM, LETTERS_TO)
    rows = rows.withColumn("term", F.when(beyond_ascii(term) & term.rlike(ARABIC), arabic).otherwise(term))
    return rows.select(*keep, "pos", F.explode(F.array("term")).alias("term")).where("term <> ''")


def tokens(text: Column) -> Column:
    return F.filter(F.split(normal(text), " "), lambda w: w != "")


def _stopwords() -> list[str]:
    folded = [w.translate(str.maketrans(LETTERS_FROM, LETTERS_TO)) for w in ARABIC_STOPWORDS]
    return list(dict.fromkeys([*ARABIC_STOPWORDS, *folded, *ENGLISH_STOPWORDS]))


def query_terms(question: Column) -> Column:
    """The content words of a question, in order, repeats kept."""
    # A set, looked up once a word; an array of these words would be gone through for each.
    return F.filter(tokens(question), lambda t: ((F.length(t) >= 3) | t.rlike(ARABIC)) & ~t.isin(*_stopwords()) & ~t.rlike(r"(?U)^\d+$"))


def haystack(text: Column) -> Column:
    return normal(text)


def overlap(terms: Column, hay: Column) -> Column:
    """The part of the terms that occur in the text, 0 without terms."""
    found = let(hay, lambda h: F.size(F.filter(terms, lambda t: F.contains(h, t))))
    return F.when(F.size(terms) > 0, found / F.size(terms)).otherwise(F.lit(0.0))


def entities(question: Column) -> Column:
    """Names in a question: compound titles, sons of someone, places of origin."""
    compound = F.regexp_extract_all(question, F.lit(f"({COMPOUND_NAME})"), F.lit(1))
    sons = F.regexp_extract_all(question, F.lit(f"({SON_OF})"), F.lit(1))
    origin = F.filter(F.transform(words(question), lambda w: F.btrim(w, F.lit(EDGE_CHARACTERS))), lambda w: w.rlike(NISBA))
    return F.transform(F.concat(compound, sons, origin), lambda e: F.lower(fold_arabic(e)))


ENTITY_BOOST = 0.15


def entity_boost(names: Column, text: Column) -> Column:
    found = let(F.lower(fold_arabic(text)), lambda t: F.size(F.filter(names, lambda e: F.contains(t, e))))
    return F.when(F.size(names) > 0, ENTITY_BOOST * found / F.size(names)).otherwise(F.lit(0.0))


def for_id(text: Column) -> Column:
    """The form of a text that its identifier is made from: without marks, variant letters made one, in form C."""
    bare = lambda t: F.translate(F.regexp_replace(t, ID_MARKS, ""), LETTERS_FROM + MODIFIERS, LETTERS_TO)
    plain = let(text, lambda t: F.when(beyond_ascii(t), composed(bare(decomposed(t)))).otherwise(t))
    return F.lower(F.trim(F.regexp_replace(plain, r"(?U)\s+", " ")))


def claim_token(text: Column) -> Column:
    """A token as the alignment of claims compares it: form KC in lower case, Arabic without marks, one letter ahead and a closing alef."""

    def run(low: Column) -> Column:
        arabic = F.regexp_replace(F.translate(low, "أإآء", "ااا"), "[ً-ٰٟـ]", "")
        bare = let(arabic, lambda t: F.when((F.length(t) > 3) & t.rlike("^[وف]"), F.substring(t, 2, 1 << 20)).otherwise(t))
        ended = let(bare, lambda t: let(F.regexp_replace(t, "ا+$", ""), lambda cut: F.when((F.length(t) > 3) & t.endswith("ا") & (F.length(cut) >= 3), cut).otherwise(t)))
        return F.when(beyond_ascii(low) & low.rlike(f"^{ARABIC}+$"), ended).otherwise(low)

    return let(F.lower(let(text, lambda t: F.when(beyond_ascii(t), composed(t, compatible=True)).otherwise(t))), run)


def highlight_token(text: Column) -> Column:
    plain = F.regexp_replace(text, "[ً-ْٰـ،؛؟٠-٩]", "")
    return F.lower(F.regexp_replace(F.translate(plain, LETTERS_FROM, LETTERS_TO), "[^ء-يٱ-ۿA-Za-z0-9]", ""))


def count_of(text: Column, characters: str) -> Column:
    """How many characters of a class a text has."""
    return F.length(text) - F.length(F.regexp_replace(text, characters, ""))


def script_language(text: Column) -> Column:
    """Language by script: Urdu signs, else whichever of Latin and Arabic letters lead.

    Of presentation forms only the later block (FE70 to FEFF) counts as Urdu; the earlier one has ligatures of Arabic texts.
    """
    latin, arabic = count_of(text, "[A-Za-z]"), count_of(text, ARABIC)
    return F.when(text.rlike(URDU_LETTERS) | text.rlike(URDU_WORDS), "ur").when((latin > 0) & (latin >= arabic), "en").otherwise("ar")


def answer_language(text: Column) -> Column:
    latin, arabic, urdu = count_of(text, "[A-Za-z]"), count_of(text, ARABIC), count_of(text, URDU_SPECIFIC)
    return F.when(arabic == 0, "en").when(urdu >= F.greatest(F.lit(3), F.floor(arabic / 10)), "ur").when(latin > arabic, "en").otherwise("ar")


def is_source_question(question: Column) -> Column:
    return F.coalesce(question, F.lit("")).rlike(SOURCE_QUESTION)


def keyword_queries(original: Column, english: Column, fallback: Column) -> tuple[Column, Column]:
    """A keyword query for each script: the first, and the second or null."""
    first, second = F.array_join(query_terms(original), " "), F.nullif(F.array_join(query_terms(english), " "), F.lit(""))
    primary = F.coalesce(F.nullif(first, F.lit("")), second, F.nullif(english, F.lit("")), fallback)
    return primary, F.when(second != primary, second)


def keyword_query(original: Column, english: Column, fallback: Column) -> Column:
    both = F.array_join(F.array_distinct(F.concat(query_terms(original), query_terms(english))), " ")
    return F.coalesce(F.nullif(both, F.lit("")), F.nullif(english, F.lit("")), fallback)


def embedding_text(*parts: Column) -> Column:
    """The distinct non-empty forms of a question in one text."""
    return F.array_join(F.array_distinct(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != ""))), " ")


HEADING_MARK = r"(?U)^[*#\-•·_\s]+"
NUMBER_MARK = r"(?U)^\d+[.)،]?\s*"
LETTER = "[A-Za-z؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿]"


def heading(line: Column) -> Column:
    """A line as a heading, or null: two to eight words, no closing punctuation, no opening bracket."""
    text = F.trim(F.regexp_replace(F.trim(line), HEADING_MARK, ""))
    text = F.trim(F.regexp_replace(text, NUMBER_MARK, ""))
    text = F.trim(F.regexp_replace(text, r"[*#]+$", ""))
    count = F.size(words(text))
    good = (text != "") & ~text.rlike("^[(\\[\"'“”«»]") & ~text.rlike("[.۔!?؟:,،;؛]$") & text.rlike(LETTER)
    return F.when(good & count.between(2, 8) & (F.length(text) < 50), text)


CHAPTER_WORDS = ("باب", "كتاب", "الفصل")


def chapter(line: Column) -> Column:
    """A heading that opens a chapter: by its first word, or if that is all capitals."""
    text = heading(line)
    first = F.element_at(words(text), 1)
    letters = F.regexp_replace(first, r"(?U)[^\p{L}]", "")
    return F.when(first.isin(*CHAPTER_WORDS) | ((letters != "") & (letters == F.upper(letters)) & (letters != F.lower(letters))), text)


def is_colon_heading(line: Column) -> Column:
    """A short line that ends in a colon and so begins a paragraph."""
    text = F.trim(line)
    inner = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(text, HEADING_MARK, ""), ":+$", "")), NUMBER_MARK, ""))
    return text.endswith(":") & (inner != "") & inner.rlike(LETTER) & (F.size(words(inner)) <= 12) & (F.length(inner) <= 60)


def ends_sentence(word: Column) -> Column:
    return word.rlike(r"[.۔!?؟]\n?\z")


def without_markup(line: Column) -> Column:
    """A line without emphasis marks and list markers (a number with a dot goes wherever it stands)."""
    bare = F.regexp_replace(F.trim(line), r"(?U)^[#>*\-]+\s*|\d+[.)]\s*", "")
    return F.translate(F.regexp_replace(bare, r"\*\*|__", ""), "`*#", "")
