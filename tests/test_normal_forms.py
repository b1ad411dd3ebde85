"""Normal forms, identifiers and claim tokens against Python's own forms."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import normal_forms
from corpusloom.functions import text as T
from corpusloom.operators import citations

BLOCKS = [(0x20, 0x250), (0x2B0, 0x370), (0x600, 0x700), (0x750, 0x780), (0x8A0, 0x900), (0x1E00, 0x1F00), (0xFB00, 0xFB07), (0xFB50, 0xFE00), (0xFE70, 0xFF00)]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(1)
    own = [chr(c) for low, high in BLOCKS for c in range(low, high) if unicodedata.category(chr(c)) != "Cn"]
    marks = [c for c in own if unicodedata.combining(c)]
    mixed = ["".join(rng.choice(own if rng.random() < 0.5 else marks) for _ in range(rng.randrange(1, 9))) for _ in range(2000)]
    rows = [*own, *mixed, "", None, "\U0001f600é", "a﷐é"]
    return spark.createDataFrame(list(enumerate(rows)), "n int, t string").repartition(4).persist()


def test_forms_are_those_of_python(texts):
    made = {"NFD": normal_forms.decomposed(F.col("t")), "NFKD": normal_forms.decomposed(F.col("t"), True), "NFC": normal_forms.composed(F.col("t")), "NFKC": normal_forms.composed(F.col("t"), True)}
    for row in texts.select("t", *[c.alias(k) for k, c in made.items()]).collect():
        for form in made:
            assert row[form] == (None if row["t"] is None else unicodedata.normalize(form, row["t"])), (form, ascii(row["t"]))


def test_claim_tokens_are_those_of_the_alignment(texts):
    """The column form and the form that the alignment uses in its batches agree on every token."""
    for row in texts.select("t", T.claim_token(F.col("t")).alias("v")).where("t IS NOT NULL").collect():
        if re.fullmatch("[A-Za-z0-9]+|[؀-ۿ]+", row["t"]):
            assert row["v"] == citations.normal(row["t"]), ascii(row["t"])


def test_identifier_form(texts):
    marks = re.compile("[ً-ٰٕـ̀-ͯ]")
    for row in texts.select("t", T.for_id(F.col("t")).alias("v")).where("t IS NOT NULL").collect():
        plain = marks.sub("", unicodedata.normalize("NFD", row["t"])).translate(str.maketrans("أإآىةؤئ", "ااايهوي", "ʿʾʼʻ"))
        plain = re.sub(r"\s+", " ", unicodedata.normalize("NFC", plain)).strip(" ").lower()
        if not set(plain) & set("\x1c\x1d\x1e\x1f\x85ßİ"):
            assert row["v"] == plain, ascii(row["t"])


def test_an_id_makes_its_name_once(spark):
    from pyspark.sql import functions as F

    from corpusloom.functions import ids

    plan = spark.range(1).select(ids.chunk_id(F.col("id").cast("string"), F.lit(1), F.lit(2)).alias("own"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha1(") == 1, plan
