"""Unicode normal forms in the JVM, by the library that Spark ships for its collations.

The calls go through ``java_method``; a plan with them stays free of Python, also inside lambdas.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NORMALIZER = "com.ibm.icu.text.Normalizer"


def _called(method: str, text: Column, compatible: bool) -> Column:
    # The method takes no null.
    return F.when(text.isNotNull(), F.java_method(F.lit(_NORMALIZER), F.lit(method), F.coalesce(text, F.lit("")), F.lit(compatible)))


def decomposed(text: Column, compatible: bool = False) -> Column:
    """Form D, or form KD: every character as its letter and marks, marks in their order; null stays null."""
    return _called("decompose", text, compatible)


def composed(text: Column, compatible: bool = False) -> Column:
    """Form C, or form KC: letters and marks as one character where there is one; null stays null."""
    return _called("compose", text, compatible)
