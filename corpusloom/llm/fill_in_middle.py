"""Fill-in-middle transformation over run-length encoded character classes.

A text is stored as its maximal runs of characters of one class, each run with the number of
units that have ended by its end. A cut after k units is found by binary search over these
counts: it lies in the first run that reaches k, and where in that run is arithmetic, as a
run ends its units at every character, once, or not at all. A text of a million lines costs
its runs and two searches, no unit is ever made.

Units are lines, words or characters. Texts are cut whole, in the row that holds them; what
Python returns of a text is four numbers, the pieces are put together by the engine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import require, text_or_empty

#: How the characters of a run end units: each of them one, all of them one, or none (the end of the text then ends one).
EACH, ONCE, NONE = 0, 1, 2
NEWLINE = 10
#: Code points that count as white space between words.
BLANKS = (9, 10, 11, 12, 13, 32)
#: Classes of characters by unit, as the rule of class 0 (all other characters) and of class 1.
RULES = {"line": (NONE, EACH), "word": (ONCE, ONCE), "char": (EACH, EACH)}
#: What marks the beginning of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Runs:
    """The maximal runs of one class of a text: where each starts, its rule, and the units ended by its end."""

    starts: np.ndarray
    rules: np.ndarray
    ended: np.ndarray
    length: int

    @property
    def units(self) -> int:
        return int(self.ended[-1]) if len(self.ended) else 0

    def cut(self, units: int) -> int:
        """The offset, in code points, after so many units."""
        if units <= 0:
            return 0
        run = int(np.searchsorted(self.ended, units))
        stop = int(self.starts[run + 1]) if run + 1 < len(self.starts) else self.length
        if self.rules[run] != EACH:
            return stop
        return stop - (int(self.ended[run]) - units)


def encode_runs(text: str, unit: str = "line") -> Runs:
    """The runs of a text; a character is in class 1 if it is a newline (lines) or blank (words)."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    if not len(points):
        none = np.zeros(0, dtype=np.int64)
        return Runs(none, none, none, 0)
    marked = points == NEWLINE if unit == "line" else np.isin(points, BLANKS) if unit == "word" else np.zeros(len(points), dtype=bool)
    starts = np.concatenate([[0], np.flatnonzero(marked[1:] != marked[:-1]) + 1])
    rules = np.where(marked[starts], RULES[unit][1], RULES[unit][0])
    sizes = np.diff(np.concatenate([starts, [len(points)]]))
    ended = np.where(rules == EACH, sizes, np.where(rules == ONCE, 1, 0))
    if rules[-1] == NONE:  # the last line has no newline
        ended[-1] = 1
    return Runs(starts, rules, np.cumsum(ended), len(points))


def _cuts(unit: str):
    @F.pandas_udf("struct<units long, length long, first long, second long>")
    def cuts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, ones, others in batches:
            rows = []
            for text, one, other in zip(texts, ones, others):
                runs = encode_runs(text, unit)
                a, b = sorted((int(one) % (runs.units + 1), int(other) % (runs.units + 1)))
                rows.append((runs.units, runs.length, runs.cut(a), runs.cut(b)))
            yield pd.DataFrame(rows, columns=["units", "length", "first", "second"], dtype="int64")

    # Said not to be deterministic so that no plan cuts a text twice.
    return cuts.asNondeterministic()


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from the SHA-256 of seed and id; a null id counts as empty."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(key, 8 * n + 1, 8), 16, 10).cast("long") for n in range(4)]


def fill_in_middle(docs: DataFrame, unit: str = "line", seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of (doc_id, text).

    ``n`` counts the units of a text, whose cuts are drawn from ``seed`` and doc_id. ``rate`` of a
    hundred texts are transformed, of these ``spm_rate`` with the suffix first; a text that is empty
    or holds one of the marks stays as it is, its form is plain and its lengths are null.

    A null text counts as empty; repeated rows are cut alike; a null id is drawn for like the
    empty id; other columns are not read, whatever their names; an empty table gives an empty result.
    """
    require(docs, ["doc_id", "text"])
    if unit not in RULES:
        raise ValueError(f"no unit {unit}; there are {sorted(RULES)}")
    one, other, chosen, order = draws(F.col("doc_id"), seed)
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    rows = rows.withColumn("cut", _cuts(unit)("text", one, other))
    text, first, second = F.col("text"), F.col("cut.first"), F.col("cut.second")
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(text, F.lit(mark))
    plain = (text == "") | marked | (chosen % 100 >= rate)
    form = F.when(plain, PLAIN).when(order % 100 < spm_rate, SPM).otherwise(PSM)
    piece = lambda start, stop: F.substr(text, (start + 1).cast("int"), (stop - start).cast("int"))
    prefix, middle, suffix = piece(F.lit(0), first), piece(first, second), piece(second, F.col("cut.length"))
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    output = F.when(form == PLAIN, text).when(form == SPM, F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.concat(p, prefix, s, suffix, m, middle))
    return rows.select(
        "doc_id", F.col("cut.units").alias("n"), form.alias("form"), F.when(form != PLAIN, first).alias("prefix_chars"),
        F.when(form != PLAIN, second - first).alias("middle_chars"), output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from; no mark can begin inside a piece and end outside it."""
    at = {mark: F.instr(output, mark) for mark in (PREFIX, SUFFIX, MIDDLE)}
    size = len(PREFIX)
    piece = lambda start, stop: F.substr(output, start, stop - start)
    end = F.length(output) + 1
    psm = F.concat(piece(F.lit(size + 1), at[SUFFIX]), piece(at[MIDDLE] + size, end), piece(at[SUFFIX] + size, at[MIDDLE]))
    spm = F.concat(piece(at[PREFIX] + size, at[MIDDLE]), piece(at[MIDDLE] + size, end), piece(F.lit(size + 1), at[PREFIX]))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def digests(transformed: DataFrame) -> DataFrame:
    """``fill_in_middle``'s rows with the SHA-256 of the output and of the text rebuilt from it in place of the output."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return transformed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def duckdb_sql(seed: int = 7, rate: int = 100, spm_rate: int = 50) -> str:
    """The digests of ``documents`` cut at lines, in SQL."""
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {rate} THEN 'plain' WHEN h4 % 100 < {spm_rate} THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS x, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:n], ''), '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || x || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
