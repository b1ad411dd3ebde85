"""Licence scan by canonical digests.

A text is put into a canonical form: lower case, copyright lines dropped, equivalent spellings
made one, punctuation and white space reduced to single spaces. Its SHA-256 is then looked up
among the digests of known licence texts and notices by a hash join. The units compared are
entire texts: the document, each of its lines, and each run of as many paragraphs as a known
text may have. Built-in functions only; the same expressions make the digests of the known texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import require, text_or_empty

#: Broadcast the known digests up to this many; a larger catalogue is joined by shuffle.
BROADCAST_TEXTS = 50_000

#: Spellings that count as equal, each replaced by the second.
SPELLINGS = [
    ("licence", "license"),
    ("licencing", "licensing"),
    ("licenced", "licensed"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("favour", "favor"),
    ("behaviour", "behavior"),
    ("non-infringement", "noninfringement"),
    ("sub-license", "sublicense"),
    ("copyright holder", "copyright owner"),
    ("per cent", "percent"),
    ("https:", "http:"),
    ("&", "and"),
]
COPYRIGHT_LINE = r"(^|\n)[ \t#*/;.-]*(copyright|\(c\)|©)[^\n]*[0-9]{4}[^\n]*"
PUNCTUATION = r"[^\p{L}\p{N}]+"

#: Known licence texts and the usual notices, by SPDX identifier.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
]


#: What stands between paragraphs, and the most paragraphs of a known text.
BLANK_LINE = "\n[ \t]*\n"
PARAGRAPHS = max(text.count("\n\n") + 1 for _, text in KNOWN)

#: The digest of nothing, which no known text has.
NOTHING = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def with_digest(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the SHA-256 of the canonical form of a column.

    Each step is a projection of its own, so that what a step uses twice is made once, and
    the result is never null, so that no join adds a null test that would make it again.
    """
    low = df.withColumn("_form", F.lower(F.col(text)))
    form = F.col("_form")
    marked = F.contains(form, F.lit("copyright")) | F.contains(form, F.lit("(c)")) | F.contains(form, F.lit("©"))
    out = F.when(marked, F.regexp_replace(form, COPYRIGHT_LINE, " ")).otherwise(form)
    for one, other in SPELLINGS:
        if one != other:
            out = F.replace(out, F.lit(one), F.lit(other))
    out = F.trim(F.regexp_replace(out, PUNCTUATION, " "))
    return low.withColumn(name, F.coalesce(F.sha2(out, 256), F.lit(NOTHING))).drop("_form")


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license), one row per distinct digest; of several licences the first by name."""
    rows = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in (KNOWN if known is None else known)])
    listed = spark.range(1).select(F.inline(rows)) if (KNOWN if known is None else known) else spark.range(0).selectExpr("'' AS license", "'' AS text")
    # A test of both columns: one of the digest alone would be inferred for the documents' side
    # of the join and make their digests twice.
    some = F.concat("known", "license") != F.concat(F.lit(NOTHING), F.col("license"))
    return with_digest(listed, "text", "known").where(some).groupBy("known").agg(F.min("license").alias("license"))


def _units(text: Column, paragraphs: int) -> Column:
    """The lines of a text and its runs of one to some paragraphs, each once."""
    single = F.split(text, BLANK_LINE)

    def runs(n: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(single) - n + 1), lambda k: F.array_join(F.slice(single, k, n), "\n\n"))
        return F.when(F.size(single) >= n, each).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(F.split(text, "\n"), single, *[runs(n) for n in range(2, paragraphs + 1)]))


def scan(docs: DataFrame, known: DataFrame | None = None, paragraphs: int = PARAGRAPHS) -> DataFrame:
    """doc_id, text_digest, license, n_notices and notices of every row.

    ``license`` is set where the entire text of the row is a known licence text;
    ``n_notices`` counts the distinct known texts among its lines and runs of up to ``paragraphs``
    paragraphs, and ``notices`` names their licences, sorted. ``known`` is a table (known, license)
    of digests, the built-in catalogue unless given; of several licences of a digest the first by
    name counts.

    A null text counts as empty; a text of which nothing is left in canonical form has the
    digest of the empty text and matches nothing. Every row, also one with a null or repeated
    ``doc_id``, has the notices of its own text. Very long texts are scanned whole, an empty table
    gives an empty result, other columns are not read.
    """
    require(docs, ["doc_id", "text"])
    spark = docs.sparkSession
    catalogue = known_digests(spark) if known is None else known.groupBy("known").agg(F.min("license").alias("license"))
    if known is None or known.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS:
        catalogue = F.broadcast(catalogue)
    text = text_or_empty()
    # Rows of one id and one text have the same notices.
    own = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64(text))
    parts = with_digest(docs.select(own.alias("own"), F.explode(_units(text, paragraphs)).alias("unit")), "unit", "known").select("own", "known")
    hits = parts.join(catalogue, "known").groupBy(F.col("own").alias("hit")).agg(F.countDistinct("known").alias("n_notices"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    whole = with_digest(docs.select("doc_id", own.alias("own"), text.alias("whole")), "whole", "text_digest").select("doc_id", "own", "text_digest")
    whole = whole.join(catalogue.withColumnRenamed("known", "text_digest"), "text_digest", "left")
    found = whole.join(hits, whole["own"] == hits["hit"], "left")
    return found.select("doc_id", "text_digest", "license", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))


def duckdb_sql() -> str:
    """The same scan as DuckDB SQL."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def canonical_sql(text: str) -> str:
        out = f"regexp_replace(lower({text}), {quoted(COPYRIGHT_LINE)}, ' ', 'g')"
        for one, other in SPELLINGS:
            if one != other:
                out = f"replace({out}, {quoted(one)}, {quoted(other)})"
        return f"trim(regexp_replace({out}, {quoted(PUNCTUATION)}, ' ', 'g'))"

    single = "string_split_regex(coalesce(text, ''), '\\n[ \\t]*\\n')"
    runs = "".join(f", list_transform(range(1, len({single}) - {n - 2}), lambda k: array_to_string({single}[k : k + {n - 1}], chr(10) || chr(10)))" for n in range(2, PARAGRAPHS + 1))
    values = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in KNOWN)
    return f"""
WITH known AS (SELECT sha256(form) AS known, min(license) AS license FROM (SELECT license, {canonical_sql('text')} AS form FROM (VALUES {values}) AS k(license, text)) WHERE form <> '' GROUP BY 1),
units AS (SELECT DISTINCT own, unnest(list_concat(string_split(coalesce(text, ''), chr(10)), {single}{runs})) AS unit FROM (SELECT md5(coalesce(text, '')) AS own, text FROM documents)),
forms AS (SELECT own, {canonical_sql('unit')} AS form FROM units),
hits AS (SELECT own, count(DISTINCT known) AS n, array_to_string(list_sort(list(DISTINCT license)), ',') AS notices FROM forms JOIN known ON sha256(form) = known WHERE form <> '' GROUP BY own),
whole AS (SELECT doc_id, own, sha256(form) AS text_digest FROM (SELECT doc_id, md5(coalesce(text, '')) AS own, {canonical_sql("coalesce(text, '')")} AS form FROM documents))
SELECT w.doc_id, w.text_digest, k.license, coalesce(h.n, 0) AS n_notices, coalesce(h.notices, '') AS notices
FROM whole w LEFT JOIN known k ON w.text_digest = k.known LEFT JOIN hits h ON h.own = w.own
"""
