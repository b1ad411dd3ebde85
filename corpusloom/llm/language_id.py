"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are combined for a document or page: the likelihood of its text under
a byte-trigram model of each language, the language its markup declares, the suffix of its
address, and the prior of its host. Host priors are smoothed in a hierarchy, host towards
domain towards the whole corpus, from counts that a grouped aggregation makes of the
text-only posteriors; a row's own posterior is taken out of its host's counts again.

``und`` is a language too: text that no model explains better than chance. Rows that come out
as ``und`` or whose posterior stays below ``ACCEPT`` are rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType

from corpusloom.llm.common import checkpoint, forget, join_hot, require, text_or_empty

#: Text models: labelled rows and bytes learnt from per language. A model takes ``BUCKETS``
#: numbers a language; more languages than this are refused, none is left out.
SAMPLE_ROWS = 1000
SAMPLE_BYTES = 4 << 20
LANGUAGES = 1024
#: The draw looks at this many times as many rows as it takes.
DRAW_FROM = 20
#: Hashed byte trigrams, and the pseudo-count of each.
BUCKETS = 1 << 15
PSEUDO = 0.05
#: Bytes of a text that are looked at once, so that a long text takes no more memory than this.
PIECE = 1 << 18
#: Overlapping trigrams are not independent: what one is worth as evidence.
TEMPER = 0.3
#: Pseudo-rows that a host has from its domain and a domain from the corpus.
STRENGTH = 5.0
#: Prior probability that a text is in no known language, and the posterior a row needs.
UNKNOWN = 0.001
ACCEPT = 0.5
UND = "und"


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    #: Log probability of each bucket by language; the last language is ``und``.
    logs: np.ndarray

    def likelihoods(self, text: bytes) -> np.ndarray:
        total = np.zeros(len(self.languages))
        for grams in trigrams(text):
            if len(grams) < BUCKETS:
                total += self.logs[:, grams].sum(axis=1, dtype=np.float64)
            else:
                total += self.logs @ np.bincount(grams, minlength=BUCKETS).astype(np.float64)
        return TEMPER * total


def trigrams(text: bytes) -> Iterator[np.ndarray]:
    """Hashed trigrams of the letters of a text, a piece at a time; ASCII digits and punctuation are left out."""
    # One space stands before, after and between words; two bytes go over from piece to piece.
    held = np.array([32], dtype=np.int64)
    for low in range(0, len(text), PIECE):
        own = np.frombuffer(text[low : low + PIECE].lower().translate(_LETTERS), dtype=np.uint8)
        letter = own != 32
        before = np.concatenate([[held[-1] != 32], letter[:-1]])
        own = np.concatenate([held, own[letter | before].astype(np.int64)])
        if len(own) > 2:
            yield ((own[:-2] * 65599 + own[1:-1]) * 65599 + own[2:]) % 1_000_003 % BUCKETS
        held = own[-2:]
    if held[-1] != 32 and len(held) == 2:
        yield ((held[:1] * 65599 + held[1:]) * 65599 + 32) % 1_000_003 % BUCKETS


_LETTERS = bytes(n if n >= 128 or chr(n).isalpha() else 32 for n in range(256))


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, n_bytes: int = SAMPLE_BYTES) -> TextModel:
    """A text model of every ``lang`` from a bounded sample of its rows.

    Per language the ``rows`` rows smallest by a hash of id and text are drawn, of these as many whole
    texts as fit ``n_bytes``. Rows that repeat id and text are one before anything is drawn or counted. Only
    hashes below a bound go into the draw, some times as many as are drawn, so that its task stays small.
    """
    require(docs, ["doc_id", "text", "lang"])
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_or_empty())
    own = docs.where(F.col("lang").isNotNull() & (F.col("lang") != UND)).select("lang", key.alias("key"), text_or_empty().alias("text"))
    counts_of = own.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).limit(LANGUAGES + 1).collect()
    languages = sorted(r["lang"] for r in counts_of)
    if len(languages) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    order = Window.partitionBy("lang").orderBy("key")
    below = {r["lang"]: min(1.0, DRAW_FROM * rows / r["n"]) for r in counts_of}
    bounds = docs.sparkSession.createDataFrame([(lang, min(2**63 - 1, int((2 * part - 1) * 2**63))) for lang, part in below.items()], "lang string, bound long")
    small = own.select("lang", "key", F.octet_length("text").alias("n")).join(F.broadcast(bounds), "lang").where("key <= bound")
    small = small.groupBy("lang", "key").agg(F.min("n").alias("n"))
    drawn = small.withColumn("place", F.row_number().over(order)).where(F.col("place") <= rows)
    drawn = drawn.withColumn("used", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("used") <= n_bytes)
    drawn = checkpoint(drawn.select("lang", "key"))
    counts = np.full((len(languages) + 1, BUCKETS), PSEUDO)
    number = {language: n for n, language in enumerate(languages)}
    # At most ``rows`` keys a language are broadcast, and one text comes back for each.
    texts = own.join(F.broadcast(drawn), ["lang", "key"], "left_semi").groupBy("lang", "key").agg(F.min("text").alias("text"))
    for r in texts.toLocalIterator():
        for grams in trigrams(r["text"].encode()):
            counts[number[r["lang"]]] += np.bincount(grams, minlength=BUCKETS)
    logs = np.log(counts / counts.sum(axis=1, keepdims=True))
    logs[-1] = -math.log(BUCKETS)
    return TextModel((*languages, UND), logs.astype(np.float32))


def html_evidence(pages: DataFrame) -> DataFrame:
    """page_id as ``id``, with the text, declared language, host and domain of raw pages."""
    require(pages, ["page_id", "url", "html"])
    html, url = F.coalesce(F.col("html"), F.lit("")), F.coalesce(F.col("url"), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|title|nav)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>|&[#\w]+;", " ")
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return pages.select(F.col("page_id").alias("id"), text.alias("text"), F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1)).alias("declared"), F.when(host != "", host).alias("host"))


def document_evidence(docs: DataFrame) -> DataFrame:
    """doc_id as ``id``, with text and source as host; documents declare no language."""
    require(docs, ["doc_id", "text"])
    host = F.col("source") if "source" in docs.columns else F.lit(None)
    return docs.select(F.col("doc_id").alias("id"), text_or_empty().alias("text"), F.lit("").alias("declared"), host.cast("string").alias("host"))


def _text_log(model: TextModel, text: Column) -> Column:
    """The log likelihoods of a text by language, the best of them 0; only the text goes to Python. Null is empty."""

    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            own = [model.likelihoods(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts]
            yield pa.array([(x - x.max()).tolist() for x in own], pa.list_(pa.float64()))

    # Said not to be deterministic so that no plan scores a text twice.
    return arrow_udf(of, ArrayType(DoubleType())).asNondeterministic()(text.cast("binary"))


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    powers = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def _scored(evidence: DataFrame, model: TextModel) -> DataFrame:
    return evidence.select("kind", F.col("id").cast("long").alias("id"), "declared", "host", _text_log(model, F.col("text")).alias("text_log"))


def _own(model: TextModel) -> Column:
    """The posterior by text alone."""
    n = len(model.languages)
    flat = F.array(*[F.lit(math.log((1 - UNKNOWN) / max(n - 1, 1)))] * (n - 1), F.lit(math.log(UNKNOWN)))
    return _softmax(F.zip_with("text_log", flat, lambda a, b: a + b))


def _log_rates(sums: DataFrame, key: str, n: int) -> DataFrame:
    """(key, ``rates``): log P(key | language) of every key from (key, rows, sums), smoothed by half a row."""
    total = sums.agg(F.count("*"), *[F.sum(F.col("sums")[k]) for k in range(n)]).first()
    whole = F.array(*[F.lit(float((x or 0.0) + 0.5 * max(total[0], 1))) for x in total[1:]])
    return sums.select(key, "rows", F.zip_with("sums", whole, lambda a, b: F.log((a + 0.5) / b)).alias("rates"))


@dataclass(frozen=True)
class Context:
    """What hosts, address suffixes and markup say about languages, from all rows of the evidence."""

    model: TextModel
    corpus: list[float]
    #: host, host_rows, host_sums, domain_rows, domain_sums, suffix_rates.
    hosts: DataFrame
    #: declared, declared_rates.
    declared: DataFrame


def context(scored: DataFrame, model: TextModel) -> Context:
    """The grouped aggregation behind the priors; ``scored`` has kind, id, declared, host and text_log."""
    n = len(model.languages)
    rows = scored.withColumn("own", _own(model))
    sums = [F.sum(F.col("own")[k]) for k in range(n)]
    address = F.col("host").contains(".")
    domain = F.when(address, F.concat_ws(".", F.slice(F.split("host", r"\."), -2, 2))).otherwise(F.lit("-"))
    suffix = F.when(address, F.element_at(F.split("host", r"\."), -1)).otherwise("")
    hosts = checkpoint(rows.where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("host_rows"), F.array(*sums).alias("host_sums")).withColumn("domain", domain).withColumn("suffix", suffix))
    of_hosts = [F.sum(F.col("host_sums")[k]) for k in range(n)]
    domains = checkpoint(hosts.groupBy("domain").agg(F.sum("host_rows").alias("domain_rows"), F.count("*").alias("domain_hosts"), F.array(*of_hosts).alias("domain_sums")))
    suffixes = checkpoint(hosts.where("suffix <> ''").groupBy("suffix").agg(F.count("*").alias("rows"), F.array(*of_hosts).alias("sums")))
    suffixes = checkpoint(_log_rates(suffixes, "suffix", n).withColumnsRenamed({"rows": "suffix_hosts", "rates": "suffix_rates"}))
    facts = join_hot(join_hot(hosts, domains, "domain", "domain_hosts", F.col("host")), suffixes, "suffix", "suffix_hosts", F.col("host"))
    facts = checkpoint(facts.drop("domain", "domain_hosts", "suffix", "suffix_hosts"))
    declared = checkpoint(rows.where("declared <> ''").groupBy("declared").agg(F.count("*").alias("rows"), F.array(*sums).alias("sums")))
    declared = checkpoint(_log_rates(declared, "declared", n).select("declared", F.col("rates").alias("declared_rates")))
    total, *all_sums = rows.agg(F.count("*"), *sums).first()
    corpus = [((x or 0.0) + STRENGTH / n) / ((total or 0) + STRENGTH) for x in all_sums]
    return Context(model, corpus, facts, declared)


def judge(scored: DataFrame, known: Context, spread: Column) -> DataFrame:
    """``scored`` (declared, host, text_log and others) with language, posterior, text_language and kept.

    A row's own share is taken out of what its host and domain say. ``spread`` deals the rows of hot hosts.
    """
    n = len(known.model.languages)
    zero, corpus = F.array(*[F.lit(0.0)] * n), F.array(*[F.lit(x) for x in known.corpus])
    joined = join_hot(scored.withColumn("own", _own(known.model)), known.hosts, "host", "host_rows", spread)
    joined = joined.join(F.broadcast(known.declared), "declared", "left")  # codes of two or three letters: at most 18252
    domain_prior = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (F.get("domain_sums", k) - F.get("own", k) + STRENGTH * F.get(corpus, k)) / (F.col("domain_rows") - 1 + STRENGTH))
    joined = joined.withColumn("domain_prior", F.when(F.col("host").isNull() | (F.col("domain_rows") < 1), corpus).otherwise(domain_prior))
    host_prior = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (F.coalesce(F.get("host_sums", k) - F.get("own", k), F.lit(0.0)) + STRENGTH * F.get("domain_prior", k)) / (F.coalesce(F.col("host_rows") - 1, F.lit(0)) + STRENGTH))
    joined = joined.withColumn("prior", F.transform(host_prior, lambda x: F.log(F.greatest(x, F.lit(1e-6)))))
    fused = F.col("text_log")
    for part in (F.col("prior"), F.coalesce("suffix_rates", zero), F.coalesce("declared_rates", zero)):
        fused = F.zip_with(fused, part, lambda a, b: a + b)
    said = joined.withColumn("posterior_all", _softmax(fused))
    names = F.array(*[F.lit(x) for x in known.model.languages])
    best = F.array_max("posterior_all")
    text_language = F.when(F.col("text_log") != zero, F.get(names, F.array_position("own", F.array_max("own")).cast("int") - 1))
    others = [c for c in scored.columns if c not in ("declared", "host", "text_log")]
    # Of languages that are equally likely the first by name is said.
    said = said.select(*others, F.get(names, F.array_position("posterior_all", best).cast("int") - 1).alias("language"), best.alias("posterior"), F.coalesce(text_language, F.lit(UND)).alias("text_language"))
    return said.withColumn("kept", (F.col("language") != UND) & (F.col("posterior") >= ACCEPT))


def fuse(evidence: DataFrame, model: TextModel) -> DataFrame:
    """kind, id, language, posterior, text_language and kept of every row of ``evidence``.

    ``evidence`` has kind, id, text, declared ("" for none) and host (null for none); the
    functions above make it. A row without letters has no text evidence and takes what its
    markup, address and host say if they say enough, else it is rejected as ``und``. Of languages
    that tie the first by name is given. Repeated rows count each time in their host's prior; a
    null id is no obstacle; texts are read whole, however long; an empty table gives an empty
    result; further columns, whatever their names, are not read.
    """
    scored = checkpoint(_scored(evidence, model).withColumn("row", F.monotonically_increasing_id()))
    return judge(scored, context(scored, model), F.col("row")).drop("row")


def identify_documents(docs: DataFrame, model: TextModel | None = None) -> DataFrame:
    """``fuse`` over documents alone."""
    return fuse(document_evidence(docs).withColumn("kind", F.lit("document")), model or fit(docs))


def identify(docs: DataFrame, pages: DataFrame, model: TextModel | None = None) -> DataFrame:
    """``fuse`` over documents and raw pages together, so that they share what hosts say."""
    evidence = document_evidence(docs).withColumn("kind", F.lit("document")).unionByName(html_evidence(pages).withColumn("kind", F.lit("page")))
    return fuse(evidence, model or fit(docs))


def keep_known(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that are in no known language, columns unchanged.

    Each row is judged by its own text and source, so null or repeated ids and repeated rows
    make no difference; other cases as in ``fuse``.
    """
    model = fit(docs)
    scored = checkpoint(_scored(document_evidence(docs).withColumn("kind", F.lit("document")), model))
    known = context(scored, model)
    forget(scored)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    host = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(whole.alias("all"), F.lit("").alias("declared"), host.alias("host"), _text_log(model, F.col("text")).alias("text_log"))
    kept = judge(rows, known, F.xxhash64("all.doc_id", "text_log")).where("kept").select("all.*")
    return kept.to(docs.schema)
