"""Identifiers and keys, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import for_id, let

#: The DNS name space of RFC 4122.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """The version-5 UUID of a name in the DNS name space."""
    digest = F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE)), F.encode(name, "UTF-8")))

    def laid_out(digest: Column) -> Column:
        nibble = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
        variant = F.lower(F.hex((nibble % 4 + 8).cast("long")))
        return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))

    # Bound once: a name may go through ``java_method``, which Spark makes again wherever it stands.
    return let(digest, laid_out)


def chunk_id(text: Column, page_start: Column, page_end: Column) -> Column:
    """The identifier of a passage; variants of spelling give the same."""
    return uuid5(F.concat_ws("|", for_id(text), page_start.cast("string"), page_end.cast("string")))


def cache_key(tenant: Column, question: Column, book: Column) -> Column:
    return F.concat(F.lit("cache:"), tenant, F.lit(":b:"), F.coalesce(book, F.lit("*")), F.lit(":"), F.sha2(F.lower(F.trim(question)), 256))


def token_hash(token: Column) -> Column:
    return F.sha2(token, 256)


def snippet_suffix(snippet: Column) -> Column:
    return F.concat(F.lit("t"), F.substring(F.sha1(snippet), 1, 16))
