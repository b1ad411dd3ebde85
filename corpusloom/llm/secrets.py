"""Secrets in texts, with structural confirmation.

Plain patterns find assignments, access keys and long hexadecimal numbers. Beyond these, runs
of base64 or hexadecimal digits are decoded, and a span is reported only if what comes out has
the structure of a secret: a private key whose nested lengths (tag and length in DER, length
and field in OpenSSH's format) add up to the last byte, a signed token whose header names an
algorithm and whose signature has that algorithm's size, or text that holds an assignment or
access key itself. Random digits of the right look pass none of these.

Texts are scanned whole, each in its own row; nothing is shuffled.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import require, text_or_empty

ASSIGN, ACCESS, HEX = "assign", "access", "hex"
TOKEN, KEY, CODED = "token", "key", "coded"
#: The kinds in the order in which spans of one start are listed; the first three are the base.
KINDS = (ASSIGN, ACCESS, HEX, TOKEN, KEY, CODED)
BASE = KINDS[:3]

# What base secrets look like, and how long they are at least.
_ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_VALUE = 12
_ACCESS = re.compile("AKIA[A-Z0-9]{14,}")  # 18 characters or more
_HEX = re.compile("(?<![0-9a-f])[0-9a-f]{16,}")

# Armour around keys, tokens of three parts, and runs that may be coded.
_ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9]+ )?PRIVATE KEY-----((?:\s*[A-Za-z-]+: [^\n]*\n)*)([A-Za-z0-9+/=\s]+)-----END (?:[A-Z0-9]+ )?PRIVATE KEY-----")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
_RUN64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}")
_RUN16 = re.compile(r"(?<![0-9a-fA-F])[0-9a-fA-F]{32,}")
#: Bytes of a signature by algorithm: exactly so many, or at least (a negative number) and in whole units of 64, as RSA keys are.
SIGNATURES = {
    "HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64,
    "RS256": -128, "RS384": -128, "RS512": -128, "PS256": -128, "PS384": -128, "PS512": -128,
}
OPENSSH = b"openssh-key-v1\0"
#: How deep values may be nested in a key.
DEPTH = 12


@dataclass(frozen=True)
class Value:
    """One DER value: its tag, its contents, and the values inside if it is built of values."""

    tag: int
    content: bytes
    inside: tuple["Value", ...] = ()


def der_values(data: bytes, depth: int = DEPTH) -> list[Value] | None:
    """The values that fill ``data`` to its last byte, or null if lengths do not add up."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or depth == 0:
            return None
        tag, length = data[at], data[at + 1]
        at += 2
        if tag & 0x1F == 0x1F or tag == 0:  # tags of more than one byte stand in no key
            return None
        if length & 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > len(data) or data[at] == 0:
                return None
            length = int.from_bytes(data[at : at + n], "big")
            at += n
            if length < 0x80:  # lengths are written in the fewest bytes
                return None
        if at + length > len(data):
            return None
        content, inside = data[at : at + length], ()
        if tag & 0x20:
            found = der_values(content, depth - 1)
            if found is None:
                return None
            inside = tuple(found)
        out.append(Value(tag, content, inside))
        at += length
    return out


def _tags(values: tuple[Value, ...] | list[Value]) -> list[int]:
    return [v.tag for v in values]


def der_key(data: bytes) -> str | None:
    """The encoding of a private key in DER, or null."""
    values = der_values(data)
    if not values or len(values) != 1 or values[0].tag != 0x30:
        return None
    own = values[0].inside
    tags = _tags(own)
    number = own[0].content if own and own[0].tag == 0x02 else None
    if tags == [0x02] * 9 and number == b"\0" and len(own[1].content) >= 64:
        return "rsa"
    if tags == [0x02] * 6 and number == b"\0" and len(own[1].content) >= 64:
        return "dsa"
    if tags[:2] == [0x02, 0x04] and number == b"\1" and len(own[1].content) >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:]):
        return "ec"
    if tags[:3] == [0x02, 0x30, 0x04] and number in (b"\0", b"\1") and _tags(own[1].inside)[:1] == [0x06] and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:]):
        inner = der_values(own[2].content)
        return "pkcs8" if inner and len(inner) == 1 and inner[0].tag in (0x30, 0x04) else None
    if tags == [0x30, 0x04] and _tags(own[0].inside)[:1] == [0x06] and len(own[0].inside) == 2 and len(own[1].content) >= 32:
        return "pkcs8-encrypted"
    return None


def _field(data: bytes, at: int) -> tuple[bytes, int] | None:
    """A field with its length ahead of it in four bytes, and where the next begins."""
    if at + 4 > len(data):
        return None
    stop = at + 4 + int.from_bytes(data[at : at + 4], "big")
    return (data[at + 4 : stop], stop) if stop <= len(data) else None


def openssh_key(data: bytes) -> str | None:
    """The encoding of a private key in OpenSSH's format, or null."""
    if not data.startswith(OPENSSH):
        return None
    at, fields = len(OPENSSH), []
    for _ in range(3):  # cipher, key derivation and its options
        found = _field(data, at)
        if found is None:
            return None
        fields.append(found[0])
        at = found[1]
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 16 or not re.fullmatch(rb"[a-z0-9@.-]+", fields[0]):
        return None
    for n in range(keys + 1):  # public keys, then all private ones in one field
        found = _field(data, at)
        if found is None or (n < keys and _field(found[0], 0) is None):
            return None
        at = found[1]
    return "openssh" if at == len(data) and len(found[0]) >= 16 else None


def key_encoding(data: bytes) -> str | None:
    return openssh_key(data) if data[:1] == b"o" else der_key(data)


def decode64(text: str) -> bytes | None:
    """Base64 in either alphabet, with or without padding, or null."""
    bare = text.rstrip("=").translate(str.maketrans("-_", "+/"))
    if len(bare) % 4 == 1:
        return None
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def token_algorithm(header: str, payload: str, signature: str) -> str | None:
    """The algorithm of a signed token, or null if its parts do not fit together."""
    parts = []
    for part in (header, payload):
        data = decode64(part)
        try:
            own = json.loads(data.decode()) if data else None
        except (ValueError, RecursionError):
            own = None
        if not isinstance(own, dict):
            return None
        parts.append(own)
    name = parts[0].get("alg")
    size = SIGNATURES.get(name) if isinstance(name, str) else None
    signed = decode64(signature) if signature else None
    if size is None or signed is None:
        return None
    return name if len(signed) == size or (size < 0 and len(signed) >= -size and len(signed) % 64 == 0) else None


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, form) of the base secrets of a text."""
    out = [(m.start(), m.end(), ASSIGN, m.group(1).lower()) for m in _ASSIGN.finditer(text) if m.end() - m.start(2) >= ASSIGN_VALUE]
    out += [(m.start(), m.end(), ACCESS, "id") for m in _ACCESS.finditer(text)]
    return out + [(m.start(), m.end(), HEX, "lower") for m in _HEX.finditer(text)]


def _said(data: bytes) -> str | None:
    """What base secret decoded text holds, or null if it is not text or holds none."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    if not text.isprintable() and not text.replace("\n", "").replace("\r", "").replace("\t", "").isprintable():
        return None
    found = [kind for _, _, kind, _ in base_spans(text) if kind != HEX]
    return found[0] if found else None


def confirmed_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, form) of coded secrets whose structure holds; no two of them overlap."""
    out: list[tuple[int, int, str, str]] = []
    for m in _ARMOUR.finditer(text) if "-----BEGIN" in text else ():
        data = decode64("".join(m.group(3).split()))
        # A key encrypted as a whole has no structure but its header lines and its blocks.
        form = ("encrypted" if data and len(data) % 8 == 0 else None) if "DEK-Info:" in m.group(2) else data and key_encoding(data)
        if form:
            out.append((m.start(), m.end(), KEY, form))
    for m in _TOKEN.finditer(text) if "eyJ" in text else ():
        if form := token_algorithm(*m.groups()):
            out.append((m.start(), m.end(), TOKEN, form))
    taken = sorted(out)
    more: list[tuple[int, int, str, str]] = []
    for pattern, decode in ((_RUN16, _decode16), (_RUN64, decode64)):
        for m in pattern.finditer(text):
            data = decode(m.group())
            if not data:
                continue
            if form := key_encoding(data) if data[:1] in b"0o" else None:
                more.append((m.start(), m.end(), KEY, form))
            elif form := _said(data):
                more.append((m.start(), m.end(), CODED, form))
    # Digits in hexadecimal are digits in base64 too: what was reported once is not reported again.
    for span in sorted(more):
        at = bisect_left(taken, span)
        if (at == 0 or taken[at - 1][1] <= span[0]) and (at == len(taken) or span[1] <= taken[at][0]):
            taken.insert(at, span)
            out.append(span)
    return out


def _decode16(text: str) -> bytes | None:
    return bytes.fromhex(text) if len(text) % 2 == 0 else None


def spans(text: str) -> list[tuple[int, int, str, str]]:
    """All spans of a text by start, then by kind as listed, then by end."""
    return sorted(base_spans(text) + confirmed_spans(text), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _found(text: Column) -> Column:
    @F.pandas_udf("array<struct<kind string, start int, end int, form string>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"kind": kind, "start": a, "end": b, "form": form} for a, b, kind, form in spans(own)] for own in texts], dtype=object)

    # Said not to be deterministic so that no plan scans a text twice.
    return found.asNondeterministic()(text)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and ``found``, array of (kind, start, end, form), of every row of (doc_id, text).

    Offsets are code points of the whole text, ends exclusive. A null or empty text has no spans;
    repeated rows and null ids are scanned like any other; columns besides the two are not read; an
    empty table gives an empty result. Of coded candidates that overlap the first counts, armoured keys
    and tokens before bare runs.
    """
    require(docs, ["doc_id", "text"])
    return docs.select("doc_id", _found(text_or_empty()).alias("found"))


def listed(found: Column) -> Column:
    """Spans as text: kind, start and end, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(scanned: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""
    found = F.col("found")
    count = lambda kind: F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(found, lambda s: s["kind"].isin(*BASE))
    return scanned.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in BASE], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(found).alias("spans"),
    )
