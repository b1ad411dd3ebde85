"""BPE encoding and decoding over a table of distinct words.

A word is a run without ASCII white space; the tokenizer treats such runs independently (its
normaliser composes nothing across white space, its splitter drops white space and none of
its special tokens holds any), so the ids of a text are those of its words in order. Each
block asks for its distinct words, each distinct word is encoded once where all blocks'
questions about it meet, and the ids return to the positions of the word. Decoding joins
every id with its piece; the piece table is the vocabulary, whose size is fixed.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import blocks as B
from corpusloom.llm.common import require, text_or_empty

DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
TOKENS = "doc_id long, ids array<int>, decoded string"


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@cache
def _pieces(path: str) -> list[str]:
    """The table of pieces by id, read once in a process."""
    tokenizer = _tokenizer(path)
    return [tokenizer.id_to_token(n) or "" for n in range(max(tokenizer.get_vocab(with_added_tokens=True).values(), default=-1) + 1)]


def words_by_bucket(texts: Iterable[bytes], n: int) -> dict[int, list[bytes]]:
    """The distinct words of some texts, in sorted order, by the bucket that answers for them."""
    seen: set[bytes] = set()
    for text in texts:
        seen.update(text.split())
    out: dict[int, list[bytes]] = {}
    for word in sorted(seen):
        out.setdefault(zlib.crc32(word) % n, []).append(word)
    return out


def _texts(table: pa.Table) -> Iterator[bytes]:
    for text in table.column("text"):
        yield text.as_buffer().to_pybytes()


def _questions(table: pa.Table, n: int) -> Iterator[tuple[int, bytes, bytes]]:
    for bucket, words in words_by_bucket(_texts(table), n).items():
        yield bucket, b"\n".join(words), n.to_bytes(4, "big")


def _encoder(path: str):
    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, known = None, {}
        for batch in batches:
            tokenizer = tokenizer or _tokenizer(path)
            answers = []
            for asked, given in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = B.unsqueeze(asked).split(b"\n")
                new = [w for w in words if w not in known]
                for start in range(0, len(new), 4096):
                    part = new[start : start + 4096]
                    for word, coded in zip(part, tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                        known[word] = " ".join(map(str, coded.ids))
                answers.append(B.squeeze((B.unsqueeze(given).hex() + "\n" + "\n".join([known[w] for w in words])).encode()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(answers, pa.binary())], schema=B.ANSWER_SCHEMA)

    return encode_words


def _coder(path: str, digest: bool):
    def code_block(table: pa.Table, answers: list[tuple[int, bytes]]) -> pa.Table:
        pieces = _pieces(path)
        ids: dict[bytes, str] = {}
        if answers:
            n = int(answers[0][1].split(b"\n", 1)[0], 16)
            asked = words_by_bucket(_texts(table), n)
            for bucket, answer in answers:
                ids.update(zip(asked[bucket], answer.decode().split("\n")[1:], strict=True))
        decoded = {word: " ".join([pieces[int(n)] for n in own.split()]) for word, own in ids.items()}
        rows: list[tuple] = []
        for doc_id, text in zip(table.column("doc_id").to_pylist(), _texts(table)):
            words = text.split()
            own = " ".join([x for w in words if (x := ids[w])])
            back = " ".join([x for w in words if (x := decoded[w])])
            if digest:
                rows.append((doc_id, own.count(" ") + 1 if own else 0, hashlib.sha256(own.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
            else:
                rows.append((doc_id, list(map(int, own.split())), back))
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digest else [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return code_block


def _coded(docs: DataFrame, path: str, digest: bool) -> DataFrame:
    require(docs, ["doc_id", "text"])
    blocks = B.pack(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text")))
    answers = B.ask(blocks, _questions).mapInArrow(_encoder(path), B.ANSWERS)
    return B.resolve(blocks, answers, _coder(path, digest), DIGESTS if digest else TOKENS)


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids and the decoded text of every row.

    ``tokenizer_path`` names a tokenizer file that every executor can open. A null text counts
    as empty and an empty text has no ids; repeated rows and null ids are coded like any
    other; texts are coded whole, however long; an empty table gives an empty result. Other columns are not read.
    """
    return _coded(docs, tokenizer_path, digest=False)


def encode_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; cases as in ``encode``."""
    return _coded(docs, tokenizer_path, digest=True)
