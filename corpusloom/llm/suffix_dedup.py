"""Removal of repeated passages by suffix sorting.

A byte goes if a 50-byte string that covers it also starts in a document of smaller id. The
strings are found by deep-shallow suffix sorting: multikey quicksort on eight-byte symbols to
a shallow depth, then blind tries for the groups whose common prefix is longer.

No task sorts the suffixes of the corpus, only those that can have an equal elsewhere. Each
50-byte string is dealt by its *anchor*, the smallest by hash of its 24-byte substrings, so
equal strings meet; and blocks of documents first ask which of their anchors occur in another
document at all. For the others nothing is sent. Neighbouring strings with one anchor travel
as one *context*; where an anchor has very many contexts, each of its strings travels alone and
is dealt by all of its bytes, so that a hot anchor is shared out among all tasks and a block
sends a string once. Sorting goes in two steps: contexts that equal a context of a smaller
document, as in the inside of a long repeat, are settled first (their strings all start in
that document, so whatever else equals them equals the smaller document's too); then every
50-byte suffix of what is left, where the anchor has more than one document left, is sorted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import blocks as B
from corpusloom.llm.common import partitions, require, text_or_empty

#: Length of a repeated string, of its anchor, and the depth of the quicksort (a multiple of 8).
LENGTH = 50
ANCHOR = 24
SHALLOW = 24
WINDOW = LENGTH - ANCHOR + 1
#: Contexts after which the strings of an anchor are dealt one by one: as many contexts as a task
#: sorts in some 100 MB. A block reports up to ``MOST`` of its contexts of an anchor.
HOT_CONTEXTS = 1 << 16
MOST = (1 << 15) - 1
#: Strings of hot anchors that a block compares with one another at once.
HOT_STRINGS = 1 << 18
#: Strings of a bucket that are sorted at once.
STRINGS_AT_ONCE = 1 << 19
#: Strings whose anchors are computed at once.
CHUNK = 1 << 22
#: Bits of an anchor's hash; the rest of the word holds its position.
HASH_BITS = 40
LAST_ID = (1 << 63) - 1

SPANS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_SPAN_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
KEPT = "doc_id long, text binary"


def _words_at(buffer: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one big-endian number; ``buffer`` ends in eight spare bytes."""
    return np.ndarray((len(buffer) - 7,), ">u8", buffer.data, 0, (1,))


def _hash(words: np.ndarray, at: slice | np.ndarray, size: int, length: int = ANCHOR) -> np.ndarray:
    """A hash of the ``length`` bytes at some positions, a multiple of 8."""
    total = np.zeros(size, dtype=np.uint64)
    for n in range(0, length, 8):
        own = words[at.start + n : at.stop + n] if isinstance(at, slice) else words[at + n]
        total += own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * 0x632BE59BD9B4E019 * n & 0xFFFFFFFFFFFFFFFF | 1)
    total = (total ^ (total >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(31))


def anchors(buffer: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, document, first string, number of strings, place) of the anchors in documents end to end.

    ``bounds`` are the documents' starts and the end of the last; ``buffer`` has eight spare bytes.
    """
    words, low_bits = _words_at(buffer), np.uint64(64 - HASH_BITS)
    found: list[tuple[np.ndarray, ...]] = []
    n_strings = bounds[-1] - LENGTH + 1
    for begin in range(0, max(0, n_strings), CHUNK):
        end = min(begin + CHUNK, n_strings)
        size = end - begin + WINDOW - 1
        hashed = _hash(words, slice(begin, begin + size), size)
        least = (hashed >> low_bits << low_bits) | np.arange(size, dtype=np.uint64)
        span = 1
        while span * 2 <= WINDOW:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < WINDOW:
            least = np.minimum(least[: end - begin], least[WINDOW - span :])
        strings = np.arange(begin, end)
        doc = np.searchsorted(bounds, strings, "right") - 1
        inside = strings + LENGTH <= bounds[doc + 1]
        least, strings, doc = least[inside], strings[inside], doc[inside]
        if not len(least):
            continue
        new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | (strings[1:] != strings[:-1] + 1)]))
        place = begin + (least[new] & np.uint64((1 << (64 - HASH_BITS)) - 1)).astype(np.int64)
        found.append((least[new] >> low_bits, doc[new], strings[new], np.diff(np.append(new, len(least))), place))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def blind_trie(keys: list[int]) -> list[list[int]]:
    """Positions of ``keys`` in their order, equal ones together.

    The trie is blind: a node stores the bit in which its two sides differ and nothing of what
    its path skips, so a key goes down by a few bits and is compared in full once, with the
    leaf it reaches; the first difference says where it belongs.
    """
    root: list = [keys[0], [0]]
    for n in range(1, len(keys)):
        key, node = keys[n], root
        while len(node) == 3:
            node = node[1 + (key >> node[0] & 1)]
        difference = node[0] ^ key
        if not difference:
            node[1].append(n)
            continue
        bit = difference.bit_length() - 1
        parent, side, node = None, 0, root
        while len(node) == 3 and node[0] > bit:
            parent, side = node, 1 + (key >> node[0] & 1)
            node = node[side]
        leaf = [key, [n]]
        new = [bit, node, leaf] if key >> bit & 1 else [bit, leaf, node]
        if parent is None:
            root = new
        else:
            parent[side] = new
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if len(node) == 3:
            stack += (node[2], node[1])
        else:
            out.append(node[1])
    return out


def deep_shallow(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): suffixes sorted by their first ``lengths`` bytes; equal ones share a rank.

    Suffixes have at least ``SHALLOW`` bytes and ``buffer`` has eight spare ones.
    """
    n = len(starts)
    words = _words_at(buffer)
    order, group = np.arange(n), np.zeros(n, dtype=np.int64)
    open_ = np.arange(n)  # places in the order that lie in a group of several
    for depth in range(0, SHALLOW, 8):
        if not len(open_):
            break
        members = order[open_]
        symbol = words[starts[members] + depth].astype(np.uint64)
        by = np.argsort(symbol, kind="stable") if depth == 0 else np.lexsort((symbol, group[open_]))
        members, symbol, own = members[by], symbol[by], group[open_][by]
        order[open_] = members
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (symbol[1:] != symbol[:-1])])
        first = open_[np.flatnonzero(new)]  # a group is named by its first place
        own = first[np.cumsum(new) - 1]
        group[open_] = own
        sizes = np.diff(np.append(np.flatnonzero(new), len(own)))
        open_ = open_[np.repeat(sizes > 1, sizes)]
    if len(open_):
        raw = buffer.base if isinstance(buffer.base, bytes) and len(buffer.base) == len(buffer) else buffer.tobytes()
        longest = int(lengths.max()) - SHALLOW
        own = group[open_]
        edges = np.append(np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])), len(own)).tolist()
        members = order[open_]
        begins, ends = (starts[members] + SHALLOW).tolist(), (starts[members] + lengths[members]).tolist()
        keys = [int.from_bytes(raw[a:b].ljust(longest, b"\0") + bytes(((b - a) & 255,)), "big") for a, b in zip(begins, ends)]
        ordered, ranks = np.empty(len(own), dtype=np.int64), np.empty(len(own), dtype=np.int64)
        places, at, rank = open_.tolist(), 0, 0
        flat: list[int] = []
        named: list[int] = []
        for low, high in zip(edges, edges[1:]):
            part = keys[low:high]
            if high - low == 2 and part[0] == part[1]:
                flat += (low, low + 1)
                named += (places[low], places[low])
                continue
            at = low
            for leaf in blind_trie(part):
                flat += [low + k for k in leaf]
                named += [places[at]] * len(leaf)
                at += len(leaf)
        ordered[:], ranks[:] = members[flat], named
        order[open_], group[open_] = ordered, ranks
    rank = np.empty(n, dtype=np.int64)
    rank[order] = group
    return order, rank


def _smaller(rank: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether an equal suffix starts in a document of smaller id."""
    by = np.lexsort((docs, rank))
    new = np.concatenate([[True], rank[by][1:] != rank[by][:-1]]) if len(by) else np.zeros(0, dtype=bool)
    least = np.empty(len(by), dtype=docs.dtype)
    least[by] = docs[by][np.flatnonzero(new)][np.cumsum(new) - 1]
    return docs > least


def settled(buffer: np.ndarray, starts: np.ndarray, counts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which contexts equal one of a document of smaller id."""
    if not len(starts):
        return np.zeros(0, dtype=bool)
    return _smaller(deep_shallow(buffer, starts, counts + LENGTH - 1)[1], docs)


def repeated_strings(buffer: np.ndarray, starts: np.ndarray, counts: np.ndarray, docs: np.ndarray, shifts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset) of each string of the contexts that also starts in a smaller document."""
    none = np.zeros(0, dtype=np.int64)
    if not len(starts):
        return none, none
    anchor = _hash(_words_at(buffer), starts + shifts, len(starts))
    by = np.argsort(anchor, kind="stable")
    new = np.concatenate([[True], anchor[by][1:] != anchor[by][:-1]])
    edges = np.flatnonzero(new)
    several = np.maximum.reduceat(docs[by], edges) != np.minimum.reduceat(docs[by], edges)
    chosen = np.sort(by[several[np.cumsum(new) - 1]])
    reach = counts[chosen]
    owner = np.repeat(chosen, reach)
    offset = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
    if not len(owner):
        return none, none
    at = starts[owner] + offset
    gone = _smaller(deep_shallow(buffer, at, np.full(len(at), LENGTH))[1], docs[owner])
    return owner[gone], offset[gone]


def _laid_out(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the texts end to end and eight spare ones, bounds of the texts, ids)."""
    texts = [t.as_buffer().to_pybytes() for t in table.column("text")]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    ids = np.array([LAST_ID if x is None else x for x in table.column("doc_id").to_pylist()], dtype=np.int64)
    return np.frombuffer(b"".join(texts) + bytes(8 + ANCHOR), dtype=np.uint8), bounds, ids


def _asked(table: pa.Table, n: int) -> tuple[tuple, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of a block; its distinct hashes by bucket, with the contexts of each (up to ``MOST``), twice that and one if several documents have it."""
    buffer, bounds, ids = _laid_out(table)
    made = anchors(buffer, bounds)
    hashed, owner = made[0], ids[made[1]]
    by = np.argsort(hashed, kind="stable")
    new = np.concatenate([[True], hashed[by][1:] != hashed[by][:-1]]) if len(by) else np.zeros(0, dtype=bool)
    edges = np.flatnonzero(new)
    distinct = hashed[by][edges]
    several = np.maximum.reduceat(owner[by], edges) != np.minimum.reduceat(owner[by], edges) if len(edges) else new
    seen = (np.minimum(np.diff(np.append(edges, len(by))), MOST) * 2 + several).astype(np.uint16)
    bucket = (distinct % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return (buffer, bounds, ids, made), distinct[order], bucket[order], seen[order]


def _questions(table: pa.Table, n: int) -> Iterator[tuple[int, bytes, bytes]]:
    _, distinct, bucket, seen = _asked(table, n)
    edges = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket)) if len(bucket) else []
    for low, high in zip(edges, edges[1:]):
        own = distinct[low:high]
        steps = np.diff(own, prepend=np.uint64(0))
        small = steps.max() < 1 << 32
        data = steps.astype(np.uint32 if small else np.uint64).tobytes()
        yield int(bucket[low]), bytes([int(small)]) + data, n.to_bytes(4, "big") + seen[low:high].tobytes()


def _elsewhere(batches: Iterator[pa.RecordBatch], hot_contexts: int) -> Iterator[pa.RecordBatch]:
    """For each anchor asked about 1 if more than one document has it, 2 if it has very many contexts besides, else 0."""
    rows = []
    for batch in batches:
        rows += zip(*[c.to_pylist() for c in batch.columns])
    if not rows:
        return
    hashes, seen = [], []
    for _, _, asked, given in rows:
        asked, given = B.unsqueeze(asked), B.unsqueeze(given)
        own = np.cumsum(np.frombuffer(asked[1:], np.uint32 if asked[0] else np.uint64).astype(np.uint64))
        hashes.append(own)
        seen.append(np.frombuffer(given[4:], np.uint16))
    flat, given = np.concatenate(hashes), np.concatenate(seen)
    by = np.argsort(flat, kind="stable")
    new = np.concatenate([[True], flat[by][1:] != flat[by][:-1]])
    edges, given = np.flatnonzero(new), given[by].astype(np.int64)
    many = np.add.reduceat((given & 1) + 1, edges) > 1
    hot = many & (np.add.reduceat(given >> 1, edges) > hot_contexts)
    said = np.empty(len(flat), dtype=np.uint8)
    said[by] = (many.astype(np.uint8) + hot)[np.cumsum(new) - 1]
    at = 0
    for (block, bucket, _, given), own in zip(rows, hashes):
        answer = B.unsqueeze(given)[:4] + said[at : at + len(own)].tobytes()
        at += len(own)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([B.squeeze(answer)], pa.binary())], schema=B.ANSWER_SCHEMA)


_CONTEXT = np.dtype([("doc", "<i8"), ("at", "<u4"), ("count", "u1"), ("shift", "u1")])
_RUN = np.dtype([("at", "<u8"), ("count", "<u4")])


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in ``ordered``."""
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _whole(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the whole strings at some positions."""
    # The last eight bytes overlap those before, so that whole words cover the string.
    own = _hash(words, at, len(at), LENGTH // 8 * 8) + words[at + LENGTH - 8].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return own ^ (own >> np.uint64(32))


def _alone(buffer: np.ndarray, starts: np.ndarray, counts: np.ndarray, docs: np.ndarray, shifts: np.ndarray) -> tuple[tuple, np.ndarray]:
    """((hash, document, start, 1, shift) of the strings of some contexts, runs of those that a smaller document of the block has)."""
    words, owner = _words_at(buffer), np.repeat(np.arange(len(starts), dtype=np.int32), counts)
    offset = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.uint8)
    whole = np.empty(len(owner), dtype=np.uint64)
    for low in range(0, len(owner), HOT_STRINGS):
        whole[low : low + HOT_STRINGS] = _whole(words, starts[owner[low : low + HOT_STRINGS]] + offset[low : low + HOT_STRINGS])
    parts = len(owner) // HOT_STRINGS + 1
    gone = np.zeros(len(owner), dtype=bool)
    for part in range(parts):
        own = np.flatnonzero(whole % np.uint64(parts) == part)
        at = starts[owner[own]] + offset[own]
        gone[own] = settled(buffer, at, np.ones(len(own), dtype=np.int64), docs[owner[own]])
    at, left = starts[owner] + offset, ~gone
    owner = owner[left]
    single = (whole[left], docs[owner], at[left], np.ones(len(owner), dtype=np.int64), shifts[owner] - offset[left])
    return single, np.rec.fromarrays([at[gone], np.ones(int(gone.sum()), dtype=np.int64)], dtype=_RUN)


def _contexts(block: int, table: pa.Table, answers: list[tuple[int, bytes]]) -> pa.Table:
    """The contexts of a block whose anchor another document has, by bucket; what the block settles itself under -1."""
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("asked", pa.binary()), ("given", pa.binary())])
    if not answers:
        return schema.empty_table()
    n = int.from_bytes(answers[0][1][:4], "big")
    (buffer, bounds, ids, made), distinct, bucket, _ = _asked(table, n)
    said = np.zeros(len(distinct), dtype=np.uint8)
    for own, answer in answers:
        low, high = np.searchsorted(bucket, [own, own + 1])
        said[low:high] = np.frombuffer(answer[4:], np.uint8)
    hashed, doc, start, count, place = made
    if not said.any():
        return schema.empty_table()
    wanted, hottest = np.sort(distinct[said > 0]), np.sort(distinct[said > 1])
    keep = _among(hashed, wanted)
    hashed, doc, start, count, place = hashed[keep], ids[doc[keep]], start[keep], count[keep], place[keep]
    done = settled(buffer, start, count, doc)
    here = [np.rec.fromarrays([start[done], count[done]], dtype=_RUN)]
    hashed, doc, start, count, shift = hashed[~done], doc[~done], start[~done], count[~done], (place - start)[~done]
    hot = _among(hashed, hottest)
    if hot.any():
        single, runs = _alone(buffer, start[hot], count[hot], doc[hot], shift[hot])
        here.append(runs)
        hashed, doc, start, count, shift = (np.concatenate([x[~hot], y]) for x, y in zip((hashed, doc, start, count, shift), single))
    rows = [(block, -1, B.squeeze(np.concatenate(here).tobytes()), b"")]
    to = (hashed % np.uint64(n)).astype(np.int64)
    by = np.argsort(to, kind="stable")
    edges = np.append(np.flatnonzero(np.concatenate([[True], to[by][1:] != to[by][:-1]])), len(by)) if len(by) else []
    raw = buffer.tobytes()
    for low, high in zip(edges, edges[1:]):
        own = by[low:high]
        facts = np.rec.fromarrays([doc[own], start[own], count[own], shift[own]], dtype=_CONTEXT)
        data = b"".join([raw[a:b] for a, b in zip(start[own].tolist(), (start[own] + count[own] + LENGTH - 1).tolist())])
        rows.append((block, int(to[own[0]]), B.squeeze(data), B.squeeze(facts.tobytes())))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _parts(buffer: np.ndarray, starts: np.ndarray, counts: np.ndarray, shifts: np.ndarray, at_once: int) -> Iterator[np.ndarray]:
    """The contexts in parts of about ``at_once`` strings; strings that may be equal are in one part.

    Contexts are dealt by their anchors, strings that travel alone by all of their bytes where all of their anchor do.
    """
    n = int(counts.sum()) // at_once + 1
    if n == 1:
        yield np.arange(len(starts))
        return
    words, key = _words_at(buffer), np.empty(len(starts), dtype=np.uint64)
    for low in range(0, len(starts), at_once):
        key[low : low + at_once] = _hash(words, starts[low : low + at_once] + shifts[low : low + at_once], len(starts[low : low + at_once]))
    longer = np.unique(key[counts > 1])
    alone = ~_among(key, longer)
    for low in range(0, len(starts), at_once):
        own = low + np.flatnonzero(alone[low : low + at_once])
        key[own] = _whole(words, starts[own])
    key = (key % np.uint64(n)).astype(np.int32)
    by = np.argsort(key, kind="stable")
    yield from np.split(by, np.searchsorted(key[by], np.arange(1, n)))


def _joined(context: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first offset, number) of the runs of neighbouring strings."""
    new = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (offset[1:] != offset[:-1] + 1)])) if len(context) else np.zeros(0, dtype=np.int64)
    return context[new], offset[new], np.diff(np.append(new, len(context)))


def _repeats(buffer: np.ndarray, starts: np.ndarray, counts: np.ndarray, docs: np.ndarray, shifts: np.ndarray, at_once: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first offset, number) of the runs of strings that also start in a smaller document."""
    found = []
    for part in _parts(buffer, starts, counts, shifts, at_once):
        done = settled(buffer, starts[part], counts[part], docs[part])
        left = part[~done]
        context, offset, number = _joined(*repeated_strings(buffer, starts[left], counts[left], docs[left], shifts[left]))
        found.append((np.concatenate([part[done], left[context]]), np.concatenate([np.zeros(int(done.sum()), dtype=np.int64), offset]), np.concatenate([counts[part[done]], number])))
    return tuple(np.concatenate(x) for x in zip(*found))


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of repeated strings of each block, by deep-shallow sorting of the contexts of a bucket, part by part."""
    asked = []
    for batch in batches:
        for block, bucket, data, facts in zip(*[c.to_pylist() for c in batch.columns]):
            if bucket < 0:
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([-1], pa.int32()), pa.array([data], pa.binary())], schema=B.ANSWER_SCHEMA)
            else:
                asked.append((bucket, block, data, facts))
    # Equal strings are in equal buckets: one bucket after another bounds the memory.
    asked.sort(key=lambda x: x[:2])
    low = 0
    while low < len(asked):
        high = low
        while high < len(asked) and asked[high][0] == asked[low][0]:
            high += 1
        part = asked[low:high]
        facts = [np.frombuffer(B.unsqueeze(x[3]), _CONTEXT) for x in part]
        buffer = np.frombuffer(b"".join([*(B.unsqueeze(x[2]) for x in part), bytes(8 + ANCHOR)]), dtype=np.uint8)
        both = np.concatenate(facts)
        row = np.repeat(np.arange(len(part)), [len(f) for f in facts])
        counts = both["count"].astype(np.int64)
        starts = np.cumsum(counts + LENGTH - 1) - (counts + LENGTH - 1)
        context, offset, count = _repeats(buffer, starts, counts, both["doc"].astype(np.int64), both["shift"].astype(np.int64), STRINGS_AT_ONCE)
        rows, at = row[context], both["at"][context] + offset
        by = np.argsort(rows, kind="stable")
        bounds = np.searchsorted(rows[by], np.arange(len(part) + 1))
        for k, (bucket, block, _, _) in enumerate(part):
            own = by[bounds[k] : bounds[k + 1]]
            runs = np.rec.fromarrays([at[own], count[own]], dtype=_RUN).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([B.squeeze(runs)], pa.binary())], schema=B.ANSWER_SCHEMA)
        asked[low:high] = [None] * (high - low)
        low = high


def _removed(table: pa.Table, answers: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, bounds, whether each byte goes) of a block."""
    buffer, bounds, _ = _laid_out(table)
    change = np.zeros(bounds[-1] + 1, dtype=np.int32)
    for _, answer in answers:
        runs = np.frombuffer(answer, _RUN)
        np.add.at(change, runs["at"].astype(np.int64), 1)
        np.add.at(change, (runs["at"] + runs["count"] + LENGTH - 1).astype(np.int64), -1)
    return buffer[: bounds[-1]], bounds, np.cumsum(change[:-1]) > 0


def _spans(table: pa.Table, answers: list[tuple[int, bytes]]) -> pa.Table:
    buffer, bounds, gone = _removed(table, answers)
    rows = []
    for doc_id, low, high in zip(table.column("doc_id").to_pylist(), bounds.tolist(), bounds[1:].tolist()):
        own = gone[low:high]
        n = int(own.sum())
        spans = int(own[:1].sum()) + int((own[1:] & ~own[:-1]).sum()) if n else 0
        rows.append((doc_id, high - low, n, spans, hashlib.sha256((buffer[low:high][~own] if n else buffer[low:high]).tobytes()).hexdigest()))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SPAN_SCHEMA)], schema=_SPAN_SCHEMA)


def _kept(table: pa.Table, answers: list[tuple[int, bytes]]) -> pa.Table:
    buffer, bounds, gone = _removed(table, answers)
    texts = [buffer[low:high][~gone[low:high]].tobytes() for low, high in zip(bounds.tolist(), bounds[1:].tolist())]
    return pa.table({"doc_id": table.column("doc_id"), "text": pa.array(texts, pa.binary())})


def _resolved(docs: DataFrame, of_block, schema: str, block_bytes: int, hot_contexts: int) -> DataFrame:
    require(docs, ["doc_id", "text"])
    blocks = B.pack(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text")), block_bytes=block_bytes)
    elsewhere = B.ask(blocks, _questions).mapInArrow(lambda batches: _elsewhere(batches, hot_contexts), B.ANSWERS)
    contexts = B.resolve(blocks, elsewhere, _contexts, B.QUESTIONS, numbered=True)
    own = F.when(F.col("bucket") < 0, F.concat(F.lit("b"), F.col("block").cast("string"))).otherwise(F.col("bucket").cast("string"))
    runs = contexts.withColumn("to", own).repartition(partitions(docs.sparkSession), "to").drop("to").mapInArrow(_sorted, B.ANSWERS)
    return B.resolve(blocks, runs, of_block, schema)


def repeated_spans(docs: DataFrame, block_bytes: int = B.BLOCK_BYTES, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    Texts are bytes in UTF-8 and matches never cross documents. A null text counts as empty;
    texts of fewer than 50 bytes lose nothing; a null ``doc_id`` counts as larger than any
    other; rows of one ``doc_id`` do not remove anything from one another. Where a 24-byte anchor
    has more than ``hot_contexts`` contexts its strings are dealt one by one, with the same result. Texts may be very long. An empty table
    gives an empty result, and columns other than doc_id and text are not read.
    """
    return _resolved(docs, _spans, SPANS, block_bytes, hot_contexts)


def remove_repeats(docs: DataFrame, block_bytes: int = B.BLOCK_BYTES, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """doc_id and the bytes that stay of every row; cases as in ``repeated_spans``."""
    return _resolved(docs, _kept, KEPT, block_bytes, hot_contexts)
