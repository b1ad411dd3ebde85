"""Conversation structure repair over a bidirectional tight-arc DAG.

A conversation is right if its roles read ``(s?(ua)+)?``: nothing, or a system row at most and
then users and assistants in turn. Rows are kept, given another role, deleted, or empty rows are
inserted, each at a cost. The nodes of the DAG are (row, state of the pattern), its arcs the edits.
Minimum costs forward from the start and backward from the end mark every arc that some
cheapest repair uses (forward + arc + backward = total); from the start a set of
states then follows the tight arcs, at each step by the least letter that any of them has.

No conversation has to fit a task. Rows are dealt by ranges of (conversation, turn), so a long
conversation is cut into pieces. A piece is a 4 x 4 matrix of minimum costs between states; the
matrices of the conversations at the ends of the ranges, two a range at most, are combined on the
driver, which gives every piece its forward and backward costs at its borders. Letters are
found in the pieces again by a table of states, combined in the same way.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import blocks as B
from corpusloom.llm.common import WHITE, checkpoint, forget, require

#: Edits by letter, and what they cost; an undeleted truncated row adds one more.
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
#: States of the pattern by what was last read: nothing, s, u, a.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The state after the row that a state needs next, and that row's role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
ACCEPTED = (START, ASSISTANT)
FAR = 1 << 60
#: Initials of rows that may stand next to each other.
LEGAL = {"su", "ua", "au"}
#: Faults of a row; the first of these counts.
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
#: Bytes of repaired text, or letters, sent on at once.
CHUNK_BYTES = 1 << 20


def inserts(costs: list[int]) -> list[int]:
    """Costs of states after any insertions; three in a row come to every state that insertions reach."""
    own = list(costs)
    for _ in range(3):
        for q in STATES:
            own[NEXT[q]] = min(own[NEXT[q]], own[q] + COST[INSERT])
    return own


def inserts_back(costs: list[int]) -> list[int]:
    """Costs from states on, insertions first."""
    own = list(costs)
    for _ in range(3):
        for q in STATES:
            own[q] = min(own[q], COST[INSERT] + own[NEXT[q]])
    return own


@dataclass(frozen=True)
class Step:
    """What may be done with one row, or with ``times`` rows that must go: arcs by state as (letter, state, cost)."""

    initial: str
    gone: bool
    truncated: bool
    times: int = 1

    def arcs(self, q: int) -> list[tuple[str, int, int]]:
        out = [(DELETE, q, COST[DELETE] * self.times)]
        if self.gone:
            return out
        more = TRUNCATED_COST if self.truncated else 0
        to = SYSTEM if self.initial == "s" and q == START else USER if self.initial == "u" and q != USER else ASSISTANT if self.initial == "a" and q == USER else None
        if to is not None:
            out.append((KEEP, to, COST[KEEP] + more))
        return [*out, (REROLE, NEXT[q], COST[REROLE] + more)]


def forward(costs: list[int], steps: Iterable[Step]) -> Iterator[list[int]]:
    """Minimum costs at every row and after the last, insertions ahead of a row taken in."""
    own = inserts(costs)
    yield own
    for step in steps:
        after = [FAR] * 4
        for q in STATES:
            if own[q] < FAR:
                for _, to, cost in step.arcs(q):
                    after[to] = min(after[to], own[q] + cost)
        own = inserts(after)
        yield own


def backward(costs: list[int], steps: list[Step]) -> list[list[int]]:
    """Minimum costs from every row on, and from after the last."""
    out = [inserts_back(costs)]
    for step in reversed(steps):
        own = [min(cost + out[-1][to] for _, to, cost in step.arcs(q)) for q in STATES]
        out.append(inserts_back(own))
    return out[::-1]


def matrix(steps: list[Step]) -> list[list[int]]:
    """Minimum costs from each state ahead of some rows to each state after them, insertions at both ends taken in."""
    out = []
    for start in STATES:
        last = [0 if q == start else FAR for q in STATES]
        for last in forward(last, steps):
            pass
        out.append(last)
    return out


def applied(costs: list[int], by: list[list[int]]) -> list[int]:
    return [min(FAR, *(costs[p] + by[p][q] for p in STATES)) for q in STATES]


def applied_back(by: list[list[int]], costs: list[int]) -> list[int]:
    return [min(FAR, *(by[q][p] + costs[p] for p in STATES)) for q in STATES]


#: Costs at the start and after the end of a conversation.
BEGIN = [0, FAR, FAR, FAR]
END = inserts_back([0 if q in ACCEPTED else FAR for q in STATES])


def walk(steps: list[Step], at: set[int], before: list[int], after: list[int], last: bool) -> tuple[list[tuple[str, int]], set[int], int]:
    """The least letters along tight arcs from a set of states, as (letter, state after), the states reached, the total cost.

    ``before`` and ``after`` are the minimum costs ahead of the first step and from behind the
    last. Only the last piece of a conversation inserts behind its last row.
    """
    ahead, behind = list(forward(before, steps)), backward(after, steps)
    total = min(ahead[0][q] + behind[0][q] for q in STATES)
    letters: list[tuple[str, int]] = []
    n, front = 0, set(at)
    while n < len(steps) or last:
        arcs: dict[str, set[int]] = {}
        for q in front:
            if ahead[n][q] + COST[INSERT] + behind[n][NEXT[q]] == total and ahead[n][q] + behind[n][q] == total:
                arcs.setdefault(INSERT, set()).add(NEXT[q])
            if n < len(steps):
                for letter, to, cost in steps[n].arcs(q):
                    if ahead[n][q] + cost + behind[n + 1][to] == total:
                        arcs.setdefault(letter, set()).add(to)
        if n == len(steps) and any(q in ACCEPTED for q in front):
            break
        letter = min(arcs)
        front = arcs[letter]
        letters.append((letter, min(front)))
        n += letter != INSERT
    return letters, front, total


@dataclass
class Piece:
    """The rows of one conversation in one range of rows, in order."""

    conv: object
    steps: list[Step] = field(default_factory=list)
    rows: list[tuple[str, str]] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=lambda: {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0})
    illegal: int = 0
    first: str | None = None
    last: str | None = None
    turns: int = 0
    low: int | None = None
    high: int | None = None

    def add(self, turn: int | None, role: str, text: str, times: int, is_first: bool) -> None:
        """``times`` equal rows; ``is_first`` if no earlier row of the conversation has their role and text."""
        if times == 0:
            return
        initial = role[:1]
        if self.last is not None:
            self.illegal += self.last + initial not in LEGAL
        self.illegal += times - 1  # equal initials never go together
        self.first, self.last = (initial if self.first is None else self.first), initial
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = (turn if self.low is None else self.low), turn
        bare = text.rstrip(WHITE)
        again = times
        if not bare:
            self.counts[BLANK] += times
        else:
            if is_first:
                truncated = bare[-1] not in ".!?"
                self.counts[TRUNCATED] += truncated
                self._step(Step(initial, False, truncated), (role, text))
                again -= 1
            self.counts[DUPLICATE] += again
        if again:
            self._step(Step(initial, True, False, again), ("", ""))

    def _step(self, step: Step, row: tuple[str, str]) -> None:
        self.steps.append(step)
        self.rows.append(row)

    def repaired(self, letters: list[tuple[str, int]]) -> Iterator[tuple[str, str, str]]:
        """(letter, role, text) of the rows that stay or are put in, (letter, "", "") of deleted ones."""
        n = 0
        for letter, state in letters:
            if letter == INSERT:
                yield INSERT, ROLE_OF[state], ""
                continue
            role, text = self.rows[n]
            if letter == DELETE:
                for _ in range(self.steps[n].times):
                    yield DELETE, "", ""
            else:
                yield letter, (role if letter == KEEP else ROLE_OF[state]), text
            n += 1


class Pieces:
    """Pieces from rows (conv, turn, role, text, digest, times) in order; a first sighting comes ahead of its row.

    Rows that are equal in all but their number, as tasks met them apart, are one. Without
    ``keep`` the pieces hold no texts.
    """

    def __init__(self, keep: bool) -> None:
        self.keep = keep
        self.piece: Piece | None = None
        self.held: list | None = None
        self.sighted: tuple | None = None

    def _flush(self) -> None:
        if self.held is not None:
            self.piece.add(*self.held[1:4], *self.held[5:])
            if not self.keep:
                self.piece.rows.clear()
        self.held = None

    def feed(self, row: tuple) -> Piece | None:
        """Takes a row; gives the piece before it if that is complete."""
        conv, turn, role, text, digest, times = row
        done = None
        if self.piece is None or conv != self.piece.conv:
            done = self.close()
            self.piece = Piece(conv)
        key = (turn, role, digest)
        if times < 0:
            self.sighted = key
        elif self.held is not None and (self.held[1], self.held[2], self.held[4]) == key:
            self.held[5] += times
        else:
            self._flush()
            self.held = [conv, turn, role, text, digest, times, self.sighted == key]
        return done

    def close(self) -> Piece | None:
        """The last piece, if any row came."""
        self._flush()
        done, self.piece, self.sighted = self.piece, None, None
        return done


_ROWS = ("conv", "turn", "role", "text", "digest", "times")
_PACKED = "part int, number int, conv string, payload binary, costs string"
_PACKED_SCHEMA = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("conv", pa.string()), ("payload", pa.binary()), ("costs", pa.string())])


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a batch as one, so that rows that repeat without end stay few."""
    for batch in batches:
        own = pa.Table.from_batches([batch]).group_by(["conv", "turn", "role", "text", "digest"]).aggregate([("times", "sum")]).rename_columns(list(_ROWS))
        yield from own.to_batches()


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times): rows with faults put in, by the CRC-32 of conversation and turn.

    Of twenty rows one is dropped (``times`` 0), one emptied, one loses its sentence ends, one stands
    twice (``times`` 2), one becomes the user's. A null is one space, but turn and conv_id stay null.
    """
    require(conversations, ["conv_id", "turn", "role", "text"])
    blank = F.lit(" ")
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    kind = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", as_text("role").alias("role"), as_text("text").alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.cast("long").alias("times"))


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows and the first sightings of role and text, dealt by ranges of conversation and turn and sorted.

    Rows of one turn go by role, then by the SHA-256 of the text. Sightings have ``times`` -1 and no
    text, and stand ahead of the row they mean.
    """
    times = F.col("times").cast("long") if "times" in rows.columns else F.lit(1).cast("long")
    blank = F.lit(" ")
    role, text = (F.coalesce(F.col(c).cast("string"), blank) for c in ("role", "text"))
    own = rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.when(times == 0, "").otherwise(text).alias("text"), F.when(times == 0, "").otherwise(F.sha2(text.cast("binary"), 256)).alias("digest"), times.alias("times"))
    kind = own.schema["conv"].dataType.simpleString()
    own = own.mapInArrow(_collapsed, f"conv {kind}, turn long, role string, text string, digest string, times long")
    # The least turn with a null ahead of all; partial sums keep rows that repeat small.
    least = F.min(F.struct(F.col("turn").isNotNull().alias("said"), "turn"))["turn"]
    first = own.where("times > 0").groupBy("conv", "role", "digest").agg(least.alias("turn"))
    first = first.select("conv", "turn", "role", F.lit("").alias("text"), "digest", F.lit(-1).cast("long").alias("times"))
    order = ["conv", "turn", "role", "digest"]
    return own.unionByName(first).repartitionByRange(*order).sortWithinPartitions(*order, "times")


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in compressed blocks, then the conversations at both ends of the range with their costs."""
    part, number = TaskContext.get().partitionId(), 0

    def row(n: int, conv: str | None, payload: bytes, costs: str | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((part, n, conv, payload, costs), _PACKED_SCHEMA)], schema=_PACKED_SCHEMA)

    ends: list[Piece] = []
    pieces = Pieces(keep=False)
    for batch in batches:
        for own in _read([batch]):
            if (piece := pieces.feed(own)) is not None:
                ends = [*ends[:1], piece]
        yield row(number, None, B.seal([batch]), None)
        number += 1
    if (piece := pieces.close()) is not None:
        ends = [*ends[:1], piece]
    for n, piece in enumerate(ends):
        coded = json.dumps([[s.initial, s.gone, s.truncated, s.times] for s in piece.steps]).encode()
        yield row(-1 - n, json.dumps(piece.conv, default=str), B.squeeze(coded), json.dumps(matrix(piece.steps)))


@dataclass(frozen=True)
class Border:
    """What a piece knows of the rest of its conversation: costs ahead and behind, whether it ends it, the state it is entered in."""

    before: list[int]
    after: list[int]
    last: bool
    entered: tuple[int, ...] = (START,)


def _chains(ends: Iterable[tuple[int, int, str]]) -> list[list[tuple[int, int]]]:
    """The pieces (part, number) of conversations that go over several ranges, in order, from (part, number, conv)."""
    chains: list[list[tuple[int, int]]] = []
    held, chain = None, []
    for part, number, conv in sorted(ends, key=lambda e: (e[0], -e[1])):
        if conv != held:
            chains.append(chain := [])
            held = conv
        chain.append((part, number))
    return [c for c in chains if len(c) > 1]


def _borders(ends: list) -> dict[tuple[int, int], Border]:
    """Costs at the borders of every piece of a conversation in several ranges; at most two pieces a range."""
    by = {(r["part"], r["number"]): json.loads(r["costs"]) for r in ends}
    out: dict[tuple[int, int], Border] = {}
    for chain in _chains([(r["part"], r["number"], r["conv"]) for r in ends]):
        ahead, behind = [BEGIN], [END]
        for key in chain[:-1]:
            ahead.append(applied(ahead[-1], by[key]))
        for key in reversed(chain[1:]):
            behind.append(applied_back(by[key], behind[-1]))
        for n, (key, before, after) in enumerate(zip(chain, ahead, reversed(behind))):
            out[key] = Border(before, after, n == len(chain) - 1)
    return out


def _passages(borders: dict[tuple[int, int], Border]):
    """For each state in which a piece may be entered, the states in which it is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part, number, payload in zip(*(c.to_pylist() for c in batch.columns)):
                border = borders.get((part, number))
                if border is None:
                    continue
                steps = [Step(*s) for s in json.loads(B.unsqueeze(payload))]
                ahead, behind = inserts(border.before), backward(border.after, steps)[0]
                total = min(ahead[q] + behind[q] for q in STATES)
                left = {str(q): sorted(walk(steps, {q}, border.before, border.after, border.last)[1]) for q in STATES if ahead[q] + behind[q] == total}
                rows.append((part, number, json.dumps(left)))
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate((pa.int32(), pa.int32(), pa.string()))], names=["part", "number", "passage"])

    return run


def _entered(borders: dict[tuple[int, int], Border], ends: list, passages: dict[tuple[int, int], dict]) -> dict[tuple[int, int], Border]:
    out = dict(borders)
    for chain in _chains([(r["part"], r["number"], r["conv"]) for r in ends]):
        states: set[int] = {START}
        for key in chain:
            own = borders[key]
            out[key] = Border(own.before, own.after, own.last, tuple(sorted(states)))
            states = {to for q in states for to in passages[key][str(q)]}
    return out


def _finished(borders: dict[tuple[int, int], Border], finish):
    """Runs ``finish`` (part, piece, border or None, letters, cost) over the pieces of every range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The first conversation of a range is number -1, the last one -2; one alone is -1.
        held, number, part, pieces = None, -1, None, Pieces(keep=True)

        def done(piece: Piece, number: int) -> Iterator[pa.RecordBatch]:
            border = borders.get((part, number))
            known = border or Border(BEGIN, END, True)
            letters, _, cost = walk(piece.steps, set(known.entered), known.before, known.after, known.last)
            return finish(part, piece, border, letters, cost)

        for batch in batches:
            for part, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                for own in _read(B.unseal(payload.as_buffer()).to_batches()):
                    if (piece := pieces.feed(own)) is not None:
                        if held is not None:
                            yield from done(held, number)
                            number = 0
                        held = piece
        if (piece := pieces.close()) is not None:
            if held is not None:
                yield from done(held, number)
                number = -2
            yield from done(piece, number)

    return run


def _repair(rows: DataFrame, finish, schema: str) -> DataFrame:
    packed = checkpoint(_ordered(rows).mapInArrow(_packed, _PACKED))
    # Two rows a range at most: a bound that the number of ranges sets, not the data.
    ends = packed.where("number < 0").select("part", "number", "conv", "costs").collect()
    borders = _borders(ends)
    if borders:
        found = packed.where("number < 0").select("part", "number", "payload").mapInArrow(_passages(borders), "part int, number int, passage string").collect()
        borders = _entered(borders, ends, {(r["part"], r["number"]): json.loads(r["passage"]) for r in found})
    return packed.where("number >= 0").select("part", "payload").mapInArrow(_finished(borders, finish), schema)


def _typed(rows: DataFrame) -> tuple[str, pa.DataType]:
    kind = rows.schema["conv_id"].dataType.simpleString()
    return kind, pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, at, edit, role, text): the rows of every conversation after its cheapest repair, and what was done.

    ``rows`` has conv_id (a number or text), turn, role and text, and may have ``times``, how often a row
    stands there. ``at`` orders the rows of a conversation, ``edit`` is K, R, D or I; of a deleted row
    role and text are empty. Of repairs of one cost the one whose letters come first counts.

    Rows go by turn, null first; rows of one turn by role and then by the SHA-256 of the text. A null role or text is one space,
    a null conv_id is a conversation of its own. Rows that repeat are duplicates. A conversation without rows has none in the
    result; other columns are not read; an empty table gives an empty result.
    """
    kind, arrow = _typed(rows)
    schema = pa.schema([("conv_id", arrow), ("at", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def finish(part: int, piece: Piece, border: Border | None, letters: list, cost: int) -> Iterator[pa.RecordBatch]:
        own = list(piece.repaired(letters))
        if own:
            columns = [[piece.conv] * len(own), [(part << 40) + n for n in range(len(own))], *zip(*own)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return _repair(rows, finish, f"conv_id {kind}, at long, edit string, role string, text string")


_COUNTS = ("gaps", BLANK, DUPLICATE, TRUNCATED, "illegal", "cost")


def audit(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation.

    ``rows`` and cases as in ``repair``; a conversation whose rows all have ``times`` 0 has zeros, an empty audit
    and the hash of the empty string. The repaired rows are hashed as role, colon and text, a newline between. What is sent on of a
    conversation in several ranges goes in chunks, and is hashed as it comes by.
    """
    kind, arrow = _typed(rows)
    middle = f"conv_id {kind}, part int, chunk int, facts string, audit string, digest string, said binary"
    middle_schema = pa.schema([("conv_id", arrow), ("part", pa.int32()), ("chunk", pa.int32()), ("facts", pa.string()), ("audit", pa.string()), ("digest", pa.string()), ("said", pa.binary())])
    names = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]
    out_schema = pa.schema([(n, arrow if n == "conv_id" else pa.int64() if n in _COUNTS else pa.string()) for n in names])

    def finish(part: int, piece: Piece, border: Border | None, letters: list, cost: int) -> Iterator[pa.RecordBatch]:
        facts = piece.counts | {"illegal": piece.illegal, "cost": cost, "first": piece.first, "last": piece.last, "turns": piece.turns, "low": piece.low, "high": piece.high}
        edits, lines, size, digest, chunk, begun = [], [], 0, hashlib.sha256(), 0, False

        def row(last: bool) -> pa.RecordBatch:
            said = "".join(lines).encode()
            if border is None:
                digest.update(said if begun else said[1:])
            values = (piece.conv, part, chunk, json.dumps(facts) if last else None, "".join(edits), digest.hexdigest() if last and border is None else None, b"" if border is None else said)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, middle_schema)], schema=middle_schema)

        for letter, role, text in piece.repaired(letters):
            edits.append(letter)
            if letter != DELETE:
                lines.append(f"\n{role}:{text}")
                size += len(lines[-1])
            if size >= CHUNK_BYTES or len(edits) >= CHUNK_BYTES:
                yield row(False)
                begun = begun or bool(lines)
                edits, lines, size, chunk = [], [], 0, chunk + 1
        yield row(True)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Conversations from their pieces, which come in order."""
        conv, open_, facts, edits, digest, whole = None, False, None, [], hashlib.sha256(), None
        said_any = False

        def closed() -> tuple:
            gaps = 0 if facts["low"] is None else facts["high"] - facts["low"] + 1 - facts["turns"]
            return (conv, gaps, *(facts[c] for c in _COUNTS[1:]), "".join(edits), whole or digest.hexdigest())

        def emitted(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], f.type) for n, f in enumerate(out_schema)], schema=out_schema)

        for batch in batches:
            rows = []
            for own, _, _, said_facts, said_edits, said_digest, said in _read([batch]):
                if not open_ or own != conv:
                    if open_:
                        rows.append(closed())
                    conv, open_, facts, edits, digest, whole, said_any = own, True, None, [], hashlib.sha256(), None, False
                edits.append(said_edits)
                whole = said_digest or whole
                if said:
                    digest.update(said if said_any else said[1:])
                    said_any = True
                if said_facts:
                    facts = _together(facts, json.loads(said_facts))
            yield emitted(rows)
        if open_:
            yield emitted([closed()])

    pieces = _repair(rows, finish, middle).repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk")
    return pieces.mapInArrow(joined, ", ".join(f"{n} {kind if n == 'conv_id' else 'long' if n in _COUNTS else 'string'}" for n in names))


def _together(a: dict | None, b: dict) -> dict:
    """The facts of two pieces that follow one another."""
    if a is None:
        return b
    out = {k: a[k] + b[k] for k in (BLANK, DUPLICATE, TRUNCATED, "illegal")} | {"cost": b["cost"]}
    if a["last"] is not None and b["first"] is not None:
        out["illegal"] += a["last"] + b["first"] not in LEGAL
    out["first"] = b["first"] if a["first"] is None else a["first"]
    out["last"] = a["last"] if b["last"] is None else b["last"]
    out["low"] = b["low"] if a["low"] is None else a["low"]
    out["high"] = a["high"] if b["high"] is None else b["high"]
    out["turns"] = a["turns"] + b["turns"] - (a["high"] is not None and a["high"] == b["low"])
    return out
