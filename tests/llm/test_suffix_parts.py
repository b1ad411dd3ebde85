"""The strings of a task are sorted in parts of a bounded size, with the same runs."""

import random

import numpy as np
import pyarrow as pa

from corpusloom.llm import blocks, suffix_dedup


def _runs(said):
    rng = random.Random(3)
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(60, 200))) for _ in range(60)]
    texts = ["".join(rng.choice(passages) + str(rng.random()) for _ in range(8)).encode() for _ in range(60)]
    table = pa.table({"doc_id": list(range(60)), "text": pa.array(texts, pa.binary())})
    answers = [(bucket, given[:4] + bytes([said]) * ((len(given) - 4) // 2)) for bucket, _, given in suffix_dedup._questions(table, 1)]
    sent = suffix_dedup._contexts(0, table, answers)
    # As one bucket, from two blocks: the second has documents of larger ids.
    rows = sent.filter(pa.array([r >= 0 for r in sent["bucket"].to_pylist()])).to_pylist()
    for r in list(rows):
        own = np.frombuffer(blocks.unsqueeze(r["given"]), suffix_dedup._CONTEXT).copy()
        own["doc"] += 1000
        rows.append(r | {"block": 1, "given": blocks.squeeze(own.tobytes())})
    batch = pa.RecordBatch.from_pylist([r | {"bucket": 0} for r in rows], schema=sent.schema)
    gone = set()
    for out in suffix_dedup._sorted(iter([batch])):
        for r in out.to_pylist():
            for at, count in np.frombuffer(blocks.unsqueeze(r["answer"]), suffix_dedup._RUN).tolist():
                gone |= {(r["block"], at + k) for k in range(count)}
    return gone


def test_strings_are_sorted_in_parts(monkeypatch):
    sizes, sort = [], suffix_dedup.deep_shallow
    monkeypatch.setattr(suffix_dedup, "deep_shallow", lambda buffer, starts, lengths: sizes.append(len(starts)) or sort(buffer, starts, lengths))
    for said in (1, 2):  # contexts by their anchors, strings one by one
        found = []
        for at_once in (1 << 30, 1000):
            monkeypatch.setattr(suffix_dedup, "STRINGS_AT_ONCE", at_once, raising=False)
            found.append(_runs(said))
        assert found[0] == found[1] and len(found[0]) > 10_000
    sizes.clear()
    _runs(1)
    assert len(sizes) > 20 and max(sizes[1:]) < 3000, max(sizes[1:])  # the first are the contexts of the block itself
