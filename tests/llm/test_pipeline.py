"""The stages one after another against what each must leave."""

import hashlib
import random

import pytest

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    rng = random.Random(5)
    vocabulary = [a + b + c for a in ("ba", "co", "di", "fu") for b in ("l", "m", "n", "r") for c in ("a", "en", "is", "o", "ut")]
    texts = [" ".join(rng.choices(vocabulary, k=60)) for _ in range(30)]
    item = " ".join(rng.choices(vocabulary, k=25))
    near = texts[3].split()
    near[30] = "changed"
    rows = [*texts, texts[0], texts[1].replace(" ", "\n"), " ".join(near), f"{texts[5][:150]} {item} {texts[6][:100]}", "漢字" * 40]
    spark.createDataFrame([(n, t, "en" if n < 34 else None, f"s{n % 3}", len(t)) for n, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    own = Tokenizer.from_file(path)
    expected = set()
    for n in range(30):
        ids = own.encode(rows[n], add_special_tokens=False).ids
        expected.add((n, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    assert {tuple(r)[:3] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == expected


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, folder, rows, items):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))


def test_awkward_rows(spark, tmp_path):
    """Null and repeated ids, null and empty texts: of each text one row stays, none is lost."""
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    rng = random.Random(6)
    speech = ["the", "and", "thing", "with", "other", "people", "water", "under", "house", "never", "small", "great"]
    text = lambda: " ".join(rng.choices(speech, k=40)) + f" {rng.randrange(10**9)} {rng.choice(speech)}"
    a, b, c, d, *more = [text() for _ in range(60)]
    near = b.replace(b.split()[20], "altered", 1)
    long = " ".join(text() for _ in range(600))
    item = " ".join(rng.choices([f"item{n}" for n in range(90)], k=20))
    rows = [(1, a), (None, a), (None, b), (2, c), (2, a.replace(" ", "  ")), (None, near), (3, d), (3, d), (None, long), (None, f"{text()} {item} {text()}"), (7, None), (None, ""), *((n + 10, t) for n, t in enumerate(more))]
    written(spark, tmp_path, [(i, t, "en", "s", None) for i, t in rows], [(1, item), (2, None), (2, "")])
    own = Tokenizer.from_file(path)
    digest = lambda t: hashlib.sha256(" ".join(map(str, own.encode(t, add_special_tokens=False).ids)).encode()).hexdigest()
    found = sorted((r["ids_sha256"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()))
    kept = [digest(a), digest(c), digest(d), digest(long), *map(digest, more)]
    assert len(found) == len(kept) + 2 and set(kept) <= set(found)  # one of b and near, one empty text
    assert len({digest(b), digest(near)} & set(found)) == 1 and found.count(digest("")) == 1


def test_empty_table(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    written(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
