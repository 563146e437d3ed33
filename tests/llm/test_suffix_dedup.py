import hashlib
import random

import numpy as np
import pytest

from tessera.llm import suffix_dedup as S

LOW = -(1 << 63)


def brute(rows):
    """(n_bytes, n_removed, n_spans, kept digest) per row, straight from the definition."""
    docs = [((LOW if i is None else i), (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in docs:
        for p in range(len(b) - S.LENGTH + 1):
            w = b[p : p + S.LENGTH]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, b in docs:
        gone = bytearray(len(b))
        for p in range(len(b) - S.LENGTH + 1):
            if least[b[p : p + S.LENGTH]] < i:
                gone[p : p + S.LENGTH] = b"\1" * S.LENGTH
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((None if i == LOW else i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, tmp_path, df):
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return sorted((tuple(r) for r in S.op7_suffix_dedup(spark, str(tmp_path)).collect()), key=str)


def test_awkward(spark, tmp_path, awkward):
    assert run(spark, tmp_path, awkward) == brute([(r["doc_id"], r["text"]) for r in awkward.collect()])


def test_nothing(spark, tmp_path, nothing):
    assert run(spark, tmp_path, nothing) == []


@pytest.mark.parametrize("letters", ["ab", "abcdefgh "])
def test_random_passages(spark, tmp_path, letters, monkeypatch):
    rng = random.Random(len(letters))
    bank = ["".join(rng.choice(letters) for _ in range(rng.choice([49, 50, 51, 70, 140]))) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [rng.choice([rng.choice(bank), "".join(rng.choice(letters) for _ in range(rng.randrange(30)))]) for _ in range(rng.randrange(8))]
        rows.append((i // 2 * 2 if i % 9 == 0 else i, "".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert run(spark, tmp_path, df) == brute(rows)


def test_documents(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in S.op7_suffix_dedup(spark, d).collect()), key=str) == brute(rows)


def test_dropping_keeps_columns(spark, awkward):
    out = S.drop_repeats(awkward)
    assert out.columns == awkward.columns
    assert out.where("text is null").count() == awkward.where("text is null").count()


def test_blind_tries_sort():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab\0") for _ in range(6)) for _ in range(300)]
    order, classes = S.blind_tries([int.from_bytes(s) for s in strings], 6)
    assert [strings[i] for i in order] == sorted(set(strings))
    assert all((classes[i] == classes[j]) == (strings[i] == strings[j]) for i in range(300) for j in range(0, 300, 7))


def test_suffix_order():
    rng = np.random.default_rng(2)
    text = rng.integers(97, 99, 4000).astype(np.uint8)
    text[1000:2000] = text[:1000]
    at = np.arange(len(text) - S.LENGTH)
    order, classes = S.suffix_classes(text, at, np.zeros(len(at), np.int64))
    keys = [text[p : p + S.LENGTH].tobytes() for p in at]
    assert [keys[i] for i in order] == sorted(keys)
    assert all(classes[p] == classes[p + 1000] for p in range(950)) and len(set(classes)) == len(set(keys))


def test_dropping_against_brute_force(spark):
    rng = random.Random(9)
    bank = ["".join(rng.choice("abcdef ") for _ in range(rng.choice([30, 60, 120]))) for _ in range(8)]
    rows = [(i, "".join(rng.choice([rng.choice(bank), f"own {rng.random()} "]) for _ in range(rng.randrange(6)))) for i in range(60)]
    rows += [rows[7], (7, "another text of one id" * 4), (80, rows[7][1]), (81, "short"), (82, "short"), (83, None), (None, bank[0] + bank[1])]
    left = S.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want = []
    docs = [((LOW if i is None else i), (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in docs:
        for p in range(len(b) - S.LENGTH + 1):
            least[b[p : p + S.LENGTH]] = min(least.get(b[p : p + S.LENGTH], i), i)
    for (i, b), (k, t) in zip(docs, rows):
        cut = {q for p in range(len(b) - S.LENGTH + 1) if least[b[p : p + S.LENGTH]] < i for q in range(p, p + S.LENGTH)}
        kept = bytes(x for p, x in enumerate(b) if p not in cut).decode()
        if not cut or kept:
            want.append((k, kept if cut else t))
    assert sorted((tuple(r) for r in left), key=str) == sorted(want, key=str)
