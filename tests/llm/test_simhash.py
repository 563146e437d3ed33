import random
import re

import numpy as np
import xxhash

from tessera.llm import simhash as S
from tessera.llm.common import checkpointed
from tessera.llm.components import components


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute(rows):
    prints = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(prints, np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(a[:i] ^ a[i]) <= 3):
            x, y = find(i), find(int(j))
            parent[max(x, y)] = min(x, y)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return sorted(((k, format(p, "016x"), low.get(find(i))) for i, ((k, _), p) in enumerate(zip(rows, prints))), key=str)


def check(spark, folder, rows):
    assert sorted((tuple(r)[:3] for r in S.op1_simhash(spark, folder).collect()), key=str) == brute(rows)


def test_documents(spark):
    d = "/root/testdata/sf0.01"
    check(spark, d, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()])


def test_awkward(spark, tmp_path, awkward):
    awkward.write.parquet(str(tmp_path / "documents.parquet"))
    check(spark, str(tmp_path), [(r["doc_id"], r["text"]) for r in awkward.collect()])


def test_nothing(spark, tmp_path, nothing):
    nothing.write.parquet(str(tmp_path / "documents.parquet"))
    check(spark, str(tmp_path), [])


def test_blocks_change_nothing(monkeypatch):
    words = [b"w%d" % (k % 50) for k in range(500)]
    whole = S.majority(S.hashes(words, 3, 42))
    monkeypatch.setattr(S, "BLOCK", 7)
    assert S.majority(S.hashes(words, 3, 42)) == whole


def test_masks_cover_every_difference_within_the_radius():
    rng = random.Random(1)
    for radius in (1, 2, 3, 4):
        masks = S.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1 and all(28 <= m.bit_count() <= 44 for m in masks)
        for _ in range(3000):
            off = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not m & off for m in masks)


def test_hot_buckets_are_split_without_loss(spark, monkeypatch):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    points = {S.signed(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6)))) for _ in range(150)}
    df = spark.createDataFrame([(p,) for p in points], "fingerprint long")
    plain = {r["node"]: r["component"] for r in components(S.links(df)).collect()}
    monkeypatch.setattr(S, "HOT", 8)
    assert {r["node"]: r["component"] for r in components(S.links(df)).collect()} == plain and plain


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_plans_stay_small(spark, monkeypatch):
    plans = []

    def counted(df):
        plans.append(len(df._jdf.queryExecution().optimizedPlan().treeString().splitlines()))
        return checkpointed(df)

    monkeypatch.setattr("tessera.llm.components.checkpointed", counted)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 100), (200, 200), (7, None)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}
    assert max(plans) <= 20, plans  # the driver plans, explains and logs each of them anew
