import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import near_dedup as N
from tessera.llm import similarity
from tessera.llm.simhash import words_of


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows):
    sets = [set(N.shingle_set(words_of(t)).tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]) >= N.ALIKE:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return {i: min((rows[k][0] for k in g if rows[k][0] is not None), default=None) for g in groups.values() for i in g}


def test_planted_copies(spark):
    rng = random.Random(3)
    bank = [f"w{k}" for k in range(3000)]
    texts = [[rng.choice(bank) for _ in range(rng.randrange(60, 400))] for _ in range(60)]
    rows = []
    for k, words in enumerate(texts):
        rows.append((len(rows), " ".join(words)))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(words)
            for _ in range(rng.randrange(0, max(1, len(copy) // 70) + 1)):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((len(rows), " ".join(copy)))
    base = [rng.choice(bank) for _ in range(200)]
    rows += [(len(rows) + k, " ".join([*base[:k], "x", *base[k:]])) for k in range(100)]  # one dense group
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(df).collect()}
    missed = [i for i, _ in rows if got[i] != want[i]]
    assert len(missed) <= 0.03 * len(rows)
    assert all(want[i] == want[got[i]] for i, _ in rows)  # never a group too large
    left = N.drop_near_duplicates(df)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, c in got.items() if i == c)


def test_appended_cut_and_replaced_copies(spark):
    rng = random.Random(7)
    bank = [f"w{k}" for k in range(3000)]
    some = lambda n: [rng.choice(bank) for _ in range(n)]
    rows = []
    for k in range(90):
        words = some(rng.choice([30, 100, 300, 900]))
        share = int(len(words) * rng.uniform(0.05, 0.12 if k % 3 == 2 else 0.26))
        at = rng.randrange(len(words) - share)
        copy = [words + some(share), words[: len(words) - share], words[:at] + some(share) + words[at + share :]][k % 3]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
    rows += [(len(rows) + k, " ".join(bank[:40] + some(20))) for k in range(40)]  # one passage in many unlike texts
    want = brute(rows)
    assert sum(want[i] == i - 1 for i in range(1, 180, 2)) > 30  # of each kind some are alike enough, some not
    assert sum(want[i] == i for i in range(1, 180, 2)) > 5
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: want[i] for i, _ in rows}


def test_unlike_texts_around_one_passage_are_no_candidates(spark, monkeypatch):
    rng = random.Random(9)
    bank = [f"w{k}" for k in range(5000)]
    some = lambda n: [rng.choice(bank) for _ in range(n)]
    passage = some(200)
    texts = [some(rng.choice([40, 42, 55])) + passage for _ in range(80)]  # 0.65 to 0.71 alike
    texts += [t[3 + k % 9 :] for k, t in enumerate(texts[:20])] + [passage[k:] + some(k) for k in range(1, 12)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    counts, real = [], similarity._verified

    def counted(pairs, *rest):
        counts.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(similarity, "_verified", counted)
    want = brute(rows)
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and any(want[i] != i for i, _ in rows)
    assert counts[1] + counts[2] <= 10 * len(rows)  # all pairs are over 6,000


def test_a_first_shared_shingle_says_which_sizes_fit(spark):
    rng = np.random.default_rng(6)
    seen = []
    for _ in range(400):
        a = rng.permutation(1 << 12)[: rng.integers(1, 300)]
        b = np.concatenate((a[rng.integers(0, len(a) // 4 + 1) :], (1 << 12) * rng.integers(0, 2) + rng.permutation(1 << 12)[: rng.integers(0, len(a) // 5 + 1)]))
        a, b = sorted((np.unique(a), np.unique(b)), key=len)
        both = np.intersect1d(a, b)
        if len(both) and len(both) / len(np.union1d(a, b)) >= N.ALIKE:
            seen.append((len(a), int(np.searchsorted(a, both[0])), len(b), int(np.searchsorted(b, both[0]))))
    most = lambda n, at: (n - at) * 2.25 - n + 1e-6
    assert len(seen) > 50 and all(nb <= most(na, i) and na <= most(nb, j) for na, i, nb, j in seen)
    classes = [r[0] for r in spark.range(1, 5000).select(N.size_class(F.col("id"))).collect()]
    assert classes == sorted(classes) and max(classes[k + 1] - classes[k] for k in range(20, 4998)) == 1


def test_no_candidate_is_lost_to_the_order_or_the_parities():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 9, 10, 64, 1000):
        for _ in range(50):
            a = np.unique(rng.integers(-(1 << 63), 1 << 63, n))
            fresh = rng.integers(-(1 << 63), 1 << 63, rng.integers(0, n // 4 + 1))
            b = np.unique(np.concatenate((rng.permutation(a)[rng.integers(0, n // 5 + 1) :], fresh)))
            either = np.union1d(a, b)
            if len(np.intersect1d(a, b)) / len(either) < N.ALIKE:
                continue
            often = np.unique(rng.permutation(either)[: len(either) // 2])
            times = rng.integers(1, 9, len(often))
            assert len(np.intersect1d(N.leading(a, N.ALIKE, often, times), N.leading(b, N.ALIKE, often, times)))
            p, q = sorted((N.parities(a), N.parities(b)), key=len)
            q = q if len(p) == len(q) else q[: len(p)] ^ q[len(p) :]
            assert np.bitwise_count((p ^ q).view(np.uint64)).sum() <= len(np.setxor1d(a, b)) <= (len(a) + len(b)) * (1 - N.ALIKE) / (1 + N.ALIKE) + 1e-6


def test_hot_buckets_are_split(spark, monkeypatch):
    rng = random.Random(8)
    centre = rng.getrandbits(64)
    points = {N.signed(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6)))) for _ in range(150)}
    df = spark.createDataFrame([(p,) for p in points], "fingerprint long")
    monkeypatch.setattr(N, "HOT", 10)
    together = {}
    for r in N.candidate_groups(df).collect():
        assert r["root"] is not None
        together.setdefault((r["table"], r["root"]), set()).add(r["fingerprint"])
    found = {(a, b) for g in together.values() for a in g for b in g}
    near = {(a, b) for a in points for b in points if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= N.RADIUS}
    assert near and near <= found


def test_awkward(spark, awkward, nothing):
    left = N.drop_near_duplicates(awkward)
    assert left.columns == awkward.columns and 0 < left.count() < awkward.count()
    assert N.drop_near_duplicates(nothing).count() == 0


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    total = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert 0 < docs.count() <= total
        total = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert packed.select("doc_id").distinct().count() == total


def test_stages_on_nothing(spark, nothing):
    docs = nothing.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0
