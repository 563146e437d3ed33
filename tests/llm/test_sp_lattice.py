import hashlib
import itertools
import pickle
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from tessera.llm import sp_lattice as S

SP = sentencepiece.SentencePieceProcessor(model_file=S.model_path())


def check(spark, folder, rows):
    got = S.op8_sentencepiece(spark, folder).collect()
    want = []
    for i, t in rows:
        ids = SP.encode(t or "")
        want.append((i, len(ids), ids, hashlib.sha256(SP.decode(ids).encode()).hexdigest()))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_documents(spark):
    d = "/root/testdata/sf0.001"
    check(spark, d, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()])


def test_awkward(spark, tmp_path, awkward):
    odd = ["  two  spaces ", "▁mark", "tab\tand\nline", "é x　日本語", "q" * 3000, "<s></s><unk><0x0A>", "ﬁ🙂🙂" * 9, "a" * 31 + " " + "ab" * 16 + " " + "abc" * 30]
    df = awkward.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    check(spark, str(tmp_path), [(r["doc_id"], r["text"]) for r in df.collect()])


def test_nothing(spark, nothing):
    assert S.encode(nothing).count() == 0
    assert S.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>")).select("text").collect() == [(None,), ("",)]


def test_known_units_come_back_from_a_broadcast():
    units = ["a", "▁bé", "🙂", "▁" * 40, "\ud800"]
    sent = S.Known([u.encode("utf-8", "surrogatepass") for u in units], [bytes([i]) * i for i in range(len(units))])
    sent.table()
    assert pickle.loads(pickle.dumps(sent)).table() == {u: bytes([i]) * i for i, u in enumerate(units)}
    assert S.Known([], []).table() == {}


def test_heap_merges_equal_the_library():
    rng = random.Random(4)
    model = S.loaded(S.model_path())
    for _ in range(200):
        unit = S.SPACE + "".join(rng.choice("thenaiso") for _ in range(rng.randrange(1, 60)))
        assert model.ids(unit, S.merged(unit, model)) == SP.encode(unit[1:])
        assert S.alone(unit, model) == S.merged(unit, model)


@pytest.mark.parametrize("seed", range(3))
def test_viterbi_is_the_best_of_all_paths(spark, seed):
    rng = random.Random(seed)
    pieces = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))): -rng.random() * 5 for _ in range(14)}
    units = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))) for _ in range(25)]
    low = min(pieces.values()) - 10
    table = spark.createDataFrame(list(pieces.items()), "piece string, score double")
    made = S.lattices(spark.createDataFrame([(u,) for u in set(units)], "unit string"), table, 3, 1)
    got = {r["unit"]: r["cuts"] for r in made.select("unit", S.fold_viterbi(F.char_length("unit"), F.col("edges"), low).alias("cuts")).collect()}

    def worth(u, cuts):
        return sum(pieces.get(u[s:e], low if e - s == 1 else float("-inf")) for s, e in itertools.pairwise(cuts))

    for u in units:
        every = ([0, *c, len(u)] for n in range(len(u)) for c in itertools.combinations(range(1, len(u)), n))
        assert worth(u, got[u]) == pytest.approx(max(worth(u, c) for c in every))
