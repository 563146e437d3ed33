import random
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

from tessera.llm import packing as P
from tessera.llm.bpe import encoder

TOKENIZER = Tokenizer.from_file(P.tokenizer_path())


def check(spark, folder, rows):
    got = P.op10_packing(spark, folder).collect()
    want = []
    for i, t in rows:
        ids = np.array([*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048), len(ids)]
        want += [(i, k, s, e - s, zlib.crc32(ids[s:e].tobytes())) for k, (s, e) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    return len(held), -(-sum(w[3] for w in want) // 2048)


def test_documents(spark, monkeypatch):
    solved = []
    for name in ("levelled", "averaged"):
        monkeypatch.setattr(P, name, lambda count, solve=getattr(P, name): solved.append(count.sum()) or solve(count))
    d = "/root/testdata/sf0.01"
    used, least = check(spark, d, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()])
    assert used <= least + 1
    assert solved  # the configuration LP is solved at every size


def test_awkward(spark, tmp_path, awkward, nothing):
    awkward.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    check(spark, str(tmp_path / "a"), [(r["doc_id"], r["text"]) for r in awkward.collect()])
    nothing.write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert P.op10_packing(spark, str(tmp_path / "b")).count() == 0


def test_plans_hold_exactly_the_pieces():
    rng = random.Random(2)
    for capacity, most in ((50, 50), (200, 90), (200, 200), (2048, 700), (2048, 2048)):
        histogram = {rng.randrange(1, most + 1): rng.randrange(1, 2000) for _ in range(60)}
        plan = P.packed(histogram, capacity)
        held = Counter()
        for config, n in plan.items():
            assert sum(config) <= capacity and n > 0
            for length in config:
                held[length] += n
        assert held == Counter(histogram)
        best = sum(P.best_fit(Counter(histogram), capacity).values())
        assert sum(plan.values()) <= 1.01 * best + 1


def test_knapsack_is_exact():
    rng = np.random.default_rng(0)
    value = np.where(rng.random(41) < 0.3, rng.random(41), -1.0)
    value[0] = -1
    best, _ = P.priced(value)
    exact = [0.0] * 41
    for room in range(1, 41):
        exact[room] = max(exact[room - 1], *(value[x] + exact[room - x] for x in range(1, room + 1)))
    assert np.allclose(best, exact)


def test_ids_equal_the_library():
    rng = random.Random(1)
    encode = encoder(P.tokenizer_path())
    alphabet = list("abc  '\n\t.,1é日🙂") + ["'s", " the", "<|endoftext|>", " ", "​", "İ"]
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        assert encode(text).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_long_runs_of_one_kind():
    encode = encoder(P.tokenizer_path())
    for text in (" " * 2_000_000, "\n" * 2_000_000 + "a", "a" + " \n" * 60_000 + "\u3000b", "x" * 2_000_000, "a" + "\t" * 70_000 + "<|endoftext|>" + " " * 60_000 + "é", " " * 49_999 + "a"):
        assert encode(text).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_the_lp_is_solved_for_any_histogram(monkeypatch):
    seen = []
    monkeypatch.setattr(P, "levelled", lambda count, solve=P.levelled: seen.append(1) or solve(count))
    for histogram in ({1: 1}, {2048: 3}, {700: 1, 900: 2}, {1: 5000}):
        plan = P.packed(histogram)
        assert Counter({x: n for x in histogram for n in [sum(k * c.count(x) for c, k in plan.items())]}) == Counter(histogram)
    assert len(seen) == 4


def test_few_pieces_are_packed_as_well_as_can_be():
    """Against every partition of up to eight pieces."""
    rng = random.Random(3)

    def fewest(left, bins):
        if not left:
            return len(bins)
        best = len(left) + len(bins)
        for k, b in enumerate(bins):
            if b + left[0] <= 100:
                best = min(best, fewest(left[1:], [*bins[:k], b + left[0], *bins[k + 1 :]]))
        return min(best, fewest(left[1:], [*bins, left[0]]))

    over = 0
    for _ in range(30):
        lengths = [rng.randrange(10, 90) for _ in range(8)]
        over += P.packed(Counter(lengths), 100).total() - fewest(lengths, [])
    assert over <= 3
