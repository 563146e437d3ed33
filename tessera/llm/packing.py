"""Best-fit packing: token sequences of bounded length packed by a configuration linear program.

The lengths of all pieces form a histogram of at most `capacity` rows. Over it
stands the configuration LP: choose how many sequences hold each multiset of
lengths, so that every length is covered, with as few sequences as can be.
Multiplicative weights solve it: in each round a knapsack dynamic program
prices configurations under the present weights, and covered lengths lose
weight. The solution is rounded down; best fit places what remains. A plan of
bounded size then says which rank of which length goes where, and the pieces
themselves are only ranked within their lengths and looked up.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import encoder
from tessera.llm.common import documents, gapless_rank, shipped, written

CAPACITY = 2048
#: Rounds of multiplicative weights, and how sharply a covered length loses weight.
ROUNDS, RATE = 40, 0.15
#: Id after each document.
END = 0


def tokenizer_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(key, piece, start, length, ids_crc32) per piece of each text's ids and END.

    Null text: empty, so END alone. Only texts of over `capacity` ids are cut, into
    full pieces after a first one that takes the remainder. Repeated rows give
    repeated pieces.
    """
    shipped(df.sparkSession)
    path = tokenizer or tokenizer_path()

    def cut(text: str | None, encode) -> list[tuple[int, int, int, int]]:
        ids = np.append(encode(text or ""), END).astype("<u4")
        first = len(ids) % capacity or capacity
        starts = [0, *range(first, len(ids), capacity)]
        ends = [*starts[1:], len(ids)]
        return [(i, s, e - s, zlib.crc32(ids[s:e].tobytes())) for i, (s, e) in enumerate(zip(starts, ends, strict=True))]

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            rows = [(k, *p) for k, t in zip(batch[key], batch["__text"], strict=True) for p in cut(t, encode)]
            yield pd.DataFrame(rows, columns=[key, "piece", "start", "length", "ids_crc32"]).astype({key: batch[key].dtype})

    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return df.select(F.col(key), F.col(text).alias("__text")).mapInPandas(run, schema)


def priced(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value within each room, and the last length taken (0: none). value[l]: of length l, negative if absent."""
    capacity = len(value) - 1
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        got = value[1 : room + 1] + best[room - 1 :: -1]
        at = int(got.argmax())
        if got[at] > best[room - 1]:
            best[room], last[room] = got[at], at + 1
        else:
            best[room], last[room] = best[room - 1], 0
    return best, last


def configurations(lengths: np.ndarray, last: np.ndarray) -> list[tuple[int, ...]]:
    """For each length the configuration that holds it and the best of what then fits."""
    capacity = len(last) - 1
    found = []
    for length in lengths.tolist():
        room, held = capacity - length, [length]
        while room > 0:
            if last[room]:
                held.append(int(last[room]))
                room -= int(last[room])
            else:
                room -= 1
        found.append(tuple(sorted(held, reverse=True)))
    return found


def levelled(count: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> dict[tuple[int, ...], float]:
    """Multiplicative weights in levels: round after round every length is brought up to the same cover, as far as its best configurations go.

    Fractional sequences per configuration; lengths that still lag after all
    rounds are covered in part. Fast to near the bound where many lengths mix.
    """
    capacity = len(count) - 1
    lengths = np.flatnonzero(count)
    covered = np.zeros(capacity + 1)
    used: dict[tuple[int, ...], float] = defaultdict(float)
    for at in range(rounds):
        lag = covered[lengths] / count[lengths]
        value = np.full(capacity + 1, -1.0)
        value[lengths] = lengths / capacity * np.exp(-rate * (lag - lag.mean()))
        best, last = priced(value)
        need = lengths[lag <= (at + 1)]
        worth = value[need] + best[capacity - need]
        top = worth >= np.quantile(worth, 0.25) if len(worth) > 8 else np.ones(len(worth), bool)
        for config in configurations(need[top], last):
            of = Counter(config)
            step = min((at + 1 - covered[x] / count[x]) * count[x] / n for x, n in of.items())
            if step > 0:
                used[config] += step
                for x, n in of.items():
                    covered[x] += step * n
    scale = max((covered[lengths] / count[lengths]).min(), rounds / 2)
    return {c: x / scale for c, x in used.items()}


def averaged(count: np.ndarray, rounds: int = 2 * ROUNDS, tight: float = 0.05) -> dict[tuple[int, ...], float]:
    """Multiplicative weights by averages: each round spreads one unit over the configurations that the prices make tight.

    Fractional sequences per configuration that cover half of the lengths in
    full. Better where few lengths fit together in few ways.
    """
    capacity = len(count) - 1
    lengths = np.flatnonzero(count)
    n, place = count[lengths], np.zeros(capacity + 1, np.int64)
    place[lengths] = np.arange(len(lengths))
    weight = lengths * n / (lengths * n).sum()
    used: dict[tuple[int, ...], float] = defaultdict(float)
    covered = np.zeros(len(lengths))
    for at in range(rounds):
        value = np.full(capacity + 1, -1.0)
        value[lengths] = weight / n
        best, last = priced(value)
        near = np.flatnonzero(value[lengths] + best[capacity - lengths] >= (1 - tight) * best[capacity])
        gain = np.zeros(len(lengths))
        for share, config in zip(weight[near] / weight[near].sum(), configurations(lengths[near], last), strict=True):
            used[config] += share
            for x in config:
                gain[place[x]] += share / n[place[x]]
        covered += gain
        weight = weight * np.exp(-0.5 / np.sqrt(at + 1) * (gain / (gain @ weight) - 1).clip(-1, 3))
        weight /= weight.sum()
    scale = np.median(covered)
    return {c: x / scale for c, x in used.items()}


def best_fit(left: Counter, capacity: int) -> Counter:
    """Best-fit decreasing over a histogram, all equal bins at once: sequences per configuration."""
    bins: dict[int, Counter] = defaultdict(Counter)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            room = min((r for r in bins if r >= length and bins[r]), default=None)
            if room is None:
                each = capacity // length
                if n >= each:
                    bins[capacity - each * length][(length,) * each] += n // each
                if n % each:
                    bins[capacity - n % each * length][(length,) * (n % each)] += 1
                break
            config, many = next(iter(bins[room].items()))
            moved = min(n, many)
            bins[room][config] -= moved
            if not bins[room][config]:
                del bins[room][config]
            bins[room - length][(*config, length)] += moved
            n -= moved
    done: Counter = Counter()
    for held in bins.values():
        done.update(held)
    return done


def rounded(histogram: dict[int, int], capacity: int, solve, levels: int) -> Counter:
    """Sequences per configuration that hold exactly the pieces: `solve` rounded down, again on what is left, and best fit at last."""
    left: Counter = Counter(histogram)
    plan: Counter = Counter()
    for _ in range(levels):
        count = np.zeros(capacity + 1)
        for length, n in left.items():
            count[length] = n
        before = left.total()
        for config, x in sorted(solve(count).items(), key=lambda cx: (-cx[1], cx[0])):
            of = Counter(config)
            n = min(int(x), *(left[length] // k for length, k in of.items()))
            if n > 0:
                plan[config] += n
                for length, k in of.items():
                    left[length] -= k * n
        left = +left
        if not left or left.total() > 0.9 * before:  # hardly a share reaches a whole sequence any more: rounding again would place next to nothing
            break
    plan.update(best_fit(left, capacity))
    return plan


def packed(histogram: dict[int, int], capacity: int = CAPACITY) -> Counter:
    """Sequences per configuration that hold exactly the pieces of the histogram: the better of two runs of multiplicative weights.

    The second is spared if the first comes within a thousandth of the bound that the tokens set.
    """
    histogram = {length: n for length, n in histogram.items() if n}
    if not histogram:
        return Counter()
    plan = rounded(histogram, capacity, levelled, 1)
    if plan.total() * capacity > 1.001 * sum(length * n for length, n in histogram.items()):
        other = rounded(histogram, capacity, averaged, 8)
        plan = min(plan, other, key=Counter.total)
    return plan


def placements(plan: Counter) -> dict[int, np.ndarray]:
    """For each length rows (first rank, pieces in a sequence, first sequence, offset of the first of them), by rank."""
    taken: Counter = Counter()
    rows: dict[int, list] = defaultdict(list)
    first = 0
    for config, many in sorted(plan.items()):
        offset = 0
        for length, k in sorted(Counter(config).items(), reverse=True):
            rows[length].append((taken[length], k, first, offset))
            taken[length] += k * many
            offset += k * length
        first += many
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def pack(df: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """df (a row per piece, with its `length` from 1 to capacity) with sequence_id and offset.

    Every row is placed; offsets in a sequence are gapless from 0. The histogram
    and the plan are bounded by `capacity`, not by the rows. Ties and repeated
    rows each get a place. An empty table stays empty.
    """
    counted = df.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most `capacity` rows
    plan = placements(packed({r["length"]: r["n"] for r in counted}, capacity))
    shared = df.sparkSession.sparkContext.broadcast(plan)
    ranked = gapless_rank(df, ["length"], [c for c in df.columns if c != "length"], "__rank")

    def place(batches):
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["__rank"].to_numpy()
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for x in np.unique(length):
                of = np.flatnonzero(length == x)
                rows = shared.value[int(x)]
                at = rows[np.searchsorted(rows[:, 0], rank[of], side="right") - 1]
                sequence[of] = at[:, 2] + (rank[of] - at[:, 0]) // at[:, 1]
                offset[of] = at[:, 3] + (rank[of] - at[:, 0]) % at[:, 1] * x
            yield batch.drop(columns="__rank").assign(sequence_id=sequence, offset=offset)

    from pyspark.sql.types import LongType, StructType

    schema = StructType([*df.schema.fields]).add("sequence_id", LongType()).add("offset", LongType())
    return ranked.select(*df.columns, "__rank").mapInPandas(place, schema)


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) per piece of all rows of df; see pieces() and pack()."""
    return pack(written(pieces(df, key, text, capacity, tokenizer), "pieces"), capacity)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of CAPACITY tokens.

    Null texts count as empty: one piece of END alone. Rows that repeat doc_id or
    text are packed each; null doc_ids too. Ties in length get any rank. An
    empty table gives an empty one.
    """
    return pack_documents(documents(spark, sf_dir))
