"""Near duplicates on five-word shingles: SimHash on covering hashing and shared shingles for candidates, exact Jaccard likeness for links.

A changed word spoils five shingles but one word, so one kind of candidates
comes from fingerprints of the set of words: texts with few changed words differ
in few bits there. Within its radius each fingerprint finds all pairs, by
covering masks. An appended, cut or replaced passage is beyond any such radius,
so the other kind is complete by itself: of two texts that are alike enough, one
of the first shingles of either, in an order that all texts share and that puts
frequent shingles last, is the same. Whether a candidate pair is a link is then
decided by the likeness of the whole shingle sets, and groups lose no link (see
similarity.linked).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, scratch, shipped, shuffle_width, sieve, sifted, written
from tessera.llm.similarity import linked
from tessera.llm.simhash import HOT, covering_masks, hashes, majority, signed, words_of

SHINGLE, ALIKE = 5, 0.8
#: Fingerprints of a text, and the differing bits that each looks up to. Shared shingles find all links by themselves, so one is enough.
PRINTS, RADIUS = 1, 3
#: Least number of bits of the parities by which pairs are sifted.
PARITIES = 512
#: Which shingles come last in their common order: of one text in SAMPLED, those in OFTEN or more, the MOST most frequent.
#: No result depends on it, only the sizes of buckets do.
SAMPLED, OFTEN, MOST = 4, 2, 1 << 18
#: Rows up to which a table of keys is broadcast; a larger one is joined by shuffle.
SMALL = 500_000


def _digest(text: str) -> Column:
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), 1, 32))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def word_prints(words: list[bytes]) -> list[int]:
    """PRINTS independent fingerprints of the set of words; zeros without words."""
    base = np.fromiter((xxhash.xxh64_intdigest(w) for w in set(words)), np.uint64)
    out = []
    for k in range(PRINTS):
        x = (base + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(signed(majority(iter([x ^ (x >> np.uint64(31))]))))
    return out


def shingle_set(words: list[bytes]) -> np.ndarray:
    """The distinct 64-bit hashes of the five-word shingles (of the whole sequence, if shorter)."""
    parts = list(hashes(words, SHINGLE, 0))
    return np.unique(np.concatenate(parts)).view(np.int64) if parts else np.zeros(0, np.int64)


def parities(shingles: np.ndarray) -> np.ndarray:
    """Bits, at least as many as shingles and a power of two, in longs: each the parity of those shingles whose hash leaves its number as remainder.

    Two sets differ in at least as many shingles as bits; the first half xor the second are the bits of half as many.
    """
    most = max(PARITIES, 1 << max(0, len(shingles) - 1).bit_length())
    bits = np.bincount((shingles.view(np.uint64) % np.uint64(most)).astype(np.int64), minlength=most) & 1
    return np.packbits(bits.astype(np.uint8)).view(">i8").astype(np.int64)


def _differing(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of longs, the longer one folded to the length of the other."""

    def xor(x: Column, y: Column) -> Column:
        return F.zip_with(x, y, lambda u, v: u.bitwiseXOR(v))

    def folded(x: Column, other: Column) -> Column:
        half = F.floor(F.size(x) / 2).cast("int")
        return F.when(F.size(x) > F.size(other), xor(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half))).otherwise(x)

    return F.aggregate(xor(folded(a, b), folded(b, a)), F.lit(0), lambda n, x: n + F.bit_count(x))


def leading(shingles: np.ndarray, threshold: float, often: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first n - ceil(threshold n) + 1 of n shingles, by how often they are (`often`, sorted, with `times`) and then by hash.

    Two sets that are `threshold` alike or more share `threshold` of either, so the first
    that they share, in this order, is among these of both.
    """
    n = len(shingles)
    if not n:
        return shingles
    count = np.zeros(n, np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, shingles), len(often) - 1)
        count = np.where(often[at] == shingles, times[at], 0)
    return shingles[np.lexsort((shingles, count))[: n - math.ceil(n * threshold - 1e-9) + 1]]


def size_class(n: Column) -> Column:
    """Classes of sizes, 16 from one power of two to the next, in whole numbers throughout; the more, the larger."""
    power = (F.length(F.bin(n)) - 1).cast("int")
    return (F.when(n > 0, power * 16 + F.call_function("shiftright", F.shiftleft(n, 4), power))).cast("int")


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of the texts in a sample, sorted, and how many texts have each: at most MOST."""

    def run(batches):
        for batch in batches:
            for text in batch["text"]:
                yield pd.DataFrame({"h": shingle_set(words_of(text))})

    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).select("text")
    counted = sample.mapInPandas(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)

    def packed(batches):  # a few rows of bytes, as the driver has no room for MOST objects
        for batch in batches:
            yield pd.DataFrame({"h": [batch["h"].to_numpy("<i8").tobytes()], "n": [batch["n"].to_numpy("<i8").tobytes()]})

    got = counted.orderBy(F.desc("n"), "h").limit(MOST).mapInPandas(packed, "h binary, n binary").collect()
    often, times = (np.frombuffer(b"".join(bytes(r[c]) for r in got), "<i8") for c in ("h", "n"))
    at = np.argsort(often)
    return often[at], times[at]


def _labels(points: np.ndarray, radius: int) -> np.ndarray:
    """For each point the first point of its group, linked at `radius` or fewer differing bits."""
    label = np.arange(len(points))
    left = np.arange(len(points))
    while len(left):
        root, left = left[0], left[1:]
        todo = [root]
        while todo and len(left):
            near = np.bitwise_count(points[left] ^ points[todo.pop()]) <= radius
            found = left[near]
            label[found] = root
            todo.extend(found)
            left = left[~near]
    return label


def _grouped(radius: int, most: int):
    """From rows (table, bucket, fingerprint) sorted so: (table, root, fingerprint) of fingerprints that link in their bucket.

    A bucket of over `most` rows is not gathered: its rows go on with a null root.
    """

    def ends(frame: pd.DataFrame) -> np.ndarray:
        t, b = frame["table"].to_numpy(), frame["bucket"].to_numpy()
        return np.flatnonzero((t[1:] != t[:-1]) | (b[1:] != b[:-1])) + 1

    def settle(frame: pd.DataFrame, edges: np.ndarray) -> Iterator[pd.DataFrame]:
        print_, table = frame["fingerprint"].to_numpy(), frame["table"].to_numpy()
        starts, stops = np.concatenate(([0], edges)), np.concatenate((edges, [len(frame)]))
        root, keep = print_.copy(), np.zeros(len(frame), bool)
        for s, e in zip(starts[stops - starts > 1].tolist(), stops[stops - starts > 1].tolist(), strict=True):
            label = _labels(print_[s:e].astype(np.uint64), radius)
            root[s:e] = print_[s:e][label]
            keep[s:e] = np.bincount(label, minlength=e - s)[label] > 1
        if keep.any():
            yield pd.DataFrame({"table": table[keep], "root": pd.array(root[keep], "Int64"), "fingerprint": print_[keep]})

    def passed(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"table": frame["table"], "root": pd.array([None] * len(frame), "Int64"), "fingerprint": frame["fingerprint"]})

    def run(batches):
        held, large = pd.DataFrame(), None
        for batch in batches:
            if large is not None:
                same = (batch["table"] == large[0]) & (batch["bucket"] == large[1])
                if same.any():
                    yield passed(batch[same])
                batch = batch[~same]
                if not len(batch):
                    continue
                large = None
            held = pd.concat((held, batch), ignore_index=True) if len(held) else batch.reset_index(drop=True)
            edges = ends(held)
            if len(edges):
                yield from settle(held.iloc[: edges[-1]], edges[:-1])
                held = held.iloc[edges[-1] :].reset_index(drop=True)
            if len(held) > most:
                large = (held["table"].iloc[0], held["bucket"].iloc[0])
                yield passed(held)
                held = held.iloc[:0]
        if len(held):
            yield from settle(held, ends(held))

    return run


def candidate_groups(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(table, root, fingerprint) for distinct fingerprints (fingerprint): those of one (table, root) are candidates.

    Every two fingerprints within the radius share a (table, root).
    """
    spark = points.sparkSession
    masks = covering_masks(radius)
    rows = points.select("fingerprint", F.explode(F.array(*[F.lit(t) for t in range(len(masks))])).alias("table"))

    def pass_over(rows: DataFrame, masks: list[int], most: int) -> DataFrame:
        key = F.element_at(F.array(*[F.lit(signed(m)).cast("long") for m in masks]), F.col("table") + 1)
        rows = rows.select("table", F.col("fingerprint").bitwiseAND(key).alias("bucket"), "fingerprint")
        dealt = rows.repartition(shuffle_width(spark), "table", "bucket").sortWithinPartitions("table", "bucket", "fingerprint")
        return written(dealt.mapInPandas(_grouped(radius, most), "table int, root long, fingerprint long"), "covered")

    first = pass_over(rows, masks, HOT)
    hot = first.where("root is null")
    if hot.isEmpty():
        return first
    # Once more on the bits that the key leaves free: so few that no bucket of different fingerprints is large.
    deeper = [mask | sub for mask in masks for sub in covering_masks(radius, [b for b in range(64) if not mask >> b & 1])]
    again = hot.select("fingerprint", F.explode(F.transform(F.sequence(F.lit(0), F.lit(len(masks) - 1)), lambda k: F.col("table") * len(masks) + k)).alias("table"))
    second = pass_over(again, deeper, 1 << 62)
    return first.where("root is not null").union(second.select((F.col("table") + len(masks)).alias("table"), "root", "fingerprint"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = ALIKE) -> DataFrame:
    """(key, digest, class_id) per row: texts whose shingle sets are `threshold` alike or more link; class_id is the least key reachable.

    Equal texts are one node, so copies are never paired. Null and blank texts have
    no shingles and form one class. Null keys are ignored as class_id unless all
    keys of the class are null. digest is half of the text's SHA-256.
    """
    shipped(df.sparkSession)
    docs = df.select(F.col(key).alias("key"), _digest(text).alias("digest"), F.col(text).alias("text"))

    order = df.sparkSession.sparkContext.broadcast(_frequent(docs))
    names = ["n", *(f"f{k}" for k in range(PRINTS))]

    def prints(batches):
        often, times = order.value
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256].reset_index(drop=True)
                numbers, bits, firsts = [], [], []
                for t in part["text"]:  # one text's words at a time
                    words = words_of(t)
                    shingles = shingle_set(words)
                    numbers.append([len(shingles), *word_prints(words)])
                    bits.append(parities(shingles))
                    firsts.append(leading(shingles, threshold, often, times))
                yield pd.concat((part[["key", "digest"]], pd.DataFrame(numbers, columns=names, dtype=np.int64), pd.DataFrame({"bits": bits, "firsts": firsts})), axis=1)

    kind = df.schema[key].dataType.simpleString()
    shape = f"key {kind}, digest binary" + "".join(f", {c} long" for c in names) + ", bits array<long>, firsts array<long>"
    rows = written(docs.mapInPandas(prints, shape), "wordprints")
    attributes = [*names, "bits", "firsts"]
    unique = rows.groupBy("digest").agg(F.min("key").alias("key"), *[F.first(c).alias(c) for c in attributes])
    nodes = written(unique.withColumn("node", F.monotonically_increasing_id()), "neardocs")
    parts = []
    for k in range(PRINTS):
        points = nodes.select("node", F.col(f"f{k}").alias("fingerprint"))
        groups = candidate_groups(points.select("fingerprint").distinct())
        # Groups of one root are one bucket, whatever their tables: a node is in few of them.
        rooted = groups.select("root", "fingerprint").distinct()
        parts.append(rooted.join(points, "fingerprint").select(F.xxhash64(F.lit(k), "root").alias("bucket"), "node"))
        same = points.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
        parts.append(points.join(same, "fingerprint").select(F.xxhash64(F.lit(k), F.lit(-1), "fingerprint").alias("bucket"), "node"))
    firsts = nodes.select("node", "n", F.posexplode("firsts").alias("at", "h"))
    # Written, so that the join has plain exchanges on both sides and a hot shingle can be split.
    shared = written(firsts.groupBy("h").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("h"), "firsts")
    # If this is the first shingle that it shares with another text, it shares n - at of them at most, and that says how large the other's set can be.
    most = F.floor((F.col("n") - F.col("at")) * ((1 + threshold) / threshold) - F.col("n") + 1e-6).cast("long")
    sized = firsts.join(shared, "h", "left_semi").select("h", "node", "n", most.alias("most"))
    # A bucket holds the texts of one size class, and those that can be the larger one beside such a text.
    low, high = size_class(F.ceil(F.col("n") * threshold - 1e-6).cast("long")), size_class(F.least("n", "most"))
    spread = sized.where(F.col("most") >= F.col("n") * threshold - 1e-6).select("*", F.explode(F.sequence(low, high)).alias("cls"))
    led = written(spread.select(F.xxhash64(F.lit(PRINTS), "cls", "h").alias("bucket"), "node", "n", "most", ((F.col("cls") == size_class(F.col("n"))) & (F.col("most") >= F.col("n"))).alias("own")), "led")
    # Texts with one passage in common share many shingles: of buckets of the same nodes one is enough, with the widest claim of each.
    held = led.groupBy("bucket").agg(F.count(F.lit(1)).alias("many"), F.max("own").alias("any"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("many > 1 and any")
    held = written(held, "held")
    one = held.join(held.groupBy("many", "x", "y").agg(F.min("bucket").alias("one")), ["many", "x", "y"]).select("bucket", "one")
    widest = led.join(one, "bucket").groupBy(F.col("one").alias("bucket"), "node", "n").agg(F.max("most").alias("most"), F.max("own").alias("own"))
    blank = nodes.where("n = 0").select(F.xxhash64(F.lit(PRINTS)).alias("bucket"), "node", "n", F.lit(0).cast("long").alias("most"), F.lit(True).alias("own"))
    members = written(widest.union(blank), "nearmembers")
    hints = parts[0]
    for part in parts[1:]:
        hints = hints.union(part)
    hints = written(hints, "nearhints")

    def plausible(a: str, b: str) -> Column:
        # Of two such sets at most this share of their sizes together stands in one alone.
        most = (F.col(f"{a}n") + F.col(f"{b}n")) * F.lit((1 - threshold) / (1 + threshold)) + F.lit(1e-6)
        # The sizes are near each other here (see similarity), so one folding makes the lengths equal; where not, the pair stays.
        return F.coalesce(_differing(F.col(f"{a}bits"), F.col(f"{b}bits")) <= most, F.lit(True))

    def sets(want: DataFrame) -> DataFrame:
        asked = _small(checkpointed(nodes.join(want, "node", "left_semi").select(F.col("key").alias("__key"), F.col("digest").alias("__digest"), "node")))
        found = docs.join(asked, F.col("key").eqNullSafe(F.col("__key")) & (F.col("digest") == F.col("__digest"))).select("node", "text")

        def run(batches):
            for batch in batches:
                yield pd.DataFrame({"node": batch["node"], "set": [shingle_set(words_of(t)) for t in batch["text"]]})

        return written(found.mapInPandas(run, "node long, `set` array<long>").dropDuplicates(["node"]), "nearsets")

    groups = linked(members, nodes.select("node", "n", "bits"), threshold, sets, plausible, hints)
    classes = nodes.select("node", "digest", "key").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = classes.groupBy("component").agg(F.min("key").alias("class_id"))
    return rows.select("key", "digest").join(classes.join(least, "component").select("digest", "class_id"), "digest").select(F.col("key").alias(key), "digest", "class_id")


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = ALIKE) -> DataFrame:
    """df without the rows that have a near duplicate of a smaller key; other columns stay.

    Rows that repeat both key and text are one document and stay or go together.
    """
    at = [F.col(key), _digest(text)]
    with scratch(df.sparkSession) as keep:
        classes = near_duplicates(df, key, text, threshold)
        gone = keep(written(classes.where(~F.col(key).eqNullSafe(F.col("class_id"))).select(F.col(key).alias("__key"), F.col("digest").alias("__digest")).distinct(), "neargone"))
        held = keep(sieve(gone, "__key", "__digest"))
    some, stay = sifted(df, held, *at)
    return some.join(gone.hint("merge"), at[0].eqNullSafe(F.col("__key")) & (at[1] == F.col("__digest")), "left_anti").unionByName(stay)
