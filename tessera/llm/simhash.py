"""SimHash near-deduplication on covering locality-sensitive hashing.

Every bit of a 64-bit fingerprint gets a vector of radius + 1 bits. For each
non-zero vector v, one table keys the fingerprints on those bits whose vector
has odd overlap with v. Two fingerprints that differ in at most `radius` bits
agree on all key bits of at least one table, as radius vectors cannot span
radius + 1 dimensions: no pair within the radius is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, documents, shuffle_width, written
from tessera.llm.components import components

SEED, SHINGLE, RADIUS = 42, 3, 3
#: Buckets beyond this many different fingerprints are keyed once more on their free bits.
HOT = 1 << 15
#: Shingles hashed at once: a very long text takes no more memory than this needs.
BLOCK = 1 << 16


def covering_masks(radius: int, bits: list[int] | None = None) -> list[int]:
    """Key masks, 2 ** (radius + 1) - 1 of them, over the given bit positions (all 64 by default)."""
    last = (1 << (radius + 1)) - 1
    masks = []
    for v in range(1, last + 1):
        masks.append(sum(1 << b for i, b in enumerate(range(64) if bits is None else bits) if bin((i % last + 1) & v).count("1") % 2))
    return masks


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hashes(words: list[bytes], n: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of the n-word shingles in blocks; the whole sequence if it has fewer words; nothing without words."""
    if words and len(words) < n:
        n = len(words)
    for at in range(0, len(words) - n + 1 if words else 0, BLOCK):
        part = words[at : at + BLOCK + n - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: len(part) - n + 1].tolist()
        cuts = map(joined.__getitem__, map(slice, starts, (ends[n - 1 :] - 1).tolist()))
        yield np.fromiter(map(xxhash.xxh64_intdigest, cuts, repeat(seed)), np.uint64, len(starts))


def majority(blocks: Iterator[np.ndarray]) -> int:
    """The fingerprint: bit k is set if set in over half of all hashes; zero without hashes."""
    count, total = np.zeros(64, np.int64), 0
    for h in blocks:
        count += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        total += len(h)
    return int(np.packbits(2 * count > total).view(">u8")[0]) if total else 0


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(key, fingerprint long) per row, of the whole text. Null and blank texts get fingerprint zero."""

    def run(batches):
        for batch in batches:
            prints = [signed(majority(hashes(words_of(t), n, seed))) for t in batch["__text"]]
            yield pd.DataFrame({key: batch[key], "fingerprint": np.array(prints, np.int64)})

    rows = df.select(F.col(key), F.col(text).alias("__text"))
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, fingerprint long"
    return rows.mapInPandas(run, schema)


def _bucket(df: DataFrame, masks: list[int]) -> Column:
    return F.col("fingerprint").bitwiseAND(F.element_at(F.array(*[F.lit(signed(m)).cast("long") for m in masks]), F.col("table") + 1))


def bucketed(points: DataFrame, radius: int) -> DataFrame:
    """points (fingerprint, ...) once for each table, as (table, bucket, ...).

    A bucket of over HOT rows is dealt into the tables of a second covering, over
    the bits that its key leaves free. Those are so few (about 16) that no
    bucket of different fingerprints is large thereafter.
    """
    masks = covering_masks(radius)
    rows = points.withColumn("table", F.explode(F.array(*[F.lit(t) for t in range(len(masks))])))
    rows = rows.withColumn("bucket", _bucket(rows, masks))
    hot = checkpointed(rows.groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("table", "bucket"))
    if hot.isEmpty():
        return rows
    deeper = [mask | sub for mask in masks for sub in covering_masks(radius, [b for b in range(64) if not mask >> b & 1])]
    split = rows.join(F.broadcast(hot) if hot.count() < 10_000 else hot, ["table", "bucket"], "left_semi")
    split = split.withColumn("table", F.explode(F.transform(F.sequence(F.lit(0), F.lit(len(masks) - 1)), lambda k: F.col("table") * len(masks) + k)))
    split = split.withColumn("bucket", _bucket(split, deeper)).withColumn("table", (F.col("table") + len(masks)).cast("int"))
    return rows.join(hot, ["table", "bucket"], "left_anti").unionByName(split.select(rows.columns))


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[list[np.ndarray]]:
    """Whole buckets of two rows or more, from batches sorted by (table, bucket): [fingerprint, other columns ...]."""
    held: pd.DataFrame | None = None

    def cut(frame, upto):
        t, b = frame["table"].to_numpy(), frame["bucket"].to_numpy()
        edge = np.flatnonzero((t[1:] != t[:-1]) | (b[1:] != b[:-1])) + 1
        starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(t)]))
        last = len(starts) - 1 if upto else len(starts)
        rest = [frame[c].to_numpy() for c in frame.columns if c not in ("table", "bucket")]
        return [[c[s:e] for c in rest] for s, e in zip(starts[:last], ends[:last], strict=True) if e - s > 1], frame.iloc[starts[-1] :]

    parts: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        parts.append(batch)
        first = parts[0]
        if (first["table"].iloc[0], first["bucket"].iloc[0]) == (batch["table"].iloc[-1], batch["bucket"].iloc[-1]):
            continue  # the same bucket goes on
        groups, held = cut(pd.concat(parts, ignore_index=True), True)
        yield from groups
        parts = [held]
    if parts:
        yield from cut(pd.concat(parts, ignore_index=True), False)[0]


def forest(points: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links that join what is linked at `radius` or fewer differing bits: fewer links than points."""
    if len(points) == 2:
        if int(points[0] ^ points[1]).bit_count() <= radius:
            yield 0, 1
        return
    left = np.arange(len(points))
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = np.bitwise_count(points[left] ^ points[at]) <= radius
            found = left[near]
            yield from ((at, x) for x in found)
            todo.extend(found)
            left = left[~near]


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that join the different fingerprints of `prints` exactly as all pairs within the radius would."""

    def run(batches):
        for group in _runs(batches):
            points = group[0].astype(np.uint64)
            if found := list(forest(points, radius)):
                at = np.array(found)
                yield pd.DataFrame({"a": group[0][at[:, 0]], "b": group[0][at[:, 1]]})

    rows = bucketed(prints.select("fingerprint").distinct(), radius).select("table", "bucket", "fingerprint")
    width = shuffle_width(prints.sparkSession)
    dealt = rows.repartition(width, "table", "bucket").sortWithinPartitions("table", "bucket", "fingerprint")
    return dealt.mapInPandas(run, "a long, b long").distinct()


def simhash_groups(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of df; other columns are not read.

    Fingerprints link at `radius` or fewer differing bits; component_id is the
    least key that is reachable, the row's own included. Null and blank texts
    have fingerprint zero and are linked like any other. Null keys are ignored
    as component_id unless all keys of the component are null.
    """
    prints = written(fingerprints(df, key, text, n).withColumnRenamed(key, "doc_id"), "simhash")
    low = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("low"))
    joined = components(links(prints, radius))
    rooted = low.join(joined, low["fingerprint"] == joined["node"], "left").select("fingerprint", "low", F.coalesce("component", "fingerprint").alias("root"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return prints.join(rooted.join(least, "root").select("fingerprint", "component_id"), "fingerprint").select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir))
