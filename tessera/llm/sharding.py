"""Sharding: rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair gets a pseudo-random number u in (0, 1); the record goes
to the shard with the least -ln(u) / weight. A shard's numbers don't depend on
the other shards, so a new shard only takes rows to itself and a removed one
only gives its own rows away; the share of a shard is its weight over the sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, gapless_rank

SHARDS = 16


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Shard of each key: an int from 0 to len(weights) - 1.

    A shard of weight 0 gets nothing. All null keys share one shard. At least one
    weight must be positive. Shard i keeps its rows when shards are appended.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be non-negative, at least one positive")
    cost = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            bits = F.shiftrightunsigned(F.xxhash64(F.lit(f"shard-{shard}"), key), 11)
            u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
            cost.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("cost"), F.lit(shard).alias("shard")))
    return F.array_min(F.array(*cost))["shard"]


def shard(df: DataFrame, key: str, weights: list[float], name: str = "shard") -> DataFrame:
    """df with an int column `name`, the rendezvous shard of column `key`.

    Any other column is kept as it is; a column called `name` is replaced. An
    empty table stays empty.
    """
    return df.withColumn(name, rendezvous(F.col(key), weights))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 equal shards under the law `key`: doc_id and the shard count decide.

    Null text: size 1, text_crc32 0. Repeated rows get slots of their own. Null
    doc_id: all in one shard.
    """
    text = F.coalesce("text", F.lit(""))
    rows = documents(spark, sf_dir).select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = shard(shard(rows, "doc_id", [1.0] * SHARDS), "doc_id", [1.0] * (SHARDS + 1), "grown_shard")
    ranked = gapless_rank(rows, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
