import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import sharding as S


def check(rows, texts):
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows if r["doc_id"] is not None) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts if i is not None)
    slots = {}
    for r in rows:
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], S.SHARDS) and 0 <= r["shard"] < S.SHARDS
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_documents(spark):
    d = "/root/testdata/sf0.1"
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    rows = S.op5_sharding(spark, d).collect()
    check(rows, texts)
    held = Counter(r["shard"] for r in rows)
    assert max(held.values()) < 1.25 * len(rows) / S.SHARDS and min(held.values()) > 0.75 * len(rows) / S.SHARDS
    moved = sum(r["grown_shard"] == S.SHARDS for r in rows)
    assert 0.7 * len(rows) / 17 < moved < 1.3 * len(rows) / 17


def test_awkward(spark, tmp_path, awkward, nothing):
    awkward.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    check(S.op5_sharding(spark, str(tmp_path / "a")).collect(), [(r["doc_id"], r["text"]) for r in awkward.collect()])
    nothing.write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert S.op5_sharding(spark, str(tmp_path / "b")).count() == 0
    assert S.shard(awkward, "doc_id", [1.0, 2.0]).columns == awkward.columns  # "shard" is replaced


def test_weights(spark):
    df = S.shard(spark.range(20000), "id", [1.0, 3.0, 0.0])
    held = {r["shard"]: r["count"] for r in df.groupBy("shard").count().collect()}
    assert set(held) == {0, 1} and 2.8 < held[1] / held[0] < 3.2
    before = S.rendezvous(F.col("id"), [1.0, 3.0, 0.0])
    after = S.rendezvous(F.col("id"), [1.0, 3.0, 2.0])
    assert spark.range(5000).where((before != after) & (after != 2)).count() == 0
    with pytest.raises(ValueError):
        S.rendezvous(F.col("id"), [0.0])
