import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import exact_dedup as X


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), n in zip(rows, norm):
        groups.setdefault(n, []).append(i)
    out = []
    for (i, _), n in zip(rows, norm):
        keep = min((k for k in groups[n] if k is not None), default=None)
        out.append((i, keep, len(groups[n]), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, df):
    return sorted((tuple(r) for r in X.exact_groups(df).collect()), key=str)


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert run(spark, df) == brute([(r["doc_id"], r["text"]) for r in df.collect()])


def test_awkward(spark, awkward, nothing):
    more = spark.createDataFrame([(50, "a \t b"), (51, "a\nb"), (52, "a\x0c\x0bb"), (53, "a b "), (54, " a b"), (55, "a b")], "doc_id long, text string")
    df = awkward.select("doc_id", "text").union(more)
    assert run(spark, df) == brute([(r["doc_id"], r["text"]) for r in df.collect()])
    assert run(spark, awkward) and run(spark, nothing) == []


def test_digests_that_collide_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(X, "_hash", lambda chunk: F.unhex(F.substring(F.sha2(chunk, 256), 1, 1)))
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    df = df.union(spark.createDataFrame([(None, None), (7000, ""), (7001, "x"), (7001, "x")], "doc_id long, text string"))
    assert run(spark, df) == brute([(r["doc_id"], r["text"]) for r in df.collect()])


@pytest.mark.parametrize("text", ["", "a", "word " * 5000, "x" * 10000, "k " * 4000])
def test_chunks_make_up_the_text(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(X.chunks(F.col("t"))).first()[0]
    assert "".join(got) == text and all(0 < len(c) <= X.MOST for c in got)


def test_an_insertion_changes_few_chunks(spark):
    words = [f"w{k * 7919 % 1009}{'dkmwz'[k % 5] if k % 11 == 0 else 'a'}" for k in range(4000)]
    texts = [" ".join(words), " ".join([*words[:50], "inserted", *words[50:]])]
    a, b = (set(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.chunks(F.col("t"))).collect())
    assert len(a & b) > 0.9 * len(a)


def test_plan_is_native(spark):
    plan = X.op6_exact_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan
