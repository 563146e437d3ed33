import hashlib

import regex
import xxhash
from pyspark.sql import functions as F

from tessera.llm import spotsigs as S

D = "/root/testdata/sf0.001"


def xx(*parts):
    h = 42
    for p in parts:
        if p is not None:
            data = p.encode() if isinstance(p, str) else (p & ((1 << 64) - 1)).to_bytes(8, "little")
            h = xxhash.xxh64_intdigest(data, h)
    return h - (1 << 64) if h >> 63 else h


def brute(text):
    words = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
    tokens, anchor = [], None
    for w in words:
        if w in S.COMMON:
            anchor = w
        else:
            tokens.append((anchor, w))
            anchor = None
    if anchor is not None:
        tokens.append((anchor, ""))
    h = [xx(w) for _, w in tokens]
    out = set()
    for i, (a, _) in enumerate(tokens):
        if a is not None or i == 0 or h[i] % S.SPARSE == 0:
            out.add(xx(a or "", *[h[k] if k < len(h) else None for k in range(i, i + S.CHAIN)]))
    return out


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check(spark, folder, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        share = len(t) // 4
        edited = t[: len(t) - share] + nxt[:share]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(alike(brute(t), brute(edited)), 9), round(alike(brute(t), brute(nxt)), 9)))
    got = S.op3_spotsigs(spark, folder).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got), key=str) == sorted(want, key=str)
    prints = {}
    for r in got:
        prints.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    return got


def test_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    got = {r["doc_id"]: r["fingerprint"] for r in check(spark, D, rows)}
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t, set()).add(got[i])
    assert all(len(x) == 1 for x in by_text.values())
    assert sum(len(x) for x in by_text.values()) > 0.95 * len(by_text)


def test_awkward(spark, tmp_path, awkward):
    runs = spark.createDataFrame([(900, "Of the " * 40000), (901, "of " * 9 + "kiwi")], "doc_id long, text string")
    df = awkward.select("doc_id", "text").union(runs)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    check(spark, str(tmp_path), [(r["doc_id"], r["text"]) for r in df.collect()])


def test_nothing(spark, tmp_path, nothing):
    nothing.write.parquet(str(tmp_path / "documents.parquet"))
    assert S.op3_spotsigs(spark, str(tmp_path)).collect() == []
    assert S.near_duplicates(nothing).collect() == []


def test_near_duplicates_lose_no_link(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 500")
    rows = {r["doc_id"]: frozenset(brute(r["text"])) for r in docs.collect()}
    parent = {i: i for i in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(rows)
    for a in ids:
        for b in ids:
            if a < b and alike(rows[a], rows[b]) >= 0.8:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["class_id"] for r in S.near_duplicates(docs).collect()}
    assert got == {i: find(i) for i in ids} and len(set(got.values())) < len(ids)


def test_plan_is_native(spark):
    plan = S.op3_spotsigs(spark, D)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan


def test_length_classes():
    import math

    cls = lambda n: math.floor(math.log(n) / -math.log(0.8) + 1e-9)
    assert all(abs(cls(a) - cls(b)) <= 1 for a in range(1, 400) for b in range(a, int(a / 0.8) + 1))
