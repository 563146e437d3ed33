import hashlib
import re

from tessera.llm import line_dedup as L


def brute(rows):
    """Straight from the definition; repeated (key, text) rows are one document."""
    docs = {}
    for i, t in rows:
        t = t or ""
        lines = t.split("\n")
        at = [k for k, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
        docs[(i is not None, i or 0, hashlib.sha256(t.encode()).digest()[:16])] = (t, lines, at)
    seen, out = set(), {}
    for place, (t, lines, at) in sorted(docs.items()):
        gone = set()
        for s in range(len(at)):
            for size in (1, 2):  # two lines, or one of 50 words
                run = tuple(lines[k] for k in at[s : s + size])
                if len(run) < size or size == 1 and len(re.findall(r"[^\x20\x09-\x0D]+", run[0])) < 50:
                    continue
                if run in seen:
                    gone.update(at[s : s + size])
                seen.add(run)
        kept = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        out[(place[1] if place[0] else None, t)] = (len(lines), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept, bool(gone))
    return out


def check(spark, tmp_path, df):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = brute(rows)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in L.op9_line_dedup(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(((i, *want[(i, t or "")][:3]) for i, t in rows), key=str)
    left = sorted(((r["doc_id"], r["text"]) for r in L.drop_repeated_lines(df).collect()), key=str)
    assert left == sorted(((i, t if not (w := want[(i, t or "")])[4] else w[3]) for i, t in rows if not (w := want[(i, t or "")])[4] or w[3].strip(" \t\n\r\x0b\x0c")), key=str)


def test_awkward(spark, tmp_path, awkward):
    check(spark, tmp_path, awkward)
    assert L.drop_repeated_lines(awkward).columns == awkward.columns


def test_nothing(spark, tmp_path, nothing):
    check(spark, tmp_path, nothing)


def test_documents(spark, tmp_path):
    check(spark, tmp_path, spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))


def test_a_run_inside_one_document(spark, tmp_path):
    check(spark, tmp_path, spark.createDataFrame([(1, "a\na\na\n\nb\na\na"), (2, "b\na")], "doc_id long, text string"))


def test_long_lines_repeat_alone(spark, tmp_path):
    line = lambda n, w="word": " ".join(f"{w}{i}" for i in range(n))
    rows = [(1, f"a\n{line(50)}\nb"), (2, f"c\n{line(50)}\nd"), (3, line(50)), (4, line(49)), (5, line(49)), (6, f"x\n{line(49)}\ny"), (7, line(3000)), (8, line(3000) + "\n\n" + line(3000))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(spark, tmp_path, df)
    assert {r["doc_id"]: r["n_removed"] for r in L.op9_line_dedup(spark, str(tmp_path)).collect()} == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0, 7: 0, 8: 2}


def test_one_passage_in_every_document(spark, tmp_path):
    check(spark, tmp_path, spark.createDataFrame([(i, f"{i}\nsame line\nand the next\n{i % 7}\nsame line") for i in range(3000)], "doc_id long, text string"))
