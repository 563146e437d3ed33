"""Each stage of the pipeline against a brute-force version, on what the stage before it kept."""

import test_line_dedup
import test_near_dedup

import corpus_pipeline as P
from tessera.llm import suffix_dedup as S

D = "/root/testdata/sf0.001"


def bytes_left(rows):
    """doc_id -> text without the bytes of 50-byte strings that a smaller doc_id has."""
    least = {}
    for i, t in rows:
        b = t.encode()
        for p in range(len(b) - S.LENGTH + 1):
            w = b[p : p + S.LENGTH]
            least[w] = min(least.get(w, i), i)
    out = {}
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - S.LENGTH + 1):
            if least[b[p : p + S.LENGTH]] < i:
                gone[p : p + S.LENGTH] = b"\1" * S.LENGTH
        kept = bytes(x for x, g in zip(b, gone) if not g)
        if kept or not any(gone):
            out[i] = kept.decode("utf-8", "ignore")
    return {i: t for i, t in out.items() if t}


def test_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    assert [name for name, _ in P.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    for name, stage in P.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        stage(spark, docs, D).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "best_fit_packing":
            break
        rows = docs.collect()
        after = {r["doc_id"]: r["text"] for r in rows}
        assert len(rows) == len(after) and all(r["n_chars"] == len(r["text"]) for r in rows)
        if name == "language_id":
            assert after == dict(before)  # all of these documents are in a language
        elif name == "line_dedup":
            want = test_line_dedup.brute(before)
            assert after == {i: (w[3] if w[4] else t) for i, t in before if not (w := want[(i, t)])[4] or w[3].strip()}
        elif name == "simhash_near_dedup":
            classes = test_near_dedup.brute(before)
            want = {i: t for k, (i, t) in enumerate(before) if classes[k] == i}
            assert set(want) <= set(after) and len(after) <= len(want) + 2  # candidates may miss a pair that is just alike enough
            assert all(after[i] == dict(before)[i] for i in after)
        elif name == "suffix_array_dedup":
            assert after == bytes_left(before)
    packed = docs.collect()
    assert {r["doc_id"] for r in packed} == {i for i, _ in before}
    held = {}
    for r in packed:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    total = 0
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
        total += at
    assert len(held) <= -(-total // 2048) + 1


def test_run_is_the_last_stage_s_table(spark):
    out = P.run(spark, D)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


def test_two_results_can_be_held_at_once(spark, tmp_path):
    spark.read.parquet(f"{D}/documents.parquet").where("doc_id < 40").write.parquet(str(tmp_path / "documents.parquet"))
    one, two = P.run(spark, str(tmp_path)), P.run(spark, str(tmp_path))
    rows = lambda df: sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in df.collect())
    assert rows(one) == rows(two) != []
