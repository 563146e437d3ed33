import math
import random
import string
import zlib
from collections import Counter

from tessera.llm import langid as L

D = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    got = L.op2_language_id(spark, D).collect()
    assert {r["doc_id"] for r in got} == set(labels) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 200 and sum(r["lang_pred"] == labels[r["doc_id"]] for r in held) / len(held) > 0.98
    assert not any(r["rejected"] for r in got) and all(0 <= r["score"] <= 1 for r in got)


def test_rejects_what_is_far(spark):
    model = L.fit(spark.read.parquet(f"{D}/documents.parquet"))
    assert len(model.languages) == 4 * L.CENTROIDS
    assert model.predict(["日本語の文章です。これは遠い。", "12 34 !!", None, ""])[2].all()


def test_rejects_other_languages_and_gibberish(spark):
    rng = random.Random(1)
    model = L.fit(spark.read.parquet(f"{D}/documents.parquet"))
    finnish = "Tämä on suomenkielinen teksti, jonka ei pitäisi kuulua mihinkään opituista kielistä, koska suomi on erilainen kieli."
    polish = "To jest polski tekst, który nie powinien pasować do żadnego z języków, ponieważ jest napisany po polsku."
    letters = ["".join(rng.choice(string.ascii_lowercase) for _ in range(n)) for n in (200, 400, 3000)]
    keys = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n)) for n in (800, 3000)]
    assert model.predict([finnish, polish, *letters, *keys])[2].all()


def test_keeps_clean_passages_of_any_size(spark):
    docs = [(r["text"], r["lang"]) for r in spark.read.parquet(f"{D}/documents.parquet").where("n_chars > 400").limit(200).collect()]
    model = L.fit(spark.read.parquet(f"{D}/documents.parquet"))
    for n in (30, 100, 300):
        _, _, rejected = model.predict([t[n : 2 * n] for t, _ in docs])
        assert rejected.mean() < 0.03


def test_repeated_rows_teach_once_and_are_never_all_missed(spark):
    other = [(900, "le petit chat dort bien sur la chaise", "fr")]
    for key in (72, 76):
        df = spark.createDataFrame([(key, "the small cat sleeps well on the chair", "en")] * 5000 + other, "doc_id long, text string, lang string")
        model = L.fit(df)
        assert model.languages == ["en", "fr"]
        assert model.predict(["the cat sleeps", "le chat dort"])[0] == ["en", "fr"]
    many = spark.createDataFrame([(1, f"text number {i} of a single key", "en") for i in range(3000)], "doc_id long, text string, lang string")
    assert len(L.fit(many, per_language=50).languages) == L.CENTROIDS


def test_against_a_plain_classifier(spark):
    """The operator's predictions against nearest centroids computed apart, from the definition, on the same model."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = L.fit(df)
    shown = {r["doc_id"]: r for r in L.identify(df, model).collect()}
    for r in df.collect():
        text = "".join(c if c.isalpha() else " " for c in r["text"].lower())
        grams = Counter()
        padded = "\0" + "\0".join(text.split()) + "\0" if text.split() else ""
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                h = 0
                for c in padded[i : i + n]:
                    h = (h ^ (0 if c == "\0" else ord(c))) * 0x9E3779B1 & 0xFFFFFFFF
                    h ^= h >> 15
                grams[h % L.SLOTS] += 1
        weight = {k: (1 + math.log(v)) * float(model.idf[k]) for k, v in grams.items()}
        norm = math.sqrt(sum(w * w for w in weight.values())) or 1
        cosine = [sum(w * float(c[k]) for k, w in weight.items()) / norm for c in model.centroids]
        best = max(range(len(cosine)), key=cosine.__getitem__)
        got = shown[r["doc_id"]]
        assert abs(got["score"] - max(0, min(1, cosine[best]))) < 1e-3  # single precision
        assert got["lang_pred"] == model.languages[best] or sorted(cosine)[-1] - sorted(cosine)[-2] < 1e-5


def test_awkward(spark, awkward):
    out = L.identify(awkward, L.fit(awkward))
    rows = out.collect()
    assert len(rows) == awkward.count() and set(awkward.columns) <= set(out.columns)
    assert all((r["lang_pred"] == L.UNKNOWN) == (not r["text"] or not any(c.isalpha() for c in r["text"])) for r in rows)


def test_nothing(spark, nothing):
    model = L.fit(nothing)
    assert not model.languages and L.identify(nothing, model).count() == 0
    assert model.predict(["any text"])[0] == [L.UNKNOWN]


def test_blocks_change_nothing(monkeypatch):
    text = "Ünder the sea " * 50
    whole = L.counts([text])
    monkeypatch.setattr(L, "BLOCK", 17)
    assert (L.counts([text]) == whole).all()
