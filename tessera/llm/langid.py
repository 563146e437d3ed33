"""Language identification by nearest centroid over TF-IDF character n-grams.

Letters are lower-cased, everything else counts as a gap. Counts of n-grams of
1 to 3 letters, hashed to SLOTS, become 1 + ln(count), times the inverse
document frequency, at length one. Each language has several centroids, from
spherical k-means over its own texts; a text takes the language of the centroid
of largest cosine, and is rejected if it is much farther from it than texts of
its size that were learned from: a short text is far from everything, so the cut
is taken for each size by itself, from the texts and from passages of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

from tessera.llm.common import documents, scratch, shipped, written

SLOTS = 1 << 13
#: Texts learned from, at most so many a language: those of least hash of their key.
SAMPLE = 300
CENTROIDS = 4
#: A text is rejected below so many times the cosine that LOW of the learned texts and passages of its size don't reach.
SLACK, LOW = 0.6, 0.02
#: But no cut is above this: a text that repeats one word is far from its own language, too.
TOP = 0.35
#: Letters of the passages that the cuts of smaller sizes come from.
PASSAGES = (4, 8, 16, 32, 64, 128, 256, 512, 1024)
#: Sizes are told apart by the power of two of the n-grams.
SIZES = 40
UNKNOWN = "und"
#: Code points that are counted at once.
BLOCK = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def codes(text: str) -> np.ndarray:
    """Letters' code points, with one 0 for each gap and at both ends; empty if there is no letter."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[x]
    if not letter.any():
        return x[:0]
    x = np.where(letter, x, 0)
    x = x[letter | np.concatenate(([False], letter[:-1]))]
    return np.concatenate(([0], x, [0][: int(x[-1] > 0)])).astype(np.uint32)


def counts(texts: list[str | None]) -> np.ndarray:
    """A row of SLOTS n-gram counts for each text; null counts as empty."""
    out = np.zeros((len(texts), SLOTS), np.float32)
    for row, text in enumerate(texts):
        x = codes(text) if text else ()
        for at in range(0, len(x), BLOCK):
            a = x[at : at + BLOCK + 2]
            for n in (1, 2, 3):
                h = np.zeros(max(0, min(len(a) - n + 1, BLOCK)), np.uint32)
                for k in range(n):
                    h = (h ^ a[k : k + len(h)]) * np.uint32(0x9E3779B1)
                    h ^= h >> np.uint32(15)
                out[row] += np.bincount(h % np.uint32(SLOTS), minlength=SLOTS)
    return out


def sizes(counted: np.ndarray) -> np.ndarray:
    """The power of two of the n-grams in each row of counts."""
    return np.log2(np.maximum(counted.sum(axis=1), 1)).astype(np.int64).clip(0, SIZES - 1)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


@dataclass
class Model:
    languages: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray
    least: np.ndarray  # cosine under which a text is rejected, by centroid and size

    def vectors(self, counted: np.ndarray) -> np.ndarray:
        """Turns counts into unit vectors, in place."""
        some = counted > 0
        np.log(counted, out=counted, where=some)
        np.add(counted, 1, out=counted, where=some)
        counted *= self.idf
        norm = np.sqrt(np.einsum("ij,ij->i", counted, counted))
        counted /= np.where(norm > 0, norm, 1)[:, None]
        return counted

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, cosine, rejected) of each text; UNKNOWN, 0, true without letters (or without a model)."""
        languages, scores, rejected = [], np.zeros(len(texts)), np.ones(len(texts), bool)
        for at in range(0, len(texts), 256):
            counted = counts(texts[at : at + 256])
            some, size = counted.any(axis=1), sizes(counted)
            if not len(self.languages):
                languages += [UNKNOWN] * len(some)
                continue
            cosine = self.vectors(counted) @ self.centroids.T
            best = cosine.argmax(axis=1)
            score = np.clip(cosine[np.arange(len(best)), best].astype(float), 0, 1)
            languages += [self.languages[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)]
            scores[at : at + 256] = np.where(some, score, 0)
            rejected[at : at + 256] = ~some | (score < self.least[best, size])
        return languages, scores, rejected


def clustered(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means of unit rows; starts from the mean and then the rows least like the centroids so far."""
    centres = _unit(x.mean(axis=0, keepdims=True))
    while len(centres) < min(k, len(x)):
        far = (x @ centres.T).max(axis=1).argmin()
        centres = np.concatenate((centres, x[far : far + 1]))
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        centres = _unit(np.stack([x[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))]))
    return centres


def fit_rows(labels: list[str], counted: np.ndarray) -> Model:
    """A model without cuts from labelled counts, which are overwritten."""
    idf = (np.log((1 + len(labels)) / (1 + (counted > 0).sum(axis=0))) + 1).astype(np.float32)
    model = Model([], idf, np.zeros((0, SLOTS), np.float32), np.zeros((0, SIZES)))
    if not len(labels):
        return model
    x, names = model.vectors(counted), np.array(labels, object)
    centres = []
    for language in sorted(set(labels)):
        c = clustered(x[names == language], CENTROIDS)
        centres.append(c)
        model.languages += [language] * len(c)
    model.centroids = np.concatenate(centres).astype(np.float32)
    model.least = np.zeros((len(model.languages), SIZES))
    return model


def passages(text: str) -> list[str]:
    """The text and its beginnings of PASSAGES letters."""
    letters = list(islice((i for i, c in enumerate(text) if c.isalpha()), PASSAGES[-1]))
    return [text, *(text[: letters[n - 1] + 1] for n in PASSAGES if n <= len(letters))]


def cut(model: Model, near: pd.DataFrame) -> Model:
    """The model with its cuts, from near (lang, size, cosine): texts and passages against the centroids of their language."""
    for k, language in enumerate(model.languages):
        own = near[near["lang"] == language]
        by = [own["cosine"][own["size"] == size] for size in range(SIZES)]
        model.least[k] = np.maximum.accumulate([min(TOP, SLACK * float(np.quantile(x, LOW))) if len(x) else 0.0 for x in by])  # more text is never farther
    return model


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", learn: Column | None = None, per_language: int = SAMPLE) -> Model:
    """A model from the labelled rows of df (those where `learn` holds), per_language texts of each language at most.

    Rows with null key, text or label and texts without letters teach nothing.
    Which rows are taken depends on their keys and texts alone; rows that repeat
    both teach once. An empty table gives a model that knows no language.
    """
    shipped(df.sparkSession)
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull() & F.col(lang).isNotNull())
    if learn is not None:
        rows = rows.where(learn)
    place = F.shiftrightunsigned(F.xxhash64(key, text), 11) / F.lit(float(1 << 53))
    placed = rows.select(F.col(lang).alias("__lang"), place.alias("__place"))
    # Hashes under a bound that twice as many different rows as needed are expected to meet: only those are ranked.
    found = placed.groupBy("__lang").agg(F.approx_count_distinct("__place", 0.02).alias("__rows"))  # a row for each language
    drawn = placed.join(F.broadcast(found), "__lang").where(F.col("__place") * F.col("__rows") < 2.0 * per_language).select("__lang", "__place").distinct()
    nth = F.row_number().over(Window.partitionBy("__lang").orderBy("__place"))
    taken = drawn.withColumn("__nth", nth).where(F.col("__nth") <= per_language).select("__lang", "__place")  # per_language rows a language
    met = rows.select(F.col(lang).alias("__lang"), F.col(text).alias("__text"), place.alias("__place")).join(F.broadcast(taken), ["__lang", "__place"])

    def vectors(batches):
        for batch in batches:
            for language, body in zip(batch["__lang"], batch["__text"], strict=True):
                counted = counts([body])[0]
                slots = np.flatnonzero(counted).astype("<u2")
                yield pd.DataFrame({"lang": [language], "slots": [slots.tobytes()], "counts": [counted[slots].astype("<f4").tobytes()]})

    with scratch(df.sparkSession):
        sample = written(met.groupBy("__lang", "__place").agg(F.min("__text").alias("__text")), "learned")
        # At most per_language rows a language, each of at most 6 bytes a slot.
        got = sample.mapInPandas(vectors, "lang string, slots binary, counts binary").where(F.octet_length("slots") > 0).orderBy("lang", "slots", "counts").collect()
        counted = np.zeros((len(got), SLOTS), np.float32)
        for row, r in enumerate(got):
            counted[row, np.frombuffer(r["slots"], "<u2")] = np.frombuffer(r["counts"], "<f4")
        model = fit_rows([r["lang"] for r in got], counted)
        del got, counted
        shared = df.sparkSession.sparkContext.broadcast(model)

        def nearness(batches):
            own = np.array(shared.value.languages, object)
            for batch in batches:
                for language, body in zip(batch["__lang"], batch["__text"], strict=True):
                    counted = counts(passages(body))
                    size, x = sizes(counted), shared.value.vectors(counted)
                    yield pd.DataFrame({"lang": language, "size": size, "cosine": (x @ shared.value.centroids[own == language].T).max(axis=1, initial=0).astype(float)})

        # At most 1 + len(PASSAGES) small rows for each of these texts.
        return cut(model, sample.mapInPandas(nearness, "lang string, size long, cosine double").toPandas())


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df's rows with lang_pred, score and rejected (which replace columns of these names).

    Null texts and texts without letters: UNKNOWN, score 0, rejected. Every row
    and every other column stays as it is.
    """
    shipped(df.sparkSession)
    keep = [c for c in df.columns if c not in ("lang_pred", "score", "rejected")]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            languages, scores, rejected = shared.value.predict(batch.column("__text").to_pylist())
            columns = [batch.column(c) for c in keep] + [pa.array(languages, pa.string()), pa.array(scores), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "lang_pred", "score", "rejected"])

    schema = StructType([df.schema[c] for c in keep]).add("lang_pred", StringType()).add("score", DoubleType()).add("rejected", BooleanType())
    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def held_out(key: str) -> Column:
    """True for the third of keys that nothing is learned from; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score and rejected; see fit() and identify().

    Rows that repeat doc_id or text are predicted each. Ties between centroids go
    to the first. Null doc_ids are not held out and teach nothing.
    """
    docs = documents(spark, sf_dir)
    model = fit(docs, learn=~held_out("doc_id"))
    shown = identify(docs.select("doc_id", "text"), model).drop("text")
    return shown.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")
