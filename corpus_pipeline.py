"""A corpus pipeline: raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last
return the columns of documents. ORACLE_SQL is None: SQL cannot express the
classifier, the near-duplicate groups, the byte ranges and the packing; tests
hold each stage against a brute-force version. What a stage returns is lazy; the
tables that it still reads stay in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, line_dedup, near_dedup, packing, suffix_dedup
from tessera.llm.common import documents, scratch, written

ORACLE_SQL = None

def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or far from every language learned, go; lang becomes the language found."""
    shown = langid.identify(docs, langid.fit(docs))
    return shown.where(~F.col("rejected")).withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go, and documents of which nothing is left."""
    return _sized(line_dedup.drop_repeated_lines(docs)).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one of least doc_id."""
    return near_dedup.drop_near_duplicates(docs)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings of 50 bytes that an earlier document has go, and documents of which nothing is left."""
    return _sized(suffix_dedup.drop_repeats(docs)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("suffix_array_dedup", suffix_dedup_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read by the next.

    Only the last result but one and what the last stage reads are left there, so
    that the result can be read as long as it is held.
    """
    docs = documents(spark, sf_dir)
    with scratch(spark) as keep:
        for name, stage in STAGES[:-1]:
            docs = written(stage(spark, docs, sf_dir), name)
        keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
