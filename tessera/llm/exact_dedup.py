"""Exact deduplication by content-defined chunk recipes, in DataFrame operations only.

A text is cut where its own content says so. Equal chunks, wherever they are,
get one verified identifier, and a text becomes the ordered list of its chunks'
identifiers: its recipe. Texts are equal exactly when their recipes are, so
after the chunk pass only recipes move, never the documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, written

#: A chunk ends at a space after one of CUT's letters, once it has LEAST characters, or at MOST characters.
LEAST, MOST, CUT = 256, 4096, "dkmwz"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text.

    The general replacement runs only on texts that hold more than single
    spaces and line ends, as most do not.
    """
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" "))
    odd = reduce(lambda a, b: a | b, [F.contains(plain, F.lit(x)) for x in ("  ", "\t", "\r", "\x0b", "\x0c")])
    return F.when(odd, F.regexp_replace(plain, r"[\x20\x09-\x0D]+", " ")).otherwise(plain)


def chunks(text: Column) -> Column:
    """The text as an array of content-defined chunks that concatenate to it; no chunk for the empty text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{LEAST},{MOST - 2}}}?[{CUT}] |.{{1,{MOST}}}"), F.lit(0))


def _hash(chunk: Column) -> Column:
    return F.unhex(F.sha2(chunk, 256))


def colliding_chunks(texts: DataFrame, text: str) -> DataFrame:
    """(chunk, digest, ordinal) for those chunks whose digest another, different chunk also has.

    The chunks themselves are the grouping key here, so equality is verified on
    content. ordinal tells the chunks of one digest apart.
    """
    from pyspark.sql import Window

    each = texts.select(F.explode(F.array_distinct(chunks(F.col(text)))).alias("chunk"))
    distinct = each.select(_hash(F.col("chunk")).alias("digest"), "chunk").groupBy("digest", "chunk").agg(F.count(F.lit(1)).alias("uses"))
    shared = distinct.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    clash = distinct.join(shared, "digest", "left_semi")
    return clash.select("chunk", "digest", F.row_number().over(Window.partitionBy("digest").orderBy("chunk")).alias("ordinal"))


def recipes(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with array column `name`: the verified identifiers of the chunks of column `text`, in order.

    An identifier is the chunk's SHA-256 after a pass over all chunks that
    compares the contents behind each digest. Should different contents share
    one, then the digest is followed by an ordinal that tells them apart.
    """
    clash = colliding_chunks(df.select(text), text)
    plain = F.transform(chunks(F.col(text)), _hash)
    if clash.isEmpty():
        return df.withColumn(name, plain)
    split = df.select(F.struct(*df.columns, F.monotonically_increasing_id().alias("__id")).alias("__row"), F.col(text)).select("__row", F.posexplode_outer(chunks(F.col(text))).alias("__at", "__chunk"))
    marked = split.join(clash.select(F.col("chunk").alias("__chunk"), "ordinal"), "__chunk", "left")
    one = F.concat(_hash(F.col("__chunk")), F.coalesce(F.col("ordinal").cast("string"), F.lit("")).cast("binary"))
    listed = marked.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("__at", one.alias("id")))).alias("__ids"))
    return listed.select(*[F.col("__row")[c].alias(c) for c in df.columns], F.transform(F.filter("__ids", lambda x: x["__at"].isNotNull()), lambda x: x["id"]).alias(name))


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256, of the text with white-space runs as one space.

    Null and empty texts form one group. Of equal texts the least non-null key
    stays. Rows that repeat both key and text are one document and share its
    decision; each counts in group_size. Null keys stay only if all keys of their
    group are null. Other columns of df are not read.
    """
    texts = df.select(F.col(key).alias("doc_id"), normalised(F.col(text)).alias("text"))
    listed = written(recipes(texts, "text", "recipe").select("doc_id", F.sha2("text", 256).alias("text_sha256"), "recipe"), "recipes")
    # Written, so that the join has plain exchanges on both sides and a hot group can be split.
    groups = written(listed.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    return listed.join(groups, "recipe").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
