"""Small helpers that several operators share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch to a Python worker, where the session leaves Spark's own number: texts are long, and a batch is held several times.
BATCH = 1000
SPARKS_BATCH = "10000"
#: Bits of a sieve, 64 a row: what bounds the table that is broadcast.
SIEVE = 1 << 22


def shipped(spark: SparkSession) -> None:
    """Sends this package's code to the executors once per context, so that workers started anywhere can import it, and bounds their batches."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == SPARKS_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    if getattr(sc, "_tessera_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="tessera-code-")), "tessera_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(os.path.join(top, "tessera")):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, top))
    sc.addPyFile(archive)
    sc._tessera_shipped = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipped(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in spark.checkpoint.dir. Only where that is unset and the
    master is local, as in tests on one machine, is a temporary folder made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="tessera-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


_recording: ContextVar[tuple[list[str], ...]] = ContextVar("recording", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that written() makes inside are deleted at the end, but for those passed to the function that this gives.

    Whatever is read later has to be kept: a lazy frame doesn't outlive its tables.
    """
    paths: list[str] = []
    kept: set[str] = set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table.written_to)
        return table

    token = _recording.set((*_recording.get(), paths))
    try:
        yield keep
    finally:
        _recording.reset(token)
        removed(spark, [p for p in paths if p not in kept])


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables of written() that nothing reads any more, through Spark's own file systems."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a compressed table in the shared folder: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera-{label}-{uuid.uuid4().hex}"
    for paths in _recording.get():
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sieve(df: DataFrame, *keys: Column | str) -> DataFrame:
    """A bitmap of hashes of keys, as a written table of at most SIEVE / 64 rows (word, mask).

    What is not in the sieve is surely not among the keys; what is in it may be.
    The more keys, the more pass, so an exact join has to follow.
    """
    bit = F.pmod(F.xxhash64(*keys), F.lit(SIEVE))
    words = df.select(F.shiftright(bit, 6).alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("__bit"))
    return written(words.groupBy("__word").agg(F.bit_or("__bit").alias("__mask")), "sieve")


def sifted(df: DataFrame, held: DataFrame, *keys: Column | str) -> tuple[DataFrame, DataFrame]:
    """(rows whose keys may be in the sieve, rows whose keys are not): so that only the first have to move to a join."""
    bit = F.pmod(F.xxhash64(*keys), F.lit(SIEVE))
    joined = df.withColumn("__at", bit).join(F.broadcast(held), F.shiftright(F.col("__at"), 6) == F.col("__word"), "left")  # at most SIEVE / 64 rows
    passes = F.coalesce(F.call_function("shiftright", F.col("__mask"), (F.col("__at") % 64).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return joined.where(passes).select(*df.columns), joined.where(~passes).select(*df.columns)


def gapless_rank(df: DataFrame, group: list[str], order: list, name: str, rows_per_sort: int = 50_000) -> DataFrame:
    """Adds long column `name`: 0, 1, 2, ... within each group, without sorting a whole group in one task.

    Rows of a group are dealt to sub-groups by a hash of `order`; each sub-group
    is sorted by itself and starts where the sub-groups before it end. The table
    of starts has a row for each sub-group: one for rows_per_sort rows of a group.
    The ranks follow (sub-group, order), so they are gapless but not ordered by
    `order` alone. Rows that tie in `order` get adjacent ranks.
    """
    from pyspark.sql import Window

    # A group has as many sub-groups as its own rows call for.
    sizes = df.groupBy(*[F.col(c).alias(f"__g_{c}") for c in group]).agg(F.ceil(F.count(F.lit(1)) / rows_per_sort).cast("long").alias("__subs"))
    sized = df.join(F.broadcast(sizes), [F.col(c).eqNullSafe(F.col(f"__g_{c}")) for c in group], "left")  # callers group by a bounded set of values
    dealt = sized.withColumn("__sub", F.pmod(F.xxhash64(*order), F.col("__subs")).cast("int")).drop("__subs", *[f"__g_{c}" for c in group])
    keys = [*group, "__sub"]
    counts = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"__s_{k}") for k in keys], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    ranked = dealt.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    on = [F.col(k).eqNullSafe(F.col(f"__s_{k}")) for k in keys]
    return ranked.join(starts, on, "left").withColumn(name, (F.col(name) + F.col("__start")).cast("long")).drop("__sub", "__start", *[f"__s_{k}" for k in keys])
