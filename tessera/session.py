"""Engine: the entry point."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from tessera import sources
from tessera.functions.registry import FunctionRegistry
from tessera.operators.frame import Frame
from tessera.plans.dialect import run_sql


class Engine:
    """Tables, ranges, local rows and SQL on a Spark session."""

    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.builder.appName("tessera").config("spark.sql.adaptive.enabled", "true").getOrCreate()
        self.functions = FunctionRegistry()

    def sql(self, text: str) -> Frame:
        """A query in the engine's dialect (see tessera.plans.dialect); registered functions can be called."""
        return Frame(run_sql(self.spark, text, self.functions.added))

    def table(self, name: str) -> Frame:
        return Frame(self.spark.table(name))

    def drop_table(self, name: str) -> None:
        self.spark.catalog.dropTempView(name)

    def range(self, *bounds: int) -> Frame:
        return Frame(sources.numbers(self.spark, *bounds))

    def lift(self, rows: Iterable, schema=None) -> Frame:
        return Frame(sources.lift(self.spark, rows, schema))

    def values(self, *exprs) -> Frame:
        return Frame(sources.values(self.spark, *exprs))

    def parquet(self, folder: str, name: str) -> Frame:
        return Frame(sources.parquet(self.spark, folder, name))

    def let(self, **frames: Frame) -> Engine:
        """Names frames for SQL that follows, as a WITH clause does for one query."""
        for name, frame in frames.items():
            frame.as_table(name)
        return self

    def open(self, folder: str, *names: str) -> Engine:
        """Registers Parquet tables of a folder under their names."""
        for name in names:
            self.parquet(folder, name).as_table(name)
        return self
