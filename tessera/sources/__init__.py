"""Sources: ranges, local rows, constant rows and Parquet tables."""

from __future__ import annotations

import dataclasses
import typing
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.functions.typed import column, resolved
from tessera.types import parse_type

#: Python types and the types of their columns.
PYTHON_TYPES = {bool: T.BooleanType, int: T.LongType, float: T.DoubleType, str: T.StringType}


def numbers(spark: SparkSession, *bounds: int) -> DataFrame:
    """id BIGINT NOT NULL: (end), (begin, end) or (begin, end, step); end is left out."""
    return spark.range(*bounds) if len(bounds) > 1 else spark.range(0, *bounds)


def python_type(hint) -> tuple[T.DataType, bool]:
    """(type, nullable) of a Python annotation."""
    args = [a for a in typing.get_args(hint) if a is not type(None)]
    if type(None) in typing.get_args(hint) and len(args) == 1:
        return python_type(args[0])[0], True
    origin = typing.get_origin(hint)
    if origin in (list, tuple):
        return T.ArrayType(*python_type(args[0])), True
    if origin is dict:
        return T.MapType(python_type(args[0])[0], *python_type(args[1])), True
    if dataclasses.is_dataclass(hint):
        return record_type(hint), True
    if hint in PYTHON_TYPES:
        return PYTHON_TYPES[hint](), hint is str
    raise TypeError(f"no column type for {hint!r}")


def record_type(record: type) -> T.StructType:
    """The schema of a dataclass: its fields, nullable where None or an object may stand."""
    hints = typing.get_type_hints(record)
    return T.StructType([T.StructField(f.name, *python_type(hints[f.name])) for f in dataclasses.fields(record)])


def lift(spark: SparkSession, rows: Iterable, schema: T.StructType | str | None = None) -> DataFrame:
    """Local rows: dataclass instances, or tuples with a schema."""
    rows = list(rows)
    if schema is None:
        if not rows or not dataclasses.is_dataclass(rows[0]):
            raise ValueError("tuples and empty collections need a schema")
        schema = record_type(type(rows[0]))
        rows = [dataclasses.astuple(r) for r in rows]
    elif isinstance(schema, str):
        schema = parse_type(f"ROW({schema})")
    return spark.createDataFrame(rows, schema)


def values(spark: SparkSession, *exprs) -> DataFrame:
    """One row of expressions."""
    one = spark.range(1)
    return one.select(*[resolved(one, column(e)) for e in exprs])


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
