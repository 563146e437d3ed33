"""Type names: the dialect's DDL to Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T


#: The dialect's names of primitive types. REAL is double precision here.
PRIMITIVES: dict[str, type[T.DataType]] = {
    "boolean": T.BooleanType,
    "tinyint": T.ByteType,
    "smallint": T.ShortType,
    "int": T.IntegerType,
    "integer": T.IntegerType,
    "bigint": T.LongType,
    "float": T.FloatType,
    "real": T.DoubleType,
    "double": T.DoubleType,
    "string": T.StringType,
    "date": T.DateType,
}

_TOKEN = re.compile(r"\s*([A-Za-z_]\w*|`[^`]*`|\"[^\"]*\"|[<>(),:])")


def parse_type(text: str) -> T.DataType:
    """INT, ARRAY<t>, MAP<k, v>, STRUCT<n: t, ...> and ROW(n t, ...), in any case and nesting."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not a type: {text!r}")
        tokens.append(m[1])
        at = m.end()
    tokens.append("")
    place = 0

    def take(*wanted: str) -> str:
        nonlocal place
        token = tokens[place]
        if wanted and token.lower() not in wanted:
            raise ValueError(f"not a type: {text!r} (at {token!r})")
        place += 1
        return token

    def fields(between: str, close: str) -> T.StructType:
        out = T.StructType()
        while True:
            name = take().strip("`\"")
            if between:
                take(between)
            out.add(name, one())
            if take(",", close) == close:
                return out

    def one() -> T.DataType:
        name = take().lower()
        if name == "array":
            take("<")
            inner = one()
            take(">")
            return T.ArrayType(inner)
        if name == "map":
            take("<")
            key = one()
            take(",")
            value = one()
            take(">")
            return T.MapType(key, value)
        if name == "struct":
            take("<")
            return fields(":", ">")
        if name == "row":
            take("(")
            return fields("", ")")
        if name not in PRIMITIVES:
            raise ValueError(f"not a type: {text!r} (at {name!r})")
        return PRIMITIVES[name]()

    found = one()
    take("")
    return found


__all__ = ["PRIMITIVES", "parse_type"]
