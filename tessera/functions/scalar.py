"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.typed import Typed, column, lifting, resolved, type_of
from tessera.types import parse_type

#: Strings that stand for the two boolean values.
TRUE_STRINGS = ["yes", "y", "true", "t", "on"]
FALSE_STRINGS = ["no", "n", "false", "f", "off"]


def col(name: str) -> Column:
    return F.col(name)


def lit(value) -> Column:
    return F.lit(value)


def truth(x) -> Typed:
    """x as a condition: numbers count as true unless they are 0."""
    return Typed(lambda df: (lambda c: c.cast("boolean") if isinstance(type_of(df, c), T.NumericType) else c)(resolved(df, column(x))))


@lifting
def java(class_name: str, method: str, *xs) -> Column:
    """A static Java method's result; the class has to be on the executors' class path."""
    return F.java_method(F.lit(class_name), F.lit(method), *map(column, xs))


@lifting
def not_(x) -> Column:
    return ~column(x)


@lifting
def negate(x) -> Column:
    return -column(x)


@lifting
def positive(x) -> Column:
    return column(x)


def divide(a, b) -> Typed:
    """a / b; of two integers the quotient, rounded towards zero, in the wider of their types."""

    def build(df):
        x, y = (resolved(df, column(v)) for v in (a, b))
        kinds = [type_of(df, x), type_of(df, y)]
        order = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]
        if all(k in order for k in kinds):
            wide = order[max(order.index(k) for k in kinds)]
            return F.call_function("div", x, y).cast(wide)
        return x / y

    return Typed(build)


@lifting
def remainder(a, b) -> Column:
    return column(a) % column(b)


@lifting
def power(a, b) -> Column:
    return F.pow(column(a), column(b))


@lifting
def is_nan(x) -> Column:
    """False for NULL."""
    return F.coalesce(F.isnan(column(x)), F.lit(False))


@lifting
def greatest(*xs) -> Column:
    return F.greatest(*map(column, xs))


@lifting
def least(*xs) -> Column:
    return F.least(*map(column, xs))


@lifting
def coalesce(*xs) -> Column:
    return F.coalesce(*map(column, xs))


@lifting
def null_if(a, b) -> Column:
    return F.nullif(column(a), column(b))


@lifting
def strict_if(test, yes, no) -> Column:
    """NULL where the test is NULL."""
    t = column(test)
    return F.when(t.isNull(), F.lit(None)).when(t, yes).otherwise(no)


@lifting
def when(test, value) -> Column:
    return F.when(column(test), value)


@lifting
def case(key, branches: list[tuple], otherwise=None) -> Column:
    """Simple CASE: each branch is (values, result); values are one, or a list, or functions of the key."""
    k, out = column(key), None
    for values, result in branches:
        test = None
        for v in values if isinstance(values, (list, tuple)) else [values]:
            one = v(k) if callable(v) and not isinstance(v, Column) else k == v
            test = one if test is None else test | one
        out = F.when(test, result) if out is None else out.when(test, result)
    return out.otherwise(otherwise)


@lifting
def in_strict(test, values: list) -> Column:
    """Two-valued IN: true or false, never NULL; NULL is in a list that holds NULL."""
    t = column(test)
    some = [v for v in values if v is not None]
    found = F.coalesce(t.isin(some), F.lit(False)) if some else F.lit(False)
    return found | t.isNull() if None in values else found


@lifting
def concat(*xs) -> Column:
    """Strings joined, NULLs skipped; never NULL."""
    return F.concat_ws("", *map(column, xs))


@lifting
def rlike(x, pattern: str) -> Column:
    """The whole string matches the pattern."""
    return column(x).rlike(rf"\A(?:{pattern})\z")


def length(x) -> Typed:
    """Characters of a string, elements of an array or entries of a map."""

    def build(df):
        c = resolved(df, column(x))
        kind = type_of(df, c)
        return F.size(c) if isinstance(kind, (T.ArrayType, T.MapType)) else F.length(c)

    return Typed(build)


@lifting
def to_bool(x) -> Column:
    """yes, y, true, t, on and no, n, false, f, off in any case; NULL for anything else."""
    v = F.lower(column(x))
    return F.when(v.isin(TRUE_STRINGS), True).when(v.isin(FALSE_STRINGS), False)


def cast(x, kind: str):
    """CAST by the dialect's type names; strings to boolean by to_bool."""
    target = parse_type(kind)
    if isinstance(target, T.BooleanType):

        def build(df):
            c = resolved(df, column(x))
            return to_bool(c) if isinstance(type_of(df, c), T.StringType) else c.cast(target)

        return Typed(build)
    return column(x).cast(target)


def rand(seed: int) -> Column:
    return F.rand(seed)


@lifting
def array(*xs) -> Column:
    return F.array(*map(column, xs))


@lifting
def make_map(*keys_and_values) -> Column:
    """k1, v1, k2, v2, ..."""
    return F.create_map(*map(column, keys_and_values))


@lifting
def map_halves(*xs) -> Column:
    """All keys, then all values."""
    if len(xs) % 2:
        raise ValueError("as many keys as values are needed")
    half = len(xs) // 2
    return F.map_from_arrays(F.array(*map(column, xs[:half])), F.array(*map(column, xs[half:])))


@lifting
def named_struct(**fields) -> Column:
    return F.struct(*[column(v).alias(n) for n, v in fields.items()])


@lifting
def named_struct_halves(*xs) -> Column:
    """All names, then all values."""
    if len(xs) % 2:
        raise ValueError("as many names as values are needed")
    half = len(xs) // 2
    return F.struct(*[column(v).alias(n) for n, v in zip(xs[:half], xs[half:], strict=True)])


@lifting
def struct(*xs) -> Column:
    """Fields c0, c1, ..."""
    return F.struct(*[column(x).alias(f"c{i}") for i, x in enumerate(xs)])
