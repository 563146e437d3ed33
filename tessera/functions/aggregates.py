"""Aggregate functions; each also serves over a window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.typed import Typed, Windowed, column, lifting, resolved, type_of


@lifting
def count(x="*") -> Column:
    """Rows (for *) or non-NULL values."""
    return F.count(F.lit(1)) if isinstance(x, str) and x == "*" else F.count(column(x))


@lifting
def count_distinct(*xs) -> Column:
    return F.count_distinct(*map(column, xs))


@lifting
def sum_distinct(x) -> Column:
    return F.sum_distinct(column(x))


@lifting
def max_(x) -> Column:
    return F.max(column(x))


@lifting
def min_(x) -> Column:
    return F.min(column(x))


@lifting
def sum_(x) -> Column:
    return F.sum(column(x))


@lifting
def avg(x) -> Column:
    """A double."""
    return F.avg(column(x).cast("double"))


@lifting
def first(x, ignore_nulls: bool = True, order=None) -> Column:
    """The first value, by `order` if given (then the result doesn't depend on how rows are dealt out)."""
    c = column(x)
    if order is None:
        return F.first(c, ignorenulls=ignore_nulls)
    return F.min_by(F.when(c.isNotNull(), c) if ignore_nulls else c, F.when(c.isNotNull(), column(order)) if ignore_nulls else column(order))


@lifting
def last(x, ignore_nulls: bool = True, order=None) -> Column:
    """The last value, by `order` if given."""
    c = column(x)
    if order is None:
        return F.last(c, ignorenulls=ignore_nulls)
    return F.max_by(F.when(c.isNotNull(), c) if ignore_nulls else c, F.when(c.isNotNull(), column(order)) if ignore_nulls else column(order))


#: Types that a product of integers is multiplied in, if it is cast to them.
WIDE = (T.LongType, T.DoubleType, T.FloatType)


def product_type(kind: T.DataType, into: T.DataType | None) -> T.DataType:
    """The type in which a product of integers of type `kind` is multiplied, if it is then cast to `into`."""
    if isinstance(into, (T.DoubleType, T.FloatType)):
        return T.DoubleType()
    return into if isinstance(into, T.LongType) else kind


class _Product(Typed):
    """A product, which a cast right after it can still tell the type to multiply in."""

    def __init__(self, build: Callable, spec=None):
        over = (lambda c: c) if spec is None else (lambda c: c.over(spec))
        super().__init__(lambda df: build(df, over, None))
        self._made = lambda df, into: build(df, over, into)
        self._of = build

    def over(self, window) -> Typed:
        return _Product(self._of, getattr(window, "spec", window))

    def cast(self, dataType) -> Typed:
        return Typed(lambda df: self._made(df, type_of(df, F.lit(None).cast(dataType))).cast(dataType))

    astype = cast


def product(x) -> Typed:
    """The product of the non-NULL values in the type of the input; NULL if there are none.

    Doubles are multiplied in place. Of integers only those other than -1, 0 and 1
    are gathered and folded exactly: a product that its type can hold has at most
    63 of them. If the product is cast right away to bigint or a floating type,
    integers are multiplied in bigint or double, so that the narrower type can't overflow.
    """

    def build(df, over, into):
        c = resolved(df, column(x))
        kind = type_of(df, c)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return over(F.product(c)).cast(kind)
        kind = product_type(kind, into)
        zero = over(F.bool_or(c == 0))
        if isinstance(kind, T.DoubleType):
            return F.when(zero, F.lit(0.0)).otherwise(over(F.product(c)))
        factors = over(F.collect_list(F.when(~c.isin(-1, 0, 1), c)))
        flips = over(F.count(F.when(c == -1, 1)))
        start = F.when(zero, F.lit(0)).otherwise(F.when(flips % 2 == 1, F.lit(-1)).otherwise(F.lit(1)))
        fold = F.aggregate(F.when(zero, F.array().cast(T.ArrayType(type_of(df, c)))).otherwise(factors), start.cast(kind), lambda a, v: (a * v).cast(kind))
        return F.when(over(F.count(c)) > 0, fold)

    return _Product(build)


@lifting
def bool_and(x) -> Column:
    return F.bool_and(column(x))


@lifting
def bool_or(x) -> Column:
    return F.bool_or(column(x))


@lifting
def array_agg(x, order=None) -> Column:
    """All values, NULLs too; an empty array without rows. By `order` if given."""
    c = column(x)

    def build(over=lambda c: c):
        if order is None:
            return F.transform(over(F.collect_list(F.struct(c.alias("v")))), lambda s: s["v"])
        return F.transform(F.array_sort(over(F.collect_list(F.struct(column(order).alias("o"), c.alias("v"))))), lambda s: s["v"])

    return Windowed(build(), lambda spec: build(lambda c: c.over(spec)))


def aggregate(x, initial, accumulate, merge=None, result=None, order=None) -> Typed:
    """A user-defined aggregate: a fold of the values of x from `initial`.

    accumulate(state, value) gives the next state, merge(state, state) joins two,
    result(state) gives the outcome; all are functions of Columns, and the states
    have the type of `initial`. With a merge each value becomes a state by itself
    and the states are joined, so that the order doesn't matter; without one the
    values are folded by `order`, or as they come. NULL values are folded too. A
    group's values are gathered for it. Also over a window.
    """

    def build(df, over=lambda c: c):
        c = resolved(df, column(x))
        zero = F.lit(initial) if not isinstance(initial, Column) else initial
        values = resolved(df, array_agg(c, order).over(over.spec) if hasattr(over, "spec") else array_agg(c, order))
        finish = result or (lambda s: s)
        if merge is None:
            return F.aggregate(values, zero, accumulate, finish)
        one = F.transform(values, lambda v: accumulate(zero, v))
        return F.aggregate(one, zero, merge, finish)

    def windowed(df, spec):
        def over(c):
            return c.over(spec)

        over.spec = spec
        return build(df, over)

    return Typed(build, windowed)
