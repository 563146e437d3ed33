"""Expressions with the engine's semantics, as plain Columns wherever the input type doesn't matter.

A few depend on the type of their input (integral division, length, product).
They give a Typed, which a Frame resolves against its schema.
"""

from tessera.functions.aggregates import aggregate, array_agg, avg, bool_and, bool_or, count, count_distinct, first, last, product, sum_distinct
from tessera.functions.aggregates import max_ as max
from tessera.functions.aggregates import min_ as min
from tessera.functions.aggregates import sum_ as sum
from tessera.functions.registry import FunctionRegistry
from tessera.functions.scalar import (
    array,
    case,
    cast,
    coalesce,
    col,
    concat,
    divide,
    greatest,
    in_strict,
    is_nan,
    java,
    least,
    length,
    lit,
    make_map,
    map_halves,
    named_struct,
    named_struct_halves,
    negate,
    not_,
    null_if,
    positive,
    power,
    rand,
    remainder,
    rlike,
    strict_if,
    struct,
    to_bool,
    truth,
    when,
)
from tessera.functions.typed import Typed
from tessera.operators.ordering import asc, desc

__all__ = [
    "FunctionRegistry", "Typed", "aggregate", "array", "array_agg", "asc", "avg", "bool_and", "bool_or", "case", "cast", "coalesce", "col", "concat", "count",
    "count_distinct", "desc", "divide", "first", "greatest", "in_strict", "is_nan", "java", "last", "least", "length", "lit", "make_map", "map_halves", "max",
    "min", "named_struct", "named_struct_halves", "negate", "not_", "null_if", "positive", "power", "product", "rand", "remainder", "rlike", "strict_if",
    "struct", "sum", "sum_distinct", "to_bool", "truth", "when",
]
