"""Expressions that need to know the type of their input."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable
from typing import Union

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn
from pyspark.sql.types import DataType


class Typed(ClassicColumn):
    """A Column that is built where the schema is known.

    It takes part in every operator and method of a Column, on either side, and
    gives a Typed again; the library's functions take it anywhere.
    """

    def __new__(cls, *args, **kwargs):
        return object.__new__(cls)

    def __init__(self, build: Callable[[DataFrame], Column], windowed: Callable[[DataFrame, object], Column] | None = None):
        self._build, self._windowed = build, windowed

    def resolve(self, df: DataFrame) -> Column:
        return self._build(df)

    def then(self, change: Callable[[Column], Column]) -> Typed:
        return Typed(lambda df: change(self._build(df)))

    def over(self, window) -> Typed:
        spec = getattr(window, "spec", window)
        if self._windowed is not None:
            return Typed(lambda df: self._windowed(df, spec))
        return self.then(lambda c: c.over(spec))

    def __repr__(self) -> str:
        return "Typed"

    def __getattr__(self, name: str):
        raise AttributeError(name)

    def __bool__(self) -> bool:
        raise ValueError("use & for and, | for or, ~ for not")

    __hash__ = object.__hash__


def _lifted(name: str):
    def method(self, *args, **kwargs):
        return Typed(lambda df: getattr(self.resolve(df), name)(*[resolved(df, a) for a in args], **{k: resolved(df, v) for k, v in kwargs.items()}))

    return method


def _binary(change: Callable, reflected: bool):
    if reflected:
        return lambda self, other: Typed(lambda df: change(resolved(df, other), self.resolve(df)))
    return lambda self, other: Typed(lambda df: change(self.resolve(df), resolved(df, other)))


for _name in dir(ClassicColumn):
    if not _name.startswith("_") and _name != "over" and callable(getattr(ClassicColumn, _name)):
        setattr(Typed, _name, _lifted(_name))
for _name in ("add", "sub", "mul", "truediv", "mod", "pow", "and_", "or_"):
    _op, _mark = getattr(operator, _name), _name.rstrip("_")
    setattr(Typed, f"__{_mark}__", _binary(_op, False))
    setattr(Typed, f"__r{_mark}__", _binary(_op, True))
for _name in ("eq", "ne", "lt", "le", "gt", "ge"):
    setattr(Typed, f"__{_name}__", _binary(getattr(operator, _name), False))
for _name in ("neg", "invert"):
    setattr(Typed, f"__{_name}__", _lifted(f"__{_name}__"))
setattr(Typed, "__getitem__", _lifted("__getitem__"))


class Windowed(ClassicColumn):
    """A Column that is built another way over a window."""

    def __new__(cls, *args, **kwargs):
        return object.__new__(cls)

    def __init__(self, plain: Column, windowed: Callable[[object], Column]):
        super().__init__(plain._jc)
        self._windowed = windowed

    def over(self, window) -> Column:
        return self._windowed(getattr(window, "spec", window))


Expr = Union[Column, Typed, str]


def column(x) -> Column | Typed:
    """A name is a column; anything else that isn't an expression is a literal."""
    if isinstance(x, (Column, Typed)):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def resolved(df: DataFrame, x):
    """x as a Column, if it is a Typed; else as it is."""
    return x.resolve(df) if isinstance(x, Typed) else x


def type_of(df: DataFrame, c: Column) -> DataType:
    return df.select(c).schema[0].dataType


def lifting(build: Callable) -> Callable:
    """A function of columns that also takes Typed anywhere, within lists and tuples too, and gives a Typed then."""

    def typed(x) -> bool:
        return isinstance(x, Typed) or isinstance(x, (list, tuple)) and any(map(typed, x))

    def settled(df, x):
        return type(x)(settled(df, y) for y in x) if isinstance(x, (list, tuple)) and not isinstance(x, str) else resolved(df, x)

    @functools.wraps(build)
    def call(*args, **kwargs):
        if not any(map(typed, (*args, *kwargs.values()))):
            return build(*args, **kwargs)

        def at(df):
            return resolved(df, build(*[settled(df, a) for a in args], **{k: settled(df, v) for k, v in kwargs.items()}))

        def over(df, spec):
            return resolved(df, build(*[settled(df, a) for a in args], **{k: settled(df, v) for k, v in kwargs.items()}).over(spec))

        return Typed(at, over)

    return call
