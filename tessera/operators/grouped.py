"""Grouping: only what is listed comes out; HAVING and ORDER BY may use keys and aggregates that don't."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from tessera.functions.typed import column, resolved
from tessera.operators.frame import Frame
from tessera.operators.ordering import sort_key


class Grouped:
    """Keys with pending conditions and order; agg() turns it into a frame."""

    def __init__(self, frame: Frame, keys, having=(), order=()):
        self._frame, self._keys, self._having, self._order = frame, tuple(keys), tuple(having), tuple(order)

    def having(self, *conditions) -> Grouped:
        """All conditions of all calls must hold."""
        return Grouped(self._frame, self._keys, (*self._having, *conditions), self._order)

    def order_by(self, *keys) -> Grouped:
        """The last call counts."""
        return Grouped(self._frame, self._keys, self._having, keys)

    def agg(self, *exprs) -> Aggregated:
        if not exprs:
            raise ValueError("an empty list of results")
        return Aggregated(self._frame, self._keys, exprs, self._having, self._order)


class Aggregated(Frame):
    """An aggregate that later filters and orders can still reach into, as HAVING and hidden sort keys."""

    def __init__(self, frame: Frame, keys, exprs, having, order):
        self._parts = (frame, keys, exprs, having, order)
        super().__init__(self._built(frame.df, keys, exprs, having, order))

    @staticmethod
    def _built(df: DataFrame, keys, exprs, having, order) -> DataFrame:
        as_column = lambda x: resolved(df, column(x))
        kept = [as_column(e) for e in exprs]
        conditions = [as_column(c).alias(f"__h{i}") for i, c in enumerate(having)]
        sorts = [sort_key(k) for k in order]
        hidden = [as_column(k.expr).alias(f"__s{i}") for i, k in enumerate(sorts)]
        grouped = df.groupBy(*[as_column(k) for k in keys])
        names = grouped.agg(*kept).columns[len(keys) :]
        wide = grouped.agg(*kept, *conditions, *hidden)
        wide = wide.toDF(*[f"__k{i}" for i in range(len(keys))], *[f"__r{i}" for i in range(len(kept))], *wide.columns[len(keys) + len(kept) :])
        for i in range(len(conditions)):
            wide = wide.filter(f"__h{i}")
        if sorts:
            wide = wide.orderBy(*[k.directed(wide[f"__s{i}"]) for i, k in enumerate(sorts)])
        return wide.select(*[wide[f"__r{i}"].alias(n) for i, n in enumerate(names)])

    def filter(self, condition) -> Frame:
        """On results, if it names them; otherwise one more HAVING condition."""
        try:
            return super().filter(condition)
        except AnalysisException:
            frame, keys, exprs, having, order = self._parts
            return Aggregated(frame, keys, exprs, (*having, condition), order)

    where = filter

    def order_by(self, *sort) -> Frame:
        """By results, if the keys name them; otherwise by grouping keys and aggregates that don't come out."""
        try:
            return Frame(self.df.orderBy(*[sort_key(k).on(self.df) for k in sort]))
        except AnalysisException:
            frame, keys, exprs, having, _ = self._parts
            return Aggregated(frame, keys, exprs, having, sort)
