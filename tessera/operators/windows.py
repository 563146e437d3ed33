"""Window specifications: built up step by step, named, referred to and refined."""

from __future__ import annotations

from pyspark.sql import Window as SparkWindow
from pyspark.sql import WindowSpec

from tessera.functions.typed import column
from tessera.operators.ordering import sort_key

UNBOUNDED_PRECEDING = SparkWindow.unboundedPreceding
UNBOUNDED_FOLLOWING = SparkWindow.unboundedFollowing
CURRENT_ROW = SparkWindow.currentRow


class Window:
    """An immutable window: partition keys, order and frame.

    Without a frame, an ordered window runs from the partition's start to the
    current row and its peers, an unordered one over the whole partition. Frame
    bounds are negative (preceding), 0 (current row) or positive (following).
    """

    def __init__(self, partition=(), order=(), frame=None):
        self._partition, self._order, self._frame = tuple(partition), tuple(order), frame

    @classmethod
    def partition_by(cls, *keys) -> Window:
        return cls(partition=keys)

    @classmethod
    def ordered_by(cls, *keys) -> Window:
        return cls(order=keys)

    def order_by(self, *keys) -> Window:
        return Window(self._partition, keys, self._frame)

    def rows_between(self, start: int, end: int = CURRENT_ROW) -> Window:
        return self._framed(("rows", start, end))

    def range_between(self, start: int, end: int = CURRENT_ROW) -> Window:
        return self._framed(("range", start, end))

    def _framed(self, frame) -> Window:
        if self._frame is not None:
            raise ValueError("the window already has a frame")
        return Window(self._partition, self._order, frame)

    def refine(self, order=(), frame: tuple | None = None) -> Window:
        """This window with an order or frame that it doesn't have yet."""
        if order and self._order:
            raise ValueError("the window already has an order")
        if self._frame is not None:
            raise ValueError("a window with a frame can't be refined")
        return Window(self._partition, order or self._order, frame)

    @property
    def spec(self) -> WindowSpec:
        out = SparkWindow.partitionBy(*map(column, self._partition))
        if self._order:
            out = out.orderBy(*[k.directed(column(k.expr)) for k in map(sort_key, self._order)])
        if self._frame:
            kind, start, end = self._frame
            out = out.rowsBetween(start, end) if kind == "rows" else out.rangeBetween(start, end)
        return out
