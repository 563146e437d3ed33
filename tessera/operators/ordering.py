"""Sort keys with NULLs as the largest values."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame

from tessera.functions.typed import column, resolved


@dataclass(frozen=True)
class SortKey:
    """An expression with a direction and a place for NULLs."""

    expr: object
    descending: bool = False
    nulls: str = ""  # "first", "last" or as the largest values

    def nulls_first(self) -> SortKey:
        return replace(self, nulls="first")

    def nulls_last(self) -> SortKey:
        return replace(self, nulls="last")

    def directed(self, c: Column) -> Column:
        """c in this key's direction."""
        nulls = self.nulls or ("first" if self.descending else "last")
        return getattr(c, f"{'desc' if self.descending else 'asc'}_nulls_{nulls}")()

    def on(self, df: DataFrame) -> Column:
        return self.directed(resolved(df, column(self.expr)))


def asc(x) -> SortKey:
    return SortKey(x)


def desc(x) -> SortKey:
    return SortKey(x, descending=True)


def sort_key(x) -> SortKey:
    """x as a sort key: ascending with NULLs last, unless it is one already."""
    return x if isinstance(x, SortKey) else SortKey(x)
