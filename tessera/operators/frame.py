"""Frame: the engine's table. A thin immutable wrapper around a DataFrame; Catalyst plans and runs everything."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row

from tessera.errors import SchemaMismatch
from tessera.functions.typed import column, resolved
from tessera.operators.ordering import sort_key


class Frame:
    def __init__(self, df: DataFrame):
        self.df = df

    # Projection and scoping

    def _column(self, x):
        return resolved(self.df, x if isinstance(x, str) and x.endswith("*") else column(x))

    def select(self, *exprs) -> Frame:
        """Names, "*", "t.*" and expressions; window functions too."""
        if not exprs:
            raise ValueError("an empty select list")
        return Frame(self.df.select(*map(self._column, exprs)))

    def rename(self, *names: str) -> Frame:
        """New names by position, one for each column."""
        if len(names) != len(self.df.columns):
            raise SchemaMismatch(f"{len(names)} names for {len(self.df.columns)} columns")
        return Frame(self.df.toDF(*names))

    def rename_first(self, *names: str) -> Frame:
        """New names for the first columns; the rest keep theirs."""
        if len(names) > len(self.df.columns):
            raise SchemaMismatch(f"{len(names)} names for {len(self.df.columns)} columns")
        return Frame(self.df.toDF(*names, *self.df.columns[len(names) :]))

    def filter(self, condition) -> Frame:
        """Rows where the condition is true (neither false nor NULL)."""
        return Frame(self.df.filter(self._column(condition)))

    where = filter

    def subquery(self, name: str) -> Frame:
        """The same rows in a scope of that name."""
        return Frame(self.df.alias(name))

    def distinct(self) -> Frame:
        return Frame(self.df.distinct())

    # Order

    def order_by(self, *keys) -> Frame:
        """Sorted; NULLs are the largest values unless a key says otherwise. Window functions may serve as keys."""
        sorts = [sort_key(k) for k in keys]
        try:
            return Frame(self.df.orderBy(*[k.on(self.df) for k in sorts]))
        except AnalysisException:  # a window function: computed beside the columns, and dropped again
            hidden = [f"__s{i}" for i in range(len(sorts))]
            wide = self.df.select("*", *[self._column(k.expr).alias(h) for k, h in zip(sorts, hidden, strict=True)])
            return Frame(wide.orderBy(*[k.directed(wide[h]) for k, h in zip(sorts, hidden, strict=True)]).drop(*hidden))

    def limit(self, n: int) -> Frame:
        return Frame(self.df.limit(n))

    def top(self, n: int, *keys) -> Frame:
        """The first n rows by the keys: one pass that keeps n rows a task."""
        return self.order_by(*keys).limit(n)

    # Joins

    def join(self, other: Frame) -> Joined:
        return Joined(self, other, "inner")

    def left_join(self, other: Frame) -> Joined:
        return Joined(self, other, "left")

    def right_join(self, other: Frame) -> Joined:
        return Joined(self, other, "right")

    def outer_join(self, other: Frame) -> Joined:
        return Joined(self, other, "full")

    def cross_join(self, other: Frame) -> Frame:
        return Frame(self.df.crossJoin(other.df))

    # Multiset operations

    def union(self, other: Frame) -> Frame:
        """All rows of both."""
        a, b = self._matched(other)
        return Frame(a.union(b))

    def intersect(self, other: Frame) -> Frame:
        """Each row as often as in the one that has it less often."""
        a, b = self._matched(other)
        return Frame(a.intersectAll(b))

    def difference(self, other: Frame) -> Frame:
        """Each row as often as it is here more than in other."""
        a, b = self._matched(other)
        return Frame(a.exceptAll(b))

    except_ = difference

    def _matched(self, other: Frame) -> tuple[DataFrame, DataFrame]:
        mine, theirs = ([c.lower() for c in f.df.columns] for f in (self, other))
        if mine != theirs:
            raise SchemaMismatch(f"columns {self.df.columns} and {other.df.columns}")
        return self.df, other.df

    # Aggregation

    def group_by(self, *keys):
        from tessera.operators.grouped import Grouped

        return Grouped(self, keys)

    def agg(self, *exprs) -> Frame:
        """One row, also for an empty input."""
        return self.group_by().agg(*exprs)

    # Tables and results

    def as_table(self, name: str) -> Frame:
        self.df.createOrReplaceTempView(name)
        return self

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def schema(self):
        return self.df.schema

    def to_seq(self) -> list[Row]:
        return self.df.collect()

    def iterator(self) -> Iterator[Row]:
        """Rows one partition at a time."""
        return self.df.toLocalIterator()

    def show_string(self, rows: int = 20, truncate: bool = True) -> str:
        """A table drawn with box characters; long cells end in "..."."""
        found = self.df.limit(rows + 1).collect()
        more, found = len(found) > rows, found[:rows]
        cell = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v)
        cut = lambda s: s[:17] + "..." if truncate and len(s) > 20 else s
        table = [[cut(c) for c in self.df.columns], *[[cut(cell(v)) for v in r] for r in found]]
        width = [max(map(len, c)) for c in zip(*table, strict=True)]
        rule = lambda left, mid, right: left + mid.join("─" * w for w in width) + right
        line = lambda r: "│" + "│".join(v.rjust(w) if truncate else v.ljust(w) for v, w in zip(r, width, strict=True)) + "│"
        out = [rule("┌", "┬", "┐"), line(table[0]), rule("├", "┼", "┤"), *map(line, table[1:]), rule("└", "┴", "┘")]
        if more:
            out.append(f"Only showing top {rows} row" + "s" * (rows != 1))
        return "\n".join(out)

    def show(self, rows: int = 20, truncate: bool = True) -> None:
        print(self.show_string(rows, truncate))

    def show_schema(self) -> None:
        self.df.printSchema()

    def explain(self, extended: bool = False) -> None:
        self.df.explain(extended=extended)


class Joined:
    """Two frames waiting for their join condition."""

    def __init__(self, left: Frame, right: Frame, how: str):
        self._left, self._right, self._how = left, right, how

    def on(self, condition: Column) -> Frame:
        """Any condition; NULL counts as no match."""
        return Frame(self._left.df.join(self._right.df, condition, self._how))

