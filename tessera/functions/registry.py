"""Functions by name."""

from __future__ import annotations

from collections.abc import Callable

from tessera.errors import FunctionNotFound
from tessera.functions import aggregates as A
from tessera.functions import scalar as S


class FunctionRegistry:
    """Names, in any case, to functions that build expressions; each registry can be changed by itself."""

    def __init__(self) -> None:
        #: Functions that were registered or replaced, by name.
        self.added: dict[str, Callable] = {}
        # The names.
        self._known: dict[str, Callable] = {
            "coalesce": S.coalesce,
            "rand": S.rand,
            "length": S.length,
            "array_agg": A.array_agg,
            "count": A.count,
            "first": A.first,
            "first_value": A.first,
            "last": A.last,
            "last_value": A.last,
            "max": A.max_,
            "min": A.min_,
            "average": A.avg,
            "avg": A.avg,
            "sum": A.sum_,
            "product": A.product,
            "bool_and": A.bool_and,
            "bool_or": A.bool_or,
            "concat": S.concat,
            "named_struct": S.named_struct_halves,
            "array": S.array,
            "map": S.map_halves,
        }
        self._distinct: dict[str, Callable] = {"count": A.count_distinct, "sum": A.sum_distinct}

    def names(self) -> list[str]:
        return sorted(self._known)

    def register(self, name: str, build: Callable) -> None:
        self._known[name.lower()] = self.added[name.lower()] = build

    def remove(self, name: str) -> None:
        self._known.pop(name.lower(), None)
        self.added.pop(name.lower(), None)

    def lookup(self, name: str) -> Callable:
        try:
            return self._known[name.lower()]
        except KeyError:
            raise FunctionNotFound(name) from None

    def call(self, name: str, *args, distinct: bool = False):
        """The function's expression; * is for count alone, distinct for aggregates."""
        build = self.lookup(name)
        if any(isinstance(a, str) and a == "*" for a in args) and name.lower() != "count":
            raise ValueError(f"{name}(*)")
        if not distinct:
            return build(*args)
        if name.lower() in ("max", "min", "bool_and", "bool_or"):  # repeats make no difference
            return build(*args)
        if name.lower() not in self._distinct:
            raise ValueError(f"{name}(DISTINCT ...)")
        return self._distinct[name.lower()](*args)
