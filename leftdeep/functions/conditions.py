"""Filters as small trees that compile to one Column.

A leaf is false where its left side is null, and NOT negates that two-valued
answer, so ``~(a > 5)`` keeps rows whose ``a`` is null. Above no NOT the bare
predicate is emitted, which gives the same rows and reaches the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Resolves "alias.column" to the Column and its type.
Resolve = Callable[[str], tuple[Column, T.DataType]]

OPERATORS = (">", "<", ">=", "<=", "=", "IN", "CONTAINS")


@dataclass(frozen=True, eq=False)
class ColumnRef:
    """``col("alias.column")``, where the column may have dots of its own; comparing it makes a Condition."""

    name: str

    def __post_init__(self) -> None:
        alias, _, column = self.name.partition(".")
        if not alias or not column:
            raise ValueError(f"a column is written alias.column, not {self.name!r}")

    def __gt__(self, other: Any) -> Condition:
        return Condition(self, ">", other)

    def __lt__(self, other: Any) -> Condition:
        return Condition(self, "<", other)

    def __ge__(self, other: Any) -> Condition:
        return Condition(self, ">=", other)

    def __le__(self, other: Any) -> Condition:
        return Condition(self, "<=", other)

    def __eq__(self, other: Any) -> Condition:  # type: ignore[override]
        return Condition(self, "=", other)

    def __ne__(self, other: Any) -> Condition:  # type: ignore[override]
        return ~Condition(self, "=", other)

    __hash__ = None  # type: ignore[assignment]

    def isin(self, values: Iterable[Any]) -> Condition:
        return Condition(self, "IN", values)

    def contains(self, value: Any) -> Condition:
        return Condition(self, "CONTAINS", value)

    def __repr__(self) -> str:
        return self.name


def col(name: str) -> ColumnRef:
    return ColumnRef(name)


class Condition:
    """A comparison, or AND / OR / NOT over conditions."""

    def __init__(self, lhs: Any, op: str, rhs: Any = None):
        if op in ("AND", "OR", "NOT"):
            if not isinstance(lhs, Condition) or (op != "NOT" and not isinstance(rhs, Condition)):
                raise ValueError(f"{op} takes conditions")
        elif op not in OPERATORS:
            raise ValueError(f"unknown filter operator {op!r}; one of {OPERATORS}, AND, OR, NOT")
        elif lhs is None or rhs is None:
            raise ValueError("a comparison with None has no answer; test for null on the result")
        elif op == "IN":
            if isinstance(rhs, str) or not isinstance(rhs, Iterable):
                raise ValueError("IN takes a list of values")
            rhs = list(rhs)
            if any(v is None for v in rhs):
                raise ValueError("IN takes values that are not None")
        self.lhs, self.op, self.rhs = lhs, op, rhs

    def __and__(self, other: Condition) -> Condition:
        return Condition(self, "AND", other)

    def __or__(self, other: Condition) -> Condition:
        return Condition(self, "OR", other)

    def __invert__(self) -> Condition:
        return Condition(self, "NOT")

    def __bool__(self) -> bool:
        raise TypeError("combine conditions by & | ~, not by and, or, not")

    @property
    def is_leaf(self) -> bool:
        return self.op in OPERATORS

    def is_conjunctive(self) -> bool:
        """Whether the tree has no OR and no NOT."""
        if self.is_leaf:
            return True
        return self.op == "AND" and self.lhs.is_conjunctive() and self.rhs.is_conjunctive()

    def columns(self) -> set[str]:
        parts = (self.lhs, self.rhs)
        names = {x.name for x in parts if isinstance(x, ColumnRef)}
        return names.union(*(x.columns() for x in parts if isinstance(x, Condition)))

    def ordered(self) -> list[set[str]]:
        """The aliases of each two columns that are compared by order."""
        if not self.is_leaf:
            return [p for x in (self.lhs, self.rhs) if isinstance(x, Condition) for p in x.ordered()]
        if self.op in ("<", ">", "<=", ">=") and isinstance(self.lhs, ColumnRef) and isinstance(self.rhs, ColumnRef):
            return [{x.name.partition(".")[0] for x in (self.lhs, self.rhs)}]
        return []

    def compile(self, resolve: Resolve, negated: bool = False) -> Column:
        if self.op == "AND":
            return self.lhs.compile(resolve, negated) & self.rhs.compile(resolve, negated)
        if self.op == "OR":
            return self.lhs.compile(resolve, negated) | self.rhs.compile(resolve, negated)
        if self.op == "NOT":
            if self.lhs.op == "NOT":  # the two cancel out
                return self.lhs.lhs.compile(resolve, negated)
            return ~self.lhs.compile(resolve, True)
        leaf = self._leaf(resolve)
        return F.coalesce(leaf, F.lit(False)) if negated else leaf

    def _leaf(self, resolve: Resolve) -> Column:
        def operand(x: Any) -> tuple[Column, T.DataType | None]:
            return resolve(x.name) if isinstance(x, ColumnRef) else (F.lit(x), None)

        left, kind = operand(self.lhs)
        if self.op == "IN":
            return left.isin(self.rhs)
        right, _ = operand(self.rhs)
        if self.op == "CONTAINS":
            if isinstance(kind, T.ArrayType):
                return F.array_contains(left, right)
            if isinstance(kind, T.MapType):
                return F.map_contains_key(left, right)
            if kind is not None and not isinstance(kind, T.StringType):
                raise ValueError(f"CONTAINS needs text, an array or a map; {self.lhs} is {kind.simpleString()}")
            return left.contains(right)
        return {
            ">": left > right,
            "<": left < right,
            ">=": left >= right,
            "<=": left <= right,
            "=": left == right,
        }[self.op]

    def __repr__(self) -> str:
        if self.op == "NOT":
            return f"NOT ({self.lhs})"
        if self.is_leaf:
            return f"{self.lhs} {self.op} {self.rhs!r}"
        return f"({self.lhs}) {self.op} ({self.rhs})"
