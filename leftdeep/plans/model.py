"""The immutable pieces a join chain is made of."""

from __future__ import annotations

from dataclasses import dataclass

JOIN_TYPES = ("inner", "left", "right", "full")
COMPARISONS = ("=", "<=>", "<", ">", "<=", ">=", "!=")
STRATEGIES = (None, "broadcast", "merge", "shuffle_hash", "nested_loop")


@dataclass(frozen=True)
class TableRef:
    """A table, the key that it is joined on, and the name it goes by in the chain.

    ``key`` is a column name or a tuple of them. On the right side of a join it
    may be omitted and is then the left side's key.
    """

    table: str
    key: str | tuple[str, ...] | None = None
    alias: str | None = None

    def __post_init__(self) -> None:
        if "__" in self.name or "." in self.name:
            raise ValueError(f"{self.name!r} has a dot or a double underscore; give it an alias without")

    @property
    def name(self) -> str:
        return self.alias or self.table

    @property
    def keys(self) -> tuple[str, ...]:
        if self.key is None:
            return ()
        return (self.key,) if isinstance(self.key, str) else tuple(self.key)


@dataclass(frozen=True)
class JoinStep:
    """One binary join: whatever is already joined, with ``right``."""

    left: TableRef
    right: TableRef
    how: str = "inner"
    op: str = "="
    null_safe: bool = False
    coerce_numeric: bool = False
    strategy: str | None = None

    def __post_init__(self) -> None:
        if self.how not in JOIN_TYPES:
            raise ValueError(f"unknown join type {self.how!r}; one of {JOIN_TYPES}")
        if self.op not in COMPARISONS:
            raise ValueError(f"unknown join operator {self.op!r}; one of {COMPARISONS}")
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy!r}; one of {STRATEGIES}")
        if not self.left.keys:
            raise ValueError(f"the left table {self.left.name!r} needs a join key")
        if len(self.left.keys) != len(self.right_keys):
            raise ValueError(f"keys differ in length: {self.left.keys} and {self.right_keys}")
        if len(self.left.keys) > 1 and self.op not in ("=", "<=>"):
            raise ValueError(f"a composite key can only be compared by = or <=>, not {self.op}")

    @property
    def right_keys(self) -> tuple[str, ...]:
        return self.right.keys or self.left.keys
