"""Join conditions: plain, null-safe or numeric-coerced, over one key or several."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key's Column and its type.
Key = tuple[Column, T.DataType]


def _coerced(left: Key, right: Key, op: str) -> tuple[Column, Column]:
    """Both as double. For equality, text that is no number stays comparable as text;
    each side's expression uses that side only, so it remains an equi-join."""
    if op in ("=", "<=>", "!="):
        one = lambda c: F.coalesce(c.cast("string").try_cast("double").cast("string"), c.cast("string"))
    else:
        one = lambda c: c.cast("string").try_cast("double")
    return one(left[0]), one(right[0])


def _check_types(left: Key, right: Key) -> None:
    text = [isinstance(k[1], (T.StringType, T.VarcharType, T.CharType)) for k in (left, right)]
    number = [isinstance(k[1], T.NumericType) for k in (left, right)]
    if (text[0] and number[1]) or (number[0] and text[1]):
        raise ValueError("text is compared with numbers: give coerce_numeric=True")


def comparable(left: Key, right: Key, op: str, coerce_numeric: bool = False) -> tuple[Column, Column]:
    """The two expressions that are compared."""
    if coerce_numeric:
        return _coerced(left, right, op)
    _check_types(left, right)
    return left[0], right[0]


def compare(left: Key, right: Key, op: str, null_safe: bool = False, coerce_numeric: bool = False) -> Column:
    """Null keys never match, unless ``null_safe`` (or ``<=>``): then null equals null."""
    a, b = comparable(left, right, op, coerce_numeric)
    if op == "<=>" or (op == "=" and null_safe):
        return a.eqNullSafe(b)
    if op == "!=":
        return ~a.eqNullSafe(b) if null_safe else a != b
    return {"=": a == b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]


def all_equal(lefts: Sequence[Key], rights: Sequence[Key], op: str, null_safe: bool, coerce: bool) -> Column:
    cond = compare(lefts[0], rights[0], op, null_safe, coerce)
    for a, b in zip(lefts[1:], rights[1:], strict=True):
        cond = cond & compare(a, b, op, null_safe, coerce)
    return cond
