"""Printing a DataFrame as text grids, one batch of rows at a time."""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame


def grid(header: list[str], rows: list[list[str]]) -> str:
    wide = [max(len(r[i]) for r in [header, *rows]) for i in range(len(header))]
    rule = "+" + "+".join("-" * (w + 2) for w in wide) + "+"
    line = lambda r: "|" + "|".join(f" {x:<{w}} " for x, w in zip(r, wide, strict=True)) + "|"
    return "\n".join([rule, line(header), rule, *map(line, rows), rule])


def print_grid(df: DataFrame, batch: int = 10_000, out: Callable[[str], Any] = print) -> None:
    rows = df.toLocalIterator(prefetchPartitions=False)
    shown = False
    while part := [["" if v is None else str(v) for v in r] for r in islice(rows, batch)]:
        out(grid(df.columns, part))
        shown = True
    if not shown:
        out("EMPTY RESULT SET")
