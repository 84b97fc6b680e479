"""The fluent, immutable plan of a left-deep join chain."""

from __future__ import annotations

import time
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leftdeep.functions.conditions import Condition
from leftdeep.operators.keys import all_equal, comparable
from leftdeep.operators.strategy import dealt_join, hinted, pieces, rangeable, ranged_join, theta_join
from leftdeep.plans.model import JoinStep, TableRef
from leftdeep.plans.naming import full_name, printable
from leftdeep.sources.json_lines import write_json_lines
from leftdeep.sources.resolver import Source


@dataclass(frozen=True)
class Timings:
    """Seconds of one run: reading files (the tasks' time, spread over all cores), the whole
    plan, and the rest, which is the joins'."""

    scan: float
    total: float

    @property
    def join(self) -> float:
        return max(0.0, self.total - self.scan)


@dataclass(frozen=True)
class JoinPlan:
    """Each call returns a new plan; nothing runs until its DataFrame is used.

    ``origin``: see Source. Selections and filters may be given in any order; filters
    are AND-ed and apply after the last join, as WHERE does.
    """

    spark: SparkSession
    origin: Mapping[str, DataFrame] | str | None = None
    steps: tuple[JoinStep, ...] = ()
    selected: tuple[tuple[str, tuple[str, ...]], ...] = ()
    filters: tuple[Condition, ...] = ()

    def _joined(self, how: str, left: TableRef, right: TableRef, op: str, options: dict[str, Any]) -> JoinPlan:
        step = JoinStep(left, right, how, op, **options)
        names = [self.steps[0].left.name, *(s.right.name for s in self.steps)] if self.steps else [left.name]
        if self.steps and left.name not in names:
            raise ValueError(f"{left.name!r} is not joined yet; joined: {names}")
        if right.name in names:
            raise ValueError(f"{right.name!r} is already in the chain; give it an alias")
        return replace(self, steps=(*self.steps, step))

    def join(self, left: TableRef, right: TableRef, op: str = "=", **options: Any) -> JoinPlan:
        """``options``: null_safe, coerce_numeric, strategy (see JoinStep)."""
        return self._joined("inner", left, right, op, options)

    def left_join(self, left: TableRef, right: TableRef, op: str = "=", **options: Any) -> JoinPlan:
        return self._joined("left", left, right, op, options)

    def right_join(self, left: TableRef, right: TableRef, op: str = "=", **options: Any) -> JoinPlan:
        return self._joined("right", left, right, op, options)

    def full_outer_join(self, left: TableRef, right: TableRef, op: str = "=", **options: Any) -> JoinPlan:
        return self._joined("full", left, right, op, options)

    def select(self, alias: str, columns: Iterable[str]) -> JoinPlan:
        """Keep these columns of ``alias``; repeated calls add up. Tables without a
        selection keep all of theirs."""
        return replace(self, selected=(*self.selected, (alias, tuple(columns))))

    def filter_by(self, condition: Condition) -> JoinPlan:
        return replace(self, filters=(*self.filters, condition))

    def _selection(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for alias, columns in self.selected:
            out[alias] = list(dict.fromkeys([*out.get(alias, []), *columns]))
        return out

    def _tables(self) -> dict[str, DataFrame]:
        """Each table of the chain with its columns renamed; checks every name first."""
        if not self.steps:
            raise ValueError("the plan has no join")
        source = Source(self.spark, self.origin)
        refs = [self.steps[0].left, *(s.right for s in self.steps)]
        raw = {r.name: source.table(r.table) for r in refs}
        chosen = self._selection()
        for alias, columns in chosen.items():
            if alias not in raw:
                raise ValueError(f"select names {alias!r}, which is not joined; joined: {list(raw)}")
            for c in columns:
                self._known(raw, alias, c)
        for step in self.steps:
            for alias, keys in ((step.left.name, step.left.keys), (step.right.name, step.right_keys)):
                for c in keys:
                    self._known(raw, alias, c)
                    if alias in chosen and c not in chosen[alias]:
                        raise ValueError(f"the join key {alias}.{c} must be among the selected columns")
        for condition in self.filters:
            for name in condition.columns():
                alias, _, c = name.partition(".")
                if alias not in raw:
                    raise ValueError(f"a filter names {alias!r}, which is not joined; joined: {list(raw)}")
                self._known(raw, alias, c)
        return {a: df.select([F.col(f"`{c}`").alias(full_name(a, c)) for c in df.columns]) for a, df in raw.items()}

    @staticmethod
    def _known(tables: dict[str, DataFrame], alias: str, column: str) -> None:
        if column not in tables[alias].columns:
            raise ValueError(f"{alias} has no column {column!r}; it has {tables[alias].columns}")

    def to_df(self) -> DataFrame:
        tables = self._tables()

        def key(alias: str, column: str) -> tuple[Column, T.DataType]:
            name = full_name(alias, column)
            return F.col(f"`{name}`"), tables[alias].schema[name].dataType

        def add(left: DataFrame, step: JoinStep) -> DataFrame:
            right = hinted(tables[step.right.name], step.strategy)
            lefts = [key(step.left.name, c) for c in step.left.keys]
            rights = [key(step.right.name, c) for c in step.right_keys]
            cond = all_equal(lefts, rights, step.op, step.null_safe, step.coerce_numeric)
            derived = step is not self.steps[0]
            streams = left.isStreaming or right.isStreaming
            free = step.how == "inner" and step.strategy is None and not streams
            if step.op in ("=", "<=>") or streams:
                return dealt_join(left, right, cond, derived) if free and self._narrowed(step) else left.join(right, cond, step.how)
            keys = comparable(lefts[0], rights[0], step.op, step.coerce_numeric)
            kinds = (T.DoubleType(), T.DoubleType()) if step.coerce_numeric else (lefts[0][1], rights[0][1])
            if free and step.op != "!=" and rangeable(*kinds) and pieces(left, right):
                return ranged_join(left, right, cond, step.op, tuple(zip(keys, kinds, strict=True)), derived)
            return theta_join(left, right, cond, step.how, step.op, keys, step.null_safe, step.strategy == "nested_loop", derived)

        out = reduce(add, self.steps, tables[self.steps[0].left.name])
        for condition in self.filters:
            out = out.where(condition.compile(lambda name: key(*name.split(".", 1))))
        chosen = self._selection()
        names = [
            full_name(a, c)
            for a, df in tables.items()
            for c in (chosen.get(a) or [n[len(a) + 2 :] for n in df.columns])
        ]
        return out.select([F.col(f"`{n}`") for n in names])

    def _narrowed(self, step: JoinStep) -> bool:
        """Whether a filter compares the table that is joined with an earlier one by order, as
        is asked of keys that repeat on both sides."""
        names = [self.steps[0].left.name, *(s.right.name for s in self.steps)]
        earlier = set(names[: names.index(step.right.name)])
        pairs = [pair for condition in self.filters for pair in condition.ordered()]
        return any(step.right.name in pair and pair & earlier for pair in pairs)

    def save_json(self, path: str, mode: str = "overwrite") -> None:
        write_json_lines(self.to_df(), path, mode)

    def display(self, batch: int = 10_000, out: Any = print) -> None:
        """Print the result as grids of ``batch`` rows, columns named ``column [alias]``."""
        from leftdeep.operators.display import print_grid

        df = self.to_df()
        print_grid(df.toDF(*[printable(c) for c in df.columns]), batch, out)

    def explain(self, mode: str = "formatted") -> None:
        self.to_df().explain(mode)

    def timings(self) -> Timings:
        """Runs the plan once, into nothing, and takes the times from that run."""
        began = time.perf_counter()
        run = self.to_df()._jdf.queryExecution()
        run.toRdd().count()
        total = time.perf_counter() - began
        cores = max(1, self.spark.sparkContext.defaultParallelism)
        return Timings(min(total, _scan_seconds(run.executedPlan()) / cores), total)


def _scan_seconds(plan: Any) -> float:
    """Seconds that the tasks of a plan that has run spent in its file scans, all added up."""
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return _scan_seconds(plan.executedPlan())
    if plan.getClass().getSimpleName().endswith("QueryStageExec"):
        return _scan_seconds(plan.plan())
    own = plan.metrics().get("scanTime")
    children = plan.children()
    return (own.get().value() / 1000 if own.isDefined() else 0.0) + sum(_scan_seconds(children.apply(i)) for i in range(children.size()))
