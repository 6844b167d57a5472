"""Aggregates over plans: count, sum, mean, min and max."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class AggSpec:
    kind: str
    column: str | None = None

    def expression(self, floating: bool = False) -> Column:
        """The aggregate; floating: the column holds floats, in which min and max skip NaN."""
        c = None if self.column is None else F.col(f"`{self.column}`")
        if self.kind == "count":
            return F.count(F.lit(1))
        if self.kind == "sum":  # a group without values sums to 0
            return F.coalesce(F.sum(c), F.lit(0))
        if self.kind == "mean":
            return F.avg(c)
        if self.kind in ("min", "max"):
            return getattr(F, self.kind)(F.when(~F.isnan(c), c) if floating else c)
        raise ValueError(f"unknown aggregate {self.kind!r}")


def count() -> AggSpec:
    return AggSpec("count")


def sum(column: str) -> AggSpec:  # noqa: A001
    return AggSpec("sum", column)


def mean(column: str) -> AggSpec:
    return AggSpec("mean", column)


def min(column: str) -> AggSpec:  # noqa: A001
    return AggSpec("min", column)


def max(column: str) -> AggSpec:  # noqa: A001
    return AggSpec("max", column)
