"""Logical plan: frozen nodes, each with its child."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame


class Plan:
    """Base of transformations."""


@dataclass(frozen=True)
class Source(Plan):
    name: str


@dataclass(frozen=True)
class Rename(Plan):
    child: Plan
    names: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Where(Plan):
    child: Plan
    condition: str


@dataclass(frozen=True)
class Select(Plan):
    child: Plan
    columns: tuple[str, ...]


@dataclass(frozen=True)
class MapRows(Plan):
    child: Plan
    f: Callable
    new: tuple
    augment: bool


@dataclass(frozen=True)
class Derive(Plan):
    """Columns from expressions that stay in Catalyst: (name, expression, descriptor)."""

    child: Plan
    new: tuple


@dataclass(frozen=True)
class FlatMap(Plan):
    child: Plan
    f: Callable
    new: tuple
    augment: bool
    grouping: bool
    max_rows: int | None


@dataclass(frozen=True)
class FlatMapByID(Plan):
    child: Plan
    f: Callable
    new: tuple


@dataclass(frozen=True)
class BinColumn(Plan):
    child: Plan
    column: str
    spec: Any
    name: str


@dataclass(frozen=True)
class JoinPublic(Plan):
    child: Plan
    table: str | DataFrame
    on: tuple[str, ...] | None
    how: str


@dataclass(frozen=True)
class JoinPrivate(Plan):
    child: Plan
    right: Plan
    left_strategy: Any
    right_strategy: Any
    on: tuple[str, ...] | None


@dataclass(frozen=True)
class ReplaceNullNan(Plan):
    child: Plan
    values: tuple[tuple[str, Any], ...]


@dataclass(frozen=True)
class ReplaceInf(Plan):
    child: Plan
    values: tuple[tuple[str, tuple[float, float]], ...]


@dataclass(frozen=True)
class DropNullNan(Plan):
    child: Plan
    columns: tuple[str, ...]


@dataclass(frozen=True)
class DropInf(Plan):
    child: Plan
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Enforce(Plan):
    child: Plan
    constraint: Any


class Kind(Enum):
    COUNT = "count"
    COUNT_DISTINCT = "count_distinct"
    SUM = "sum"
    AVERAGE = "average"
    VARIANCE = "variance"
    STDEV = "stdev"
    QUANTILE = "quantile"
    BOUNDS = "bounds"
    GROUPS = "groups"


class Mechanism(Enum):
    DEFAULT = "DEFAULT"
    LAPLACE = "LAPLACE"
    GAUSSIAN = "GAUSSIAN"

    @classmethod
    def of(cls, x) -> Mechanism:
        return x if isinstance(x, Mechanism) else cls[str(x).upper()]


@dataclass(frozen=True)
class Query:
    """An aggregate: what Session.evaluate() takes.  keys: KeySet, or names of columns
    whose values are to be detected."""

    child: Plan
    kind: Kind
    keys: Any
    name: str = ""
    column: str | None = None
    columns: tuple[str, ...] | None = None
    low: float | None = None
    high: float | None = None
    quantile: float | None = None
    names: tuple[str, str] | None = None
    mechanism: Mechanism = Mechanism.DEFAULT
    threshold: float | None = None

    def suppress(self, threshold: float) -> Query:
        """Keep the rows whose noisy count is at least `threshold`; grouped counts only."""
        from dataclasses import replace

        if self.kind is not Kind.COUNT:
            raise ValueError("only counts can be suppressed")
        if isinstance(threshold, bool) or not isinstance(threshold, (int, float)):
            raise TypeError("the threshold must be a number")
        return replace(self, threshold=threshold)

    def _is_equivalent(self, other) -> bool:
        """Structural equality; key sets are compared by content."""
        return isinstance(other, Query) and self == other


@dataclass(frozen=True)
class GroupbyCountQuery(Query):
    """A count by keys, whose small rows suppress() can leave out."""
