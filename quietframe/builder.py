"""Fluent, immutable query builders: every method returns a new one."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame

from .functions.binning import BinningSpec
from .keys import KeySet
from .plans import nodes as N
from .plans.nodes import GroupbyCountQuery, Kind, Mechanism, Query
from .protection import Constraint
from .schema import descriptor


def _names(columns) -> tuple[str, ...]:
    return (columns,) if isinstance(columns, str) else tuple(columns or ())


def _bounds(low, high) -> tuple:
    for v in (low, high):
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            raise TypeError("bounds must be numbers")
    if not low < high:
        raise ValueError(f"the lower bound {low} must be below the upper bound {high}")
    return (low, high) if isinstance(low, int) and isinstance(high, int) else (float(low), float(high))


class _Aggregates:
    """Aggregates of a plan by keys; shared by both builders."""

    _plan: N.Plan

    def _keys(self):
        raise NotImplementedError

    def _query(self, kind: Kind, name: str, **more) -> Query:
        return Query(self._plan, kind, self._keys(), name, **more)

    def count(self, name: str | None = None, mechanism="default") -> Query:
        return self._query(Kind.COUNT, name or "count", mechanism=Mechanism.of(mechanism))

    def count_distinct(self, columns: Sequence[str] | str | None = None, name: str | None = None, mechanism="default") -> Query:
        cols = _names(columns)
        return self._query(Kind.COUNT_DISTINCT, name or ("count_distinct" + (f"({', '.join(cols)})" if cols else "")), columns=cols or None, mechanism=Mechanism.of(mechanism))

    def _bounded(self, kind: Kind, column: str, low, high, name: str | None, mechanism) -> Query:
        low, high = _bounds(low, high)
        return self._query(kind, name or f"{column}_{kind.value}", column=column, low=low, high=high, mechanism=Mechanism.of(mechanism))

    def sum(self, column: str, low, high, name: str | None = None, mechanism="default") -> Query:
        return self._bounded(Kind.SUM, column, low, high, name, mechanism)

    def average(self, column: str, low, high, name: str | None = None, mechanism="default") -> Query:
        return self._bounded(Kind.AVERAGE, column, low, high, name, mechanism)

    def variance(self, column: str, low, high, name: str | None = None, mechanism="default") -> Query:
        return self._bounded(Kind.VARIANCE, column, low, high, name, mechanism)

    def stdev(self, column: str, low, high, name: str | None = None, mechanism="default") -> Query:
        return self._bounded(Kind.STDEV, column, low, high, name, mechanism)

    def quantile(self, column: str, quantile: float, low, high, name: str | None = None) -> Query:
        if isinstance(quantile, bool) or not isinstance(quantile, (int, float)) or not 0 <= quantile <= 1:
            raise ValueError("a quantile is between 0 and 1")
        low, high = _bounds(low, high)
        return self._query(Kind.QUANTILE, name or f"{column}_quantile({quantile})", column=column, low=low, high=high, quantile=float(quantile))

    def min(self, column: str, low, high, name: str | None = None) -> Query:
        return self.quantile(column, 0, low, high, name or f"{column}_min")

    def max(self, column: str, low, high, name: str | None = None) -> Query:
        return self.quantile(column, 1, low, high, name or f"{column}_max")

    def median(self, column: str, low, high, name: str | None = None) -> Query:
        return self.quantile(column, 0.5, low, high, name or f"{column}_median")

    def get_bounds(self, column: str, lower_bound_column: str | None = None, upper_bound_column: str | None = None) -> Query:
        names = (lower_bound_column or f"{column}_lower_bound", upper_bound_column or f"{column}_upper_bound")
        if names[0] == names[1]:
            raise ValueError("the bounds need two names")
        return self._query(Kind.BOUNDS, "", column=column, names=names)


@dataclass(frozen=True)
class GroupedQueryBuilder(_Aggregates):
    _plan: N.Plan
    keys: object

    def _keys(self):
        return self.keys

    def count(self, name: str | None = None, mechanism="default") -> GroupbyCountQuery:
        return GroupbyCountQuery(self._plan, Kind.COUNT, self.keys, name or "count", mechanism=Mechanism.of(mechanism))


@dataclass(frozen=True)
class QueryBuilder(_Aggregates):
    """Transformations of one private table, then an aggregate."""

    source_id: str
    plan: N.Plan | None = None

    def __post_init__(self):
        if self.plan is None:
            object.__setattr__(self, "plan", N.Source(self.source_id))

    @property
    def _plan(self) -> N.Plan:
        return self.plan

    def _keys(self):
        return KeySet.from_dict({})

    def _with(self, plan: N.Plan) -> QueryBuilder:
        return replace(self, plan=plan)

    def clone(self) -> QueryBuilder:
        return self

    def rename(self, column_mapper: Mapping[str, str]) -> QueryBuilder:
        return self._with(N.Rename(self._plan, tuple(column_mapper.items())))

    def filter(self, condition: str) -> QueryBuilder:
        if not isinstance(condition, str) or not condition:
            raise TypeError("a condition is a SQL expression, as text")
        return self._with(N.Where(self._plan, condition))

    def select(self, columns: Sequence[str] | str) -> QueryBuilder:
        if not _names(columns):
            raise ValueError("no column is selected")
        return self._with(N.Select(self._plan, _names(columns)))

    def map(self, f: Callable, new_column_types: Mapping, augment: bool = False) -> QueryBuilder:
        return self._with(N.MapRows(self._plan, f, _declared(new_column_types), augment))

    def derive(self, expressions: Mapping[str, str | Column], new_column_types: Mapping) -> QueryBuilder:
        """map(augment=True) by SQL expressions, which stay in Catalyst."""
        types = dict(_declared(new_column_types))
        if set(types) != set(expressions):
            raise ValueError("each new column needs an expression and a type")
        return self._with(N.Derive(self._plan, tuple((c, e, types[c]) for c, e in expressions.items())))

    def flat_map(self, f: Callable, new_column_types: Mapping, augment: bool = False, grouping: bool = False, max_rows: int | None = None) -> QueryBuilder:
        if max_rows is not None and (isinstance(max_rows, bool) or not isinstance(max_rows, int) or max_rows < 0):
            raise ValueError("max_rows must be a non-negative integer")
        return self._with(N.FlatMap(self._plan, f, _declared(new_column_types), augment, grouping, max_rows))

    def flat_map_by_id(self, f: Callable, new_column_types: Mapping) -> QueryBuilder:
        return self._with(N.FlatMapByID(self._plan, f, _declared(new_column_types)))

    def bin_column(self, column: str, spec: BinningSpec, name: str | None = None) -> QueryBuilder:
        return self._with(N.BinColumn(self._plan, column, spec, name or f"{column}_binned"))

    def join_public(self, public_table: DataFrame | str, join_columns: Sequence[str] | None = None, how: str = "inner") -> QueryBuilder:
        return self._with(N.JoinPublic(self._plan, public_table, None if join_columns is None else _names(join_columns), how))

    def join_private(self, right_operand: QueryBuilder | str, truncation_strategy_left=None, truncation_strategy_right=None, join_columns: Sequence[str] | None = None) -> QueryBuilder:
        right = QueryBuilder(right_operand) if isinstance(right_operand, str) else right_operand
        return self._with(N.JoinPrivate(self._plan, right._plan, truncation_strategy_left, truncation_strategy_right, None if join_columns is None else _names(join_columns)))

    def replace_null_and_nan(self, replace_with: Mapping | None = None) -> QueryBuilder:
        return self._with(N.ReplaceNullNan(self._plan, tuple((replace_with or {}).items())))

    def replace_infinity(self, replace_with: Mapping | None = None) -> QueryBuilder:
        return self._with(N.ReplaceInf(self._plan, tuple((c, tuple(v)) for c, v in (replace_with or {}).items())))

    def drop_null_and_nan(self, columns: Sequence[str] | None = None) -> QueryBuilder:
        return self._with(N.DropNullNan(self._plan, _names(columns)))

    def drop_infinity(self, columns: Sequence[str] | None = None) -> QueryBuilder:
        return self._with(N.DropInf(self._plan, _names(columns)))

    def enforce(self, constraint: Constraint) -> QueryBuilder:
        if not isinstance(constraint, Constraint):
            raise TypeError(f"{constraint!r} is no constraint")
        return self._with(N.Enforce(self._plan, constraint))

    def get_groups(self, columns: Sequence[str] | None = None) -> Query:
        return Query(self._plan, Kind.GROUPS, KeySet.from_dict({}), columns=_names(columns) or None)

    def histogram(self, column: str, bin_edges: Sequence | BinningSpec, name: str | None = None) -> Query:
        spec = bin_edges if isinstance(bin_edges, BinningSpec) else BinningSpec(bin_edges)
        bins = name or f"{column}_binned"
        return self.bin_column(column, spec, bins).groupby(KeySet.from_dict({bins: spec.bins()})).count()

    def groupby(self, by: KeySet | Sequence[str] | str) -> GroupedQueryBuilder:
        if not isinstance(by, KeySet):
            from .session import Config

            if not Config().features.auto_partition_selection.enabled():
                raise ValueError("grouping by column names needs the feature auto_partition_selection")
            by = _names(by)
        return GroupedQueryBuilder(self._plan, by)


def _declared(types: Mapping) -> tuple:
    return tuple((c, descriptor(t, udf=True)) for c, t in types.items())
