"""Bins of ordered values, as one CASE expression."""

from __future__ import annotations

import datetime
import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import TypeVar

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ColumnDescriptor, ColumnType, literal

#: Types that bins can hold.
BinT = TypeVar("BinT", str, int, float, datetime.date, datetime.datetime)


def type_of(v) -> ColumnType:
    for kind in (ColumnType.INTEGER, ColumnType.DECIMAL, ColumnType.VARCHAR, ColumnType.TIMESTAMP, ColumnType.DATE):
        if kind.accepts(v):
            return kind
    raise ValueError(f"{v!r} has no column type")


def _texts(edges: Sequence, kind: ColumnType) -> list[str]:
    if kind is ColumnType.VARCHAR:
        return [repr(e) for e in edges]
    if kind is ColumnType.DECIMAL:
        for digits in range(2, 17):
            out = [f"{e:.{digits}f}" for e in edges]
            if len(set(out)) == len(out):
                return out
        return [repr(float(e)) for e in edges]
    if kind is ColumnType.TIMESTAMP:
        spec = "microseconds" if any(e.microsecond % 1000 for e in edges) else "milliseconds" if any(e.microsecond for e in edges) else "seconds" if any(e.second for e in edges) else "minutes"
        return [e.isoformat(sep=" ", timespec=spec) for e in edges]
    return [str(e) for e in edges]


@dataclass(frozen=True)
class BinningSpec:
    """Bins between ascending edges.  right: a bin holds its upper edge, else its lower;
    include_both_endpoints: the outer bins hold the outer edges too.  Names can repeat,
    which joins bins.  Null, values outside, and NaN without nan_bin have no bin."""

    bin_edges: Sequence
    names: Sequence | None = None
    right: bool = True
    include_both_endpoints: bool = True
    nan_bin: object = None
    kind: ColumnType = field(init=False)
    name_kind: ColumnType = field(init=False)

    def __post_init__(self):
        edges = list(self.bin_edges)
        if len(edges) < 2:
            raise ValueError("bins need two edges at least")
        kinds = {type_of(e) for e in edges}
        if kinds == {ColumnType.INTEGER, ColumnType.DECIMAL}:
            kinds, edges = {ColumnType.DECIMAL}, [float(e) for e in edges]
        if len(kinds) > 1:
            raise ValueError("edges must be of one type")
        kind = kinds.pop()
        if kind is ColumnType.DECIMAL and any(math.isnan(e) for e in edges):
            raise ValueError("an edge can't be NaN")
        if any(a >= b for a, b in zip(edges, edges[1:])):
            raise ValueError("edges must ascend")
        names = list(self.names) if self.names is not None else self._default(edges, kind)
        if len(names) != len(edges) - 1:
            raise ValueError(f"{len(edges) - 1} bins can't have {len(names)} names")
        name_kinds = {type_of(n) for n in [*names, *([self.nan_bin] if self.nan_bin is not None else [])]}
        if len(name_kinds) > 1:
            raise ValueError("names must be of one type")
        for k, v in (("bin_edges", tuple(edges)), ("names", tuple(names)), ("kind", kind), ("name_kind", name_kinds.pop())):
            object.__setattr__(self, k, v)

    def _default(self, edges, kind) -> list[str]:
        t, n, out = _texts(edges, kind), len(edges) - 1, []
        for i in range(n):
            low = "[" if not self.right or (i == 0 and self.include_both_endpoints) else "("
            high = "]" if self.right or (i == n - 1 and self.include_both_endpoints) else ")"
            out.append(f"{low}{t[i]}, {t[i + 1]}{high}")
        return out

    def bins(self, include_null: bool = False) -> list:
        out = list(dict.fromkeys([*self.names, *([self.nan_bin] if self.nan_bin is not None else [])]))
        return [*out, None] if include_null else out

    def expression(self, c: Column, of: ColumnDescriptor) -> Column:
        if of.column_type is not self.kind and not (of.column_type.numeric and self.kind.numeric):
            raise ValueError(f"bins of {self.kind.value} don't fit a {of.column_type.value} column")
        lit = lambda v: F.lit(v) if self.kind is ColumnType.VARCHAR else literal(v, self.kind)
        name = lambda v: literal(v, self.name_kind)
        e, out = self.bin_edges, None
        case = F.when
        if of.column_type is ColumnType.DECIMAL:
            out = F.when(F.isnan(c), F.lit(None) if self.nan_bin is None else name(self.nan_bin))
            case = out.when
        outside = (c < lit(e[0])) | (c > lit(e[-1]))
        if not self.include_both_endpoints:
            outside = outside | (c == lit(e[0] if self.right else e[-1]))
        out = case(c.isNull() | outside, F.lit(None).cast(self.name_kind.spark))
        for upper, n in zip(e[1:-1], self.names, strict=False):
            out = out.when(c <= lit(upper) if self.right else c < lit(upper), name(n))
        return out.otherwise(name(self.names[-1]))
