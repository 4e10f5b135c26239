"""Rewrites of queries before they are lowered: special values, truncation, noise."""

from __future__ import annotations

from dataclasses import dataclass, replace
from fractions import Fraction

from ..budgets import ApproxDPBudget, Budget, PureDPBudget, RhoZCDPBudget
from ..operators.noise import Noise, NoiseSpec
from ..protection import MaxGroupsPerID, MaxRowsPerGroupPerID, MaxRowsPerID, simplify
from ..schema import ColumnType
from . import nodes as N
from .analyze import Catalog, Facts, analyze
from .nodes import Kind, Mechanism

NUMERIC = (Kind.SUM, Kind.AVERAGE, Kind.VARIANCE, Kind.STDEV, Kind.QUANTILE, Kind.BOUNDS)


@dataclass(frozen=True)
class Distance:
    """What one unit of protection can change: `rows` rows in each of `groups` groups.
    l2: group keys hold the column that the groups are of."""

    rows: Fraction
    groups: Fraction
    l2: bool

    @property
    def total(self) -> Fraction:
        return self.rows * self.groups

    @property
    def squared(self) -> Fraction:
        return self.groups * self.rows**2 if self.l2 else self.total**2


def clean(q: N.Query, catalog: Catalog) -> N.Query:
    """Rows without a measure go first.  Infinities are clamped with the rest, but for
    bounds, which have nothing to clamp to and drop them."""
    if q.kind not in NUMERIC:
        return q
    d = analyze(q.child, catalog).schema[q.column]
    child = N.DropNullNan(q.child, (q.column,)) if d.open else q.child
    if q.kind is Kind.BOUNDS and d.allow_inf:
        child = N.DropInf(child, (q.column,))
    return replace(q, child=child)


def distinct_ids(q: N.Query, catalog: Catalog) -> N.Query:
    """count_distinct of just the ID is a count of one row an ID (or an ID and group)."""
    f = analyze(q.child, catalog)
    if q.kind is not Kind.COUNT_DISTINCT or not f.ids or (q.columns or tuple(f.schema.names)) != (f.schema.id_column,):
        return q
    keys = group_columns(q)
    g = next((c for c in f.constraints if isinstance(c, MaxGroupsPerID) and keys == [c.grouping_column]), None)
    one = MaxRowsPerGroupPerID(g.grouping_column, 1) if g else MaxRowsPerID(1)
    if not g and keys:
        # An ID can be in many groups; one row of it would stand in one of them only.
        return q
    return replace(q, kind=Kind.COUNT, child=N.Enforce(q.child, one), columns=None)


def group_columns(q: N.Query) -> list[str]:
    return list(q.keys) if isinstance(q.keys, (list, tuple)) else q.keys.columns()


def choose_truncation(f: Facts, keys: list[str], zcdp: bool) -> tuple[tuple, Distance]:
    """The cheapest usable set of constraints; ties go to rows per ID, then by column."""
    cons, options = simplify(f.constraints), []
    for c in cons:
        if isinstance(c, MaxRowsPerID):
            options.append(((c,), Distance(Fraction(c.max), Fraction(1), False)))
        if isinstance(c, MaxGroupsPerID):
            for r in cons:
                if isinstance(r, MaxRowsPerGroupPerID) and r.grouping_column == c.grouping_column:
                    options.append(((c, r), Distance(Fraction(r.max), Fraction(c.max), c.grouping_column in keys)))
    if not options:
        raise RuntimeError("the rows of an ID are not bounded: enforce MaxRowsPerID, or MaxGroupsPerID and MaxRowsPerGroupPerID on one column")
    return min(options, key=lambda o: (o[1].squared if zcdp else o[1].total, len(o[0]), str(o[0])))


def distance_of(f: Facts, keys: list[str], kind: Kind, zcdp: bool) -> tuple[tuple, Distance]:
    if f.ids:
        return choose_truncation(f, keys, zcdp)
    g = f.schema.grouping_column
    if g and g not in keys and kind not in (Kind.GROUPS, Kind.BOUNDS):
        raise ValueError(f"the grouping column {g!r} must be among the group keys")
    return (), Distance(f.rows, f.groups, bool(g) and g in keys and kind not in (Kind.GROUPS, Kind.BOUNDS))


def mechanism(q: N.Query, budget: Budget, whole: bool) -> tuple[Mechanism, Budget]:
    """Family of the noise, and the budget it uses (pure noise leaves delta)."""
    gaussian = isinstance(budget, RhoZCDPBudget) if q.mechanism is Mechanism.DEFAULT else q.mechanism is Mechanism.GAUSSIAN
    if gaussian and not isinstance(budget, RhoZCDPBudget):
        raise ValueError("Gaussian noise needs a zero-concentrated budget")
    return (Mechanism.GAUSSIAN if gaussian else Mechanism.LAPLACE), budget


def spec(family: Mechanism, budget: Budget, share: Fraction, d: Distance, width: Fraction, whole: bool) -> NoiseSpec:
    """Noise for a sum of values of at most `width`, with a share of the budget."""
    if budget.is_infinite:
        return NoiseSpec(Noise.NONE, 0)
    part = budget.parts[0] * share
    if family is Mechanism.GAUSSIAN:
        return NoiseSpec(Noise.DISCRETE_GAUSSIAN if whole else Noise.GAUSSIAN, d.squared * width**2 / (2 * part))
    if isinstance(budget, RhoZCDPBudget):
        # Laplace under zCDP: epsilon ** 2 / 2 = rho.
        import math

        eps = Fraction(math.isqrt(int(2 * part * 10**24)), 10**12)
        return NoiseSpec(Noise.GEOMETRIC if whole else Noise.LAPLACE, d.total * width / eps)
    return NoiseSpec(Noise.GEOMETRIC if whole else Noise.LAPLACE, d.total * width / part)


@dataclass(frozen=True)
class Noisy:
    """One noisy number that a query needs, with the constant it is centred on."""

    what: str
    spec: NoiseSpec


def midpoint(low, high, whole: bool):
    """Of integers the upper of the two middle ones."""
    return -((-int(low) - int(high)) // 2) if whole else (low + high) / 2


def measures(q: N.Query, f: Facts, budget: Budget, d: Distance) -> list[Noisy]:
    whole = q.column is None or f.schema[q.column].column_type is ColumnType.INTEGER
    fam, b = mechanism(q, budget, whole)
    one = Fraction(1)
    if q.kind in (Kind.COUNT, Kind.COUNT_DISTINCT):
        return [Noisy("count", spec(fam, b, one, d, one, True))]
    if q.kind is Kind.SUM:
        width = max(abs(Fraction(q.low)), abs(Fraction(q.high)))
        return [Noisy("sum", spec(fam, b, one, d, width, whole))]
    if q.kind in (Kind.AVERAGE, Kind.VARIANCE, Kind.STDEV):
        mid = Fraction(midpoint(q.low, q.high, whole))
        width = max(abs(Fraction(q.low) - mid), abs(Fraction(q.high) - mid))
        if q.kind is Kind.AVERAGE:
            half = Fraction(1, 2)
            return [Noisy("sum", spec(fam, b, half, d, width, whole)), Noisy("count", spec(fam, b, half, d, one, True))]
        third = Fraction(1, 3)
        return [Noisy("sum", spec(fam, b, third, d, width, whole)), Noisy("squares", spec(fam, b, third, d, width**2, whole)), Noisy("count", spec(fam, b, third, d, one, True))]
    if q.kind is Kind.QUANTILE:
        eps = budget.parts[0]
        if isinstance(budget, RhoZCDPBudget) and not budget.is_infinite:
            import math

            eps = math.sqrt(8 * eps)
        return [Noisy("quantile", NoiseSpec(Noise.EXPONENTIAL, eps))]
    if q.kind is Kind.BOUNDS:
        return [Noisy("bounds", spec(Mechanism.GAUSSIAN if isinstance(b, RhoZCDPBudget) else Mechanism.LAPLACE, b, one, d, one, True))]
    if not isinstance(budget, ApproxDPBudget):
        raise ValueError("finding groups needs an approximate budget")
    if not budget.is_infinite and not budget.parts[1]:
        raise ValueError("finding groups needs a delta above zero")
    return [Noisy("groups", spec(Mechanism.LAPLACE, b, one, d, one, True))]


def split_for_detection(budget: Budget) -> tuple[Budget, Budget]:
    """Half of epsilon and all of delta find keys; the other half aggregates."""
    if not isinstance(budget, ApproxDPBudget):
        raise ValueError("detecting keys needs an approximate budget")
    e, d = budget.parts
    if budget.is_infinite:
        return budget, budget
    return ApproxDPBudget(e / 2, d), PureDPBudget(e / 2)
