"""What of a private table is protected, and limits on what one ID adds to it."""

from __future__ import annotations

from dataclasses import dataclass


def _positive(name: str, n) -> None:
    if isinstance(n, bool) or not isinstance(n, int) or n < 1:
        raise ValueError(f"{name} must be a positive integer, not {n!r}")


class ProtectedChange:
    """Base of the changes that an answer hides."""


@dataclass(frozen=True)
class AddMaxRows(ProtectedChange):
    """Adding or removing any max_rows rows."""

    max_rows: int

    def __post_init__(self):
        _positive("max_rows", self.max_rows)


class AddOneRow(AddMaxRows):
    """Adding or removing one row."""

    def __init__(self):
        super().__init__(1)

    def __repr__(self):
        return "AddOneRow()"


@dataclass(frozen=True)
class AddMaxRowsInMaxGroups(ProtectedChange):
    """Adding or removing max_rows_per_group rows in each of max_groups values of a column."""

    grouping_column: str
    max_groups: int
    max_rows_per_group: int

    def __post_init__(self):
        _positive("max_groups", self.max_groups)
        _positive("max_rows_per_group", self.max_rows_per_group)


@dataclass(frozen=True)
class AddRowsWithID(ProtectedChange):
    """Adding or removing all rows with one ID, over all tables of its ID space."""

    id_column: str
    id_space: str = "default_id_space"

    def __post_init__(self):
        if not self.id_column or not isinstance(self.id_column, str):
            raise ValueError("id_column must be a column name")


class Constraint:
    """A bound on the rows of one ID."""


@dataclass(frozen=True)
class MaxRowsPerID(Constraint):
    max: int

    def __post_init__(self):
        _positive("max", self.max)


@dataclass(frozen=True)
class MaxGroupsPerID(Constraint):
    grouping_column: str
    max: int

    def __post_init__(self):
        _positive("max", self.max)


@dataclass(frozen=True)
class MaxRowsPerGroupPerID(Constraint):
    grouping_column: str
    max: int

    def __post_init__(self):
        _positive("max", self.max)


def simplify(constraints) -> tuple[Constraint, ...]:
    """Of each kind and column the tightest, in a fixed order."""
    best: dict[tuple, Constraint] = {}
    for c in constraints:
        k = (type(c).__name__, getattr(c, "grouping_column", ""))
        if k not in best or c.max < best[k].max:
            best[k] = c
    return tuple(best[k] for k in sorted(best))


class TruncationStrategy:
    """How row-protected tables are bounded before they are joined."""

    @dataclass(frozen=True)
    class DropExcess:
        """At most max_rows rows of each join key, the same whatever the order of the input."""

        max_rows: int

        def __post_init__(self):
            _positive("max_rows", self.max_rows)

        stability, kept = 2, property(lambda self: self.max_rows)

    @dataclass(frozen=True)
    class DropNonUnique:
        """No row of a join key that several rows have."""

        stability, kept = 1, 1
