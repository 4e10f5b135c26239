"""Sessions: private tables behind a ledger that every answer debits."""

from __future__ import annotations

import threading
from collections.abc import Mapping
from dataclasses import replace
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .budgets import ApproxDPBudget, Budget, PureDPBudget, RhoZCDPBudget, rounded
from .builder import QueryBuilder
from .operators.aggregate import Prepared
from .operators.lower import enforce, lower
from .plans.analyze import Catalog, Facts, analyze
from .plans.nodes import Query
from .protection import AddMaxRows, AddMaxRowsInMaxGroups, AddRowsWithID, MaxGroupsPerID, MaxRowsPerGroupPerID, MaxRowsPerID, ProtectedChange
from .schema import KEY_TYPES, ColumnType, coerce, schema_of


class FeatureFlag:
    """A switch that can be turned on, off, and back to its default."""

    def __init__(self, default: bool):
        self._default = self._on = default

    def enable(self):
        self._on = True

    def disable(self):
        self._on = False

    def reset(self):
        self._on = self._default

    def enabled(self) -> bool:
        return self._on

    def disabled(self) -> bool:
        return not self._on


class _Features:
    def __init__(self):
        self.auto_partition_selection = FeatureFlag(False)


class Config:
    """Feature flags, one set for the process."""

    _features = _Features()

    @property
    def features(self) -> _Features:
        return self._features


def _identifier(name: str, what: str) -> str:
    if not isinstance(name, str) or not name.isidentifier():
        raise ValueError(f"the {what} {name!r} is no identifier")
    return name


def _facts(df: DataFrame, change: ProtectedChange, space: str | None) -> Facts:
    s = schema_of(df)
    if isinstance(change, AddMaxRows):
        return Facts(s, rows=Fraction(change.max_rows))
    if isinstance(change, AddMaxRowsInMaxGroups):
        if s[change.grouping_column].column_type not in KEY_TYPES:
            raise ValueError(f"{change.grouping_column!r} can't be a grouping column")
        return Facts(replace(s, grouping_column=change.grouping_column), rows=Fraction(change.max_rows_per_group), groups=Fraction(change.max_groups))
    if isinstance(change, AddRowsWithID):
        if s[change.id_column].column_type not in KEY_TYPES:
            raise ValueError(f"{change.id_column!r} can't be an ID column")
        return Facts(replace(s, id_column=change.id_column, id_space=space))
    raise TypeError(f"{change!r} is no protected change")


class Session:
    """Evaluates queries on private tables while its budget lasts.

    One thread at a time debits and answers.  Sub-sessions of partition_and_create()
    are used in order; using a session again retires those made from it."""

    class Builder:
        def __init__(self):
            self._budget: Budget | None = None
            self._private: dict[str, tuple[DataFrame, ProtectedChange]] = {}
            self._public: dict[str, DataFrame] = {}
            self._spaces: set[str] = set()

        def _free(self, name: str) -> str:
            _identifier(name, "table name")
            if name in self._private or name in self._public:
                raise ValueError(f"there is a table {name!r} already")
            return name

        def with_privacy_budget(self, privacy_budget: Budget):
            if self._budget is not None:
                raise ValueError("the budget is set already")
            self._budget = privacy_budget
            return self

        def with_private_dataframe(self, source_id: str, dataframe: DataFrame, protected_change: ProtectedChange):
            self._private[self._free(source_id)] = (coerce(dataframe), protected_change)
            return self

        def with_public_dataframe(self, source_id: str, dataframe: DataFrame):
            self._public[self._free(source_id)] = coerce(dataframe)
            return self

        def with_id_space(self, id_space: str):
            _identifier(id_space, "ID space")
            if id_space in self._spaces:
                raise ValueError(f"there is an ID space {id_space!r} already")
            self._spaces.add(id_space)
            return self

        def build(self) -> Session:
            if self._budget is None:
                raise ValueError("a session needs a privacy budget")
            if not self._private:
                raise ValueError("a session needs a private table")
            ids = {n: c for n, (_, c) in self._private.items() if isinstance(c, AddRowsWithID)}
            spaces = self._spaces or ({next(iter(ids.values())).id_space} if len(ids) == 1 else set())
            catalog = Catalog()
            for n, (df, c) in self._private.items():
                if n in ids and c.id_space not in spaces:
                    raise ValueError(f"the ID space {c.id_space!r} is not declared")
                catalog.private[n] = (df, _facts(df, c, getattr(c, "id_space", None)))
            for space in spaces:  # a null ID of one table is an ID in all
                own = [n for n, c in ids.items() if c.id_space == space]
                kinds = {catalog.private[n][1].schema[ids[n].id_column].column_type for n in own}
                if len(kinds) > 1:
                    raise ValueError(f"the IDs of {space!r} have several types")
                if any(catalog.private[n][1].schema[ids[n].id_column].allow_null for n in own):
                    for n in own:
                        df, f = catalog.private[n]
                        i = ids[n].id_column
                        catalog.private[n] = (df, replace(f, schema=f.schema.having({i: replace(f.schema[i], allow_null=True)})))
            catalog.public.update(self._public)
            return Session(self._budget, catalog)

    def __init__(self, budget: Budget, catalog: Catalog, parent: Session | None = None):
        if not isinstance(budget, (PureDPBudget, ApproxDPBudget, RhoZCDPBudget)):
            raise TypeError("a budget is pure, approximate or zero-concentrated")
        self._left, self._catalog, self._parent = budget, catalog, parent
        self._children: list[Session] = []
        self._retired = False
        self._views: set[str] = set()
        self._lock = threading.RLock() if parent is None else parent._lock

    @classmethod
    def from_dataframe(cls, privacy_budget: Budget, source_id: str, dataframe: DataFrame, protected_change: ProtectedChange) -> Session:
        b = cls.Builder().with_privacy_budget(privacy_budget).with_private_dataframe(source_id, dataframe, protected_change)
        return b.build()

    # tables

    def _active(self) -> None:
        if self._retired:
            raise RuntimeError("this session is retired: its parent, or a later part, was used")
        for c in self._children:
            c._retire()
        self._children = []
        p = self._parent
        if p is not None:
            p_children = p._children
            at = p_children.index(self) if self in p_children else 0
            for c in p_children[:at]:
                c._retire()

    def _retire(self) -> None:
        self._retired = True
        for c in self._children:
            c._retire()

    def stop(self) -> None:
        """Retire this session and the parts made from it."""
        with self._lock:
            self._retire()

    @property
    def private_sources(self) -> list[str]:
        return list(self._catalog.private)

    @property
    def public_sources(self) -> list[str]:
        return list(self._catalog.public)

    @property
    def public_source_dataframes(self) -> dict[str, DataFrame]:
        return dict(self._catalog.public)

    @property
    def remaining_privacy_budget(self) -> Budget:
        return self._left

    def add_public_dataframe(self, source_id: str, dataframe: DataFrame) -> None:
        _identifier(source_id, "table name")
        if source_id in self._catalog.public or source_id in self._catalog.private:
            raise ValueError(f"there is a table {source_id!r} already")
        self._catalog.public[source_id] = coerce(dataframe)

    def create_view(self, query_expr: QueryBuilder, source_id: str, cache: bool) -> None:
        """A private table derived from others; compiled now, computed when it is read."""
        _identifier(source_id, "table name")
        if source_id in self._catalog.public or source_id in self._catalog.private:
            raise ValueError(f"there is a table {source_id!r} already")
        if not isinstance(query_expr, QueryBuilder):
            raise TypeError("a view is made of transformations")
        with self._lock:
            self._active()
            facts = analyze(query_expr._plan, self._catalog)
            df = lower(query_expr._plan, self._catalog)
            if facts.ids:  # constraints hold for what the view hands on
                for c in facts.constraints:
                    df = enforce(df, facts.schema.id_column, c) if _enforced(query_expr._plan, c) else df
            self._catalog.private[source_id] = (df.persist() if cache else df, facts)
            if cache:
                self._views.add(source_id)

    def delete_view(self, source_id: str) -> None:
        """Drop a view, or a base table: nothing can be asked of it any more."""
        if source_id not in self._catalog.private:
            raise KeyError(f"there is no private table {source_id!r}")
        df, _ = self._catalog.private.pop(source_id)
        if source_id in self._views:
            df.unpersist()
            self._views.discard(source_id)

    def get_schema(self, source_id: str):
        if source_id in self._catalog.public:
            return dict(schema_of(self._catalog.public[source_id]).columns)
        return dict(self._facts_of(source_id).schema.columns)

    def _facts_of(self, source_id: str) -> Facts:
        if source_id not in self._catalog.private:
            raise KeyError(f"there is no private table {source_id!r}")
        return self._catalog.private[source_id][1]

    def get_column_types(self, source_id: str) -> dict[str, ColumnType]:
        return {c: d.column_type for c, d in self.get_schema(source_id).items()}

    def get_grouping_column(self, source_id: str) -> str | None:
        return None if source_id in self._catalog.public else self._facts_of(source_id).schema.grouping_column

    def get_id_column(self, source_id: str) -> str | None:
        return None if source_id in self._catalog.public else self._facts_of(source_id).schema.id_column

    def get_id_space(self, source_id: str) -> str | None:
        return None if source_id in self._catalog.public else self._facts_of(source_id).schema.id_space

    def describe(self, obj=None) -> str:
        """Prints, and returns, what the session or one table, builder or query holds."""
        lines = []
        if obj is None:
            lines.append(f"Remaining budget: {self._left!r}")
            for n in self.private_sources:
                lines += [f"Private table {n}", *_table(self._catalog.private[n][1])]
            for n, df in self._catalog.public.items():
                lines += [f"Public table {n}", *_table(Facts(schema_of(df)))]
        elif isinstance(obj, str):
            lines = _table(self._catalog.private[obj][1] if obj in self._catalog.private else Facts(schema_of(self._catalog.public_table(obj))))
        elif isinstance(obj, Query):
            lines = [f"{obj.kind.value} by {obj.keys if isinstance(obj.keys, tuple) else obj.keys.columns()}", *_table(analyze(obj.child, self._catalog))]
        else:
            lines = _table(analyze(obj._plan, self._catalog))
        text = "\n".join(lines)
        print(text)
        return text

    # answers

    def _asked(self, budget: Budget) -> Budget:
        if isinstance(self._left, ApproxDPBudget) and isinstance(budget, PureDPBudget):
            budget = ApproxDPBudget(budget.parts[0], 0)
        if type(budget) is not type(self._left):
            raise ValueError(f"the session has a {type(self._left).__name__}, not a {type(budget).__name__}")
        if budget.is_zero or budget.parts[0] == 0:
            raise ValueError("an answer needs a budget above zero")
        return rounded(budget, self._left)

    def _debit(self, budget: Budget) -> None:
        if not self._left.covers(budget) and not self._left.is_infinite:
            short = ", ".join(f"{n}: {float(a - b):g} more than is left" for n, a, b in zip(budget.names, budget.parts, self._left.parts, strict=True) if a > b)
            raise RuntimeError(f"{budget!r} was asked for and {self._left!r} is left ({short})")
        self._left = self._left - budget

    def evaluate(self, query_expr: Query, privacy_budget: Budget) -> DataFrame:
        """The noisy answer, drawn once.  The budget is debited before anything is read;
        an error in the query debits nothing."""
        if not isinstance(query_expr, Query):
            raise TypeError("only aggregates can be evaluated")
        with self._lock:
            budget = self._asked(privacy_budget)
            prepared = Prepared(query_expr, self._catalog, budget)
            self._active()
            self._debit(budget)
            return prepared.run()

    def _noise_info(self, query_expr: Query, privacy_budget: Budget) -> list[dict]:
        return Prepared(query_expr, self._catalog, self._asked(privacy_budget)).noise_info()

    def _spend_budget_without_executing(self, privacy_budget: Budget) -> None:
        with self._lock:
            budget = self._asked(privacy_budget)
            self._active()
            self._debit(budget)

    def partition_and_create(self, source_id: str, privacy_budget: Budget, column: str, splits: Mapping[str, str | int]) -> dict[str, Session]:
        """Disjoint parts of a table by values of a column, as sessions with the budget
        each; one debit pays for all (parallel composition)."""
        for name in splits:
            _identifier(name, "part name")
        if not splits:
            raise ValueError("there are no parts")
        with self._lock:
            df, f = self._catalog.private[source_id] if source_id in self._catalog.private else (None, self._facts_of(source_id))
            kind = f.schema[column].column_type
            if kind not in (ColumnType.INTEGER, ColumnType.VARCHAR):
                raise ValueError("parts are made by an integer or text column")
            if any(not kind.accepts(v) for v in splits.values()):
                raise ValueError(f"a part's value must be {kind.value}")
            rest = tuple(c for c in f.constraints if not (isinstance(c, MaxGroupsPerID) and c.grouping_column == column))
            factor = Fraction(1)
            if f.ids:
                g = next((c for c in f.constraints if isinstance(c, MaxGroupsPerID) and c.grouping_column == column), None)
                r = next((c for c in f.constraints if isinstance(c, MaxRowsPerID)), None)
                if g is not None:
                    df, factor, facts = enforce(df, f.schema.id_column, g), Fraction(g.max), replace(f, constraints=rest)
                elif r is not None:
                    df = enforce(df, f.schema.id_column, r)
                    facts = Facts(replace(f.schema, id_column=None, id_space=None), rows=Fraction(r.max))
                else:
                    raise ValueError("an ID's parts must be bounded: MaxGroupsPerID on the column, or MaxRowsPerID")
            elif f.schema.grouping_column == column:
                facts = Facts(replace(f.schema, grouping_column=None), rows=f.rows)
                factor = f.groups
            else:
                facts = f
            budget = self._asked(privacy_budget)
            self._active()
            self._debit(budget)
            # One unit can be in `factor` parts, so each part has that share of the budget.
            own = budget if factor == 1 else budget / factor
            out = {}
            for name, v in splits.items():
                c = Catalog()
                c.private[name] = (df.where(F.col(f"`{column}`").eqNullSafe(F.lit(v))), facts)
                c.public.update(self._catalog.public)
                out[name] = Session(own, c, self)
            self._children = list(out.values())
            return out


def _enforced(plan, constraint) -> bool:
    """Whether the plan itself doesn't truncate to the constraint (joins scale them)."""
    from .plans import nodes as N

    while not isinstance(plan, N.Source):
        if isinstance(plan, N.Enforce) and plan.constraint == constraint:
            return False
        plan = plan.child
    return isinstance(constraint, (MaxRowsPerID, MaxGroupsPerID, MaxRowsPerGroupPerID))


def _table(f: Facts) -> list[str]:
    out = []
    for c, d in f.schema.columns:
        more = [n for n, on in (("null", d.allow_null), ("NaN", d.allow_nan), ("inf", d.allow_inf)) if on]
        more += [n for n, x in (("ID", f.schema.id_column), ("grouping", f.schema.grouping_column)) if x == c]
        out.append(f"  {c}: {d.column_type.value}" + (f" ({', '.join(more)})" if more else ""))
    return out + [f"  {c}" for c in f.constraints]


def check_installation() -> None:
    """A count of three keys, to see that Spark works."""
    from pyspark.sql import SparkSession

    from .keys import KeySet
    from .protection import AddOneRow

    spark = SparkSession.builder.getOrCreate()
    df = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    s = Session.from_dataframe(PureDPBudget.inf(), "t", df, AddOneRow())
    got = dict(tuple(r) for r in s.evaluate(QueryBuilder("t").groupby(KeySet.from_dict({"k": ["a", "b", "c"]})).count(), PureDPBudget.inf()).collect())
    if got != {"a": 1, "b": 2, "c": 0}:
        raise RuntimeError(f"a count went wrong: {got}")
