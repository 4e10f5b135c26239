"""Key sets: relations of distinct group keys, with their own algebra.

A key set is a small logical tree.  Building one rewrites it (projections go into
the factors of products and drop those they don't need, products are flattened,
small products of literals are made on the driver); the DataFrame is built when it
is first asked for, and Catalyst plans the rest."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.binning import type_of
from .operators.joins import null_safe_join
from .schema import KEY_TYPES, ColumnDescriptor, ColumnType, coerce, schema_of

#: Rows of a product that the driver makes.
IN_MEMORY = 1 << 20


class Node:
    """schema: column to descriptor, in order."""

    schema: dict[str, ColumnDescriptor]

    @property
    def plan(self) -> bool:
        return False

    def size(self) -> int | None:
        """Rows, where that needs no job."""
        return None

    def frame(self) -> DataFrame:
        raise NotImplementedError


def _spark() -> SparkSession:
    return SparkSession.builder.getOrCreate()


@dataclass(frozen=True, eq=False)
class Tuples(Node):
    rows: tuple
    schema: dict

    def size(self):
        return len(self.rows)

    def frame(self):
        s = T.StructType([T.StructField(c, d.column_type.spark, d.allow_null) for c, d in self.schema.items()])
        return _spark().createDataFrame(list(self.rows), s)

    def key(self):
        order = sorted(self.schema)
        at = [list(self.schema).index(c) for c in order]
        return ("tuples", tuple(order), frozenset(tuple(r[i] for i in at) for r in self.rows))


@dataclass(frozen=True, eq=False)
class Frame(Node):
    df: DataFrame
    schema: dict

    def frame(self):
        return self.df.dropDuplicates()

    def key(self):
        return ("frame", self.df.semanticHash(), tuple(sorted(self.schema)))


@dataclass(frozen=True, eq=False)
class Detect(Node):
    """Keys that partition selection will find."""

    schema: dict

    @property
    def plan(self):
        return True

    def key(self):
        return ("detect", tuple(sorted(self.schema)))

    def frame(self):
        raise ValueError("keys to be detected have no DataFrame before a query finds them")


@dataclass(frozen=True, eq=False)
class Product(Node):
    factors: tuple

    @property
    def schema(self):
        return {c: d for f in self.factors for c, d in f.schema.items()}

    @property
    def plan(self):
        return any(f.plan for f in self.factors)

    def size(self):
        n = [f.size() for f in self.factors]
        return None if None in n else math.prod(n)

    def frame(self):
        out = None
        for f in sorted(self.factors, key=lambda f: f.size() or 0, reverse=True):
            df = f.frame()
            if out is None:
                out = df
                continue
            out = out.crossJoin(df)  # of public keys that the caller asked for
        return out.select(*[f"`{c}`" for c in self.schema])

    def key(self):
        return ("product", frozenset(f.key() for f in self.factors))


@dataclass(frozen=True, eq=False)
class Binary(Node):
    kind: str
    a: Node
    b: Node

    @property
    def schema(self):
        out = dict(self.a.schema)
        for c, d in self.b.schema.items():
            if self.kind == "join":
                null = d.allow_null if c not in out else d.allow_null and out[c].allow_null
                out[c] = ColumnDescriptor(d.column_type, null)
            elif self.kind == "union":
                out[c] = ColumnDescriptor(d.column_type, d.allow_null or out[c].allow_null)
        return out

    @property
    def plan(self):
        return self.a.plan or self.b.plan

    def frame(self):
        a, b = self.a.frame(), self.b.frame()
        on = [c for c in self.a.schema if c in self.b.schema]
        if self.kind == "union":
            return a.unionByName(b).distinct()
        return null_safe_join(a, b, on, "inner" if self.kind == "join" else "left_anti")

    def key(self):
        ab = (self.a.key(), self.b.key())
        return (self.kind, frozenset(ab) if self.kind != "minus" else ab)


@dataclass(frozen=True, eq=False)
class Project(Node):
    a: Node
    columns: tuple

    @property
    def schema(self):
        return {c: self.a.schema[c] for c in self.columns}

    @property
    def plan(self):
        return self.a.plan

    def frame(self):
        return self.a.frame().select(*[f"`{c}`" for c in self.columns]).distinct()

    def key(self):
        return ("project", frozenset(self.columns), self.a.key())


@dataclass(frozen=True, eq=False)
class Filter(Node):
    a: Node
    condition: object

    @property
    def schema(self):
        return self.a.schema

    @property
    def plan(self):
        return self.a.plan

    def frame(self):
        return self.a.frame().where(self.condition)

    def key(self):
        return ("filter", str(self.condition), self.a.key())


UNIT = Tuples((), {})


def rewrite(n: Node) -> Node:
    if isinstance(n, Product):
        flat: list[Node] = []
        for f in n.factors:
            f = rewrite(f)
            flat += f.factors if isinstance(f, Product) else [f] if f.schema else []
        small = [f for f in flat if isinstance(f, Tuples)]
        while len(small) > 1 and math.prod(len(f.rows) for f in small) > IN_MEMORY:
            small.remove(max(small, key=lambda f: len(f.rows)))
        if len(small) > 1:
            rows = tuple(tuple(itertools.chain(*r)) for r in itertools.product(*(f.rows for f in small)))
            flat = [f for f in flat if f not in small] + [Tuples(rows, {c: d for f in small for c, d in f.schema.items()})]
        return Product(tuple(flat)) if len(flat) > 1 else flat[0] if flat else UNIT
    if isinstance(n, Project):
        a = rewrite(n.a)
        if isinstance(a, Project):
            a = a.a
        if isinstance(a, Product) and not a.plan:
            kept = [f for f in a.factors if set(f.schema) & set(n.columns)]
            # A factor may go only if it has a row: the product with an empty one is empty.
            lost = [f for f in a.factors if f not in kept and (f.size() is None or f.size() == 0)]
            parts = [rewrite(Project(f, tuple(c for c in f.schema if c in n.columns))) for f in kept]
            if not lost:
                p = rewrite(Product(tuple(parts)))
                return p if list(p.schema) == list(n.columns) else Reordered(p, n.columns)
            return Project(rewrite(Product(tuple([*parts, *lost]))), n.columns)
        if isinstance(a, Tuples):
            at = [list(a.schema).index(c) for c in n.columns]
            return Tuples(tuple(dict.fromkeys(tuple(r[i] for i in at) for r in a.rows)), {c: a.schema[c] for c in n.columns})
        if set(n.columns) == set(a.schema):
            return a if list(a.schema) == list(n.columns) else Reordered(a, n.columns)
        return Project(a, n.columns)
    if isinstance(n, Binary):
        a, b = rewrite(n.a), rewrite(n.b)
        if n.kind in ("join", "minus") and isinstance(a, Product) and set(b.schema) & set(a.schema):
            # What the other side doesn't touch stays a factor.
            near = [f for f in a.factors if set(f.schema) & set(b.schema)]
            far = [f for f in a.factors if f not in near]
            if far:
                names = list(n.schema)
                p = Product((Binary(n.kind, rewrite(Product(tuple(near))), b), *far))
                return Reordered(rewrite(p), tuple(names))
        return Binary(n.kind, a, b)
    if isinstance(n, Filter):
        return Filter(rewrite(n.a), n.condition)
    return n


class Reordered(Project):
    """A projection to all columns: no duplicates can arise."""

    def size(self):
        return self.a.size()

    def frame(self):
        return self.a.frame().select(*[f"`{c}`" for c in self.columns])

    def key(self):
        return self.a.key()


def _check(schema: Mapping[str, ColumnDescriptor]) -> None:
    for c, d in schema.items():
        if not c:
            raise ValueError('a column has the name ""')
        if d.column_type not in KEY_TYPES:
            raise ValueError(f"column {c!r}: {d.column_type.value} can't be a group key")


class KeySet:
    """An immutable set of group keys."""

    def __init__(self, node: Node):
        self._node = rewrite(node)

    @staticmethod
    def _of(node: Node) -> KeySet:
        return KeySetPlan(node) if node.plan else KeySet(node)

    @classmethod
    def from_dataframe(cls, dataframe: DataFrame) -> KeySet:
        df = coerce(dataframe)
        schema = {c: ColumnDescriptor(d.column_type, d.allow_null) for c, d in schema_of(df).columns}
        _check(schema)
        return cls(Frame(df, schema) if schema else UNIT)

    @classmethod
    def from_tuples(cls, tuples: Iterable[tuple], columns: Sequence[str]) -> KeySet:
        rows = tuple(dict.fromkeys(tuple(t) for t in tuples))
        if len(set(columns)) < len(columns):
            raise ValueError("columns with one name")
        if not columns:
            if any(rows):
                raise ValueError("tuples without columns")
            return cls(UNIT)
        if not rows:
            raise ValueError("the types of no tuples can't be told")
        if any(len(r) != len(columns) for r in rows):
            raise ValueError("a tuple has another length than the columns")
        schema = {}
        for i, c in enumerate(columns):
            kinds = {type_of(r[i]) for r in rows if r[i] is not None}
            if len(kinds) != 1:
                raise ValueError(f"column {c!r} must have values of one type")
            schema[c] = ColumnDescriptor(kinds.pop(), any(r[i] is None for r in rows))
        _check(schema)
        return cls(Tuples(rows, schema))

    @classmethod
    def from_dict(cls, domains: Mapping[str, Iterable]) -> KeySet:
        out = cls(UNIT)
        for c, values in domains.items():
            out = out * cls.from_tuples([(v,) for v in values], [c])
        return out

    @classmethod
    def _detect(cls, schema: Mapping[str, ColumnDescriptor]) -> KeySetPlan:
        return KeySetPlan(Detect(dict(schema)))

    def __mul__(self, other: KeySet) -> KeySet:
        if both := set(self.columns()) & set(other.columns()):
            raise ValueError(f"factors of a product share columns: {sorted(both)}")
        return self._of(Product((self._node, other._node)))

    def __sub__(self, other: KeySet) -> KeySet:
        if other._node.plan:
            raise ValueError("keys to be detected can't be subtracted")
        if not other.columns() or not set(other.columns()) <= set(self.columns()):
            raise ValueError("what is subtracted must have some of the columns and no others")
        self._types(other, other.columns())
        return self._of(Binary("minus", self._node, other._node))

    def _types(self, other: KeySet, cols: Iterable[str]) -> None:
        for c in cols:
            if self.schema()[c].column_type is not other.schema()[c].column_type:
                raise ValueError(f"column {c!r} has two types")

    def join(self, other: KeySet) -> KeySet:
        both = [c for c in self.columns() if c in other.columns()]
        if not both:
            raise ValueError("key sets without a common column can't be joined")
        self._types(other, both)
        return self._of(Binary("join", self._node, other._node))

    def union(self, other: KeySet) -> KeySet:
        if set(self.columns()) != set(other.columns()):
            raise ValueError("a union needs the same columns")
        self._types(other, self.columns())
        return self._of(Binary("union", self._node, other._node))

    def __getitem__(self, columns) -> KeySet:
        cols = (columns,) if isinstance(columns, str) else tuple(columns)
        if not cols or len(set(cols)) < len(cols) or not set(cols) <= set(self.columns()):
            raise ValueError(f"can't project {self.columns()} to {list(cols)}")
        node = self._node
        if node.plan and isinstance(node, Product):  # detected factors that aren't kept go
            kept = tuple(f for f in node.factors if set(f.schema) & set(cols))
            node = Product(kept) if len(kept) > 1 else kept[0]
        return self._of(Project(node, cols))

    def filter(self, condition: Column | str) -> KeySet:
        if isinstance(condition, str) and not condition:
            raise ValueError("the condition is empty")
        if not self._node.plan:
            _spark().createDataFrame([], T.StructType([T.StructField(c, d.column_type.spark) for c, d in self.schema().items()])).where(condition).schema  # noqa: B018
        return self._of(Filter(self._node, condition))

    def columns(self) -> list[str]:
        return list(self._node.schema)

    def schema(self) -> dict[str, ColumnDescriptor]:
        return dict(self._node.schema)

    @cached_property
    def _frame(self) -> DataFrame:
        return self._node.frame()

    def dataframe(self) -> DataFrame:
        return self._frame

    def size(self) -> int:
        if not self.columns():
            return 1
        n = self._node.size()
        return self.dataframe().count() if n is None else n

    def cache(self) -> None:
        self.dataframe().cache()

    def uncache(self) -> None:
        self.dataframe().unpersist()

    def is_equivalent(self, other: KeySet) -> bool:
        """By structure where that tells; else by two differences."""
        if not isinstance(other, KeySet) or set(self.columns()) != set(other.columns()):
            return False
        if any(self.schema()[c].column_type is not other.schema()[c].column_type for c in self.columns()):
            return False
        if self._node.key() == other._node.key():
            return True
        if self._node.plan or other._node.plan:
            return False
        a, b = self.dataframe(), other.dataframe().select(*[f"`{c}`" for c in self.columns()])
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    def __eq__(self, other):
        return isinstance(other, KeySet) and self.is_equivalent(other)

    __hash__ = None

    def _decompose(self, split_columns: Iterable[str] = ()) -> tuple[list[KeySet], list[KeySet]]:
        """Factors, and what is subtracted from them."""
        node, minus = self._node, []
        while True:
            if isinstance(node, Reordered):
                node = node.a
            elif isinstance(node, Binary) and node.kind == "minus":
                minus.append(KeySet(node.b))
                node = node.a
            else:
                break
        factors = list(node.factors) if isinstance(node, Product) else [node]
        for c in split_columns:
            for f in [f for f in factors if isinstance(f, Tuples) and c in f.schema and len(f.schema) > 1]:
                one, rest = rewrite(Project(f, (c,))), rewrite(Project(f, tuple(x for x in f.schema if x != c)))
                if len(one.rows) * len(rest.rows) == len(f.rows):
                    factors[factors.index(f) : factors.index(f) + 1] = [one, rest]
        return [KeySet._of(f) for f in factors], minus


class KeySetPlan(KeySet):
    """A key set with columns that a query will detect."""

    def dataframe(self):
        raise ValueError("keys to be detected have no DataFrame before a query finds them")

    def size(self):
        raise ValueError("keys to be detected have no size before a query finds them")

    def detected(self) -> list[str]:
        def found(n) -> list[str]:
            if isinstance(n, Detect):
                return list(n.schema)
            if isinstance(n, Product):
                return [c for f in n.factors for c in found(f)]
            return [c for x in (getattr(n, "a", None), getattr(n, "b", None)) if x is not None for c in found(x)]

        return [c for c in self.columns() if c in found(self._node)]

    def resolved(self, found: KeySet) -> KeySet:
        """With the detected keys (columns of detected()) in place."""

        def put(n):
            if isinstance(n, Detect):
                return Project(found._node, tuple(n.schema))
            if isinstance(n, Product):
                return Product(tuple(put(f) for f in n.factors))
            if isinstance(n, Binary):
                return Binary(n.kind, put(n.a), put(n.b))
            if isinstance(n, Filter):
                return Filter(put(n.a), n.condition)
            if isinstance(n, Project):
                return Project(put(n.a), n.columns)
            return n

        return KeySet(put(self._node))


def aligned(keys: KeySet, agg: DataFrame, fill: dict[str, Column]) -> DataFrame:
    """One row for each key: what was aggregated, or `fill` where a key has no rows."""
    names = keys.columns()
    if not names:
        return agg.select(*[F.coalesce(F.col(f"`{c}`"), v).alias(c) for c, v in fill.items()])
    both = null_safe_join(keys.dataframe(), agg, names, "left")
    return both.select(*[f"`{c}`" for c in names], *[F.coalesce(F.col(f"`{c}`"), v).alias(c) for c, v in fill.items()])
