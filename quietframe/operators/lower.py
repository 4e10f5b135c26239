"""Plans to DataFrames.  Everything but user functions is an expression, so that
filters and column pruning still reach the scan."""

from __future__ import annotations

from functools import singledispatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import nodes as N
from ..plans.analyze import Catalog, analyze, clean_columns, infinities, join_on, overlap, replacements
from ..protection import MaxGroupsPerID, MaxRowsPerGroupPerID, MaxRowsPerID, TruncationStrategy
from ..schema import ColumnDescriptor, ColumnType, literal, schema_of
from .joins import keep_groups, keep_rows, keep_unique, null_safe_join, truncated_join


def col(c: str) -> Column:
    return F.col(f"`{c}`")


@singledispatch
def lower(node, catalog: Catalog) -> DataFrame:
    raise TypeError(f"{node!r} is no transformation")


@lower.register
def _(n: N.Source, catalog):
    return catalog.private[n.name][0]


@lower.register
def _(n: N.Rename, catalog):
    df, names = lower(n.child, catalog), dict(n.names)
    return df.select(*[col(c).alias(names.get(c, c)) for c in df.columns])


@lower.register
def _(n: N.Where, catalog):
    return lower(n.child, catalog).where(n.condition)


@lower.register
def _(n: N.Select, catalog):
    return lower(n.child, catalog).select(*[col(c) for c in n.columns])


def _plain(v):
    """A value as the row function sees it."""
    import numpy as np
    import pandas as pd

    if v is None or v is pd.NaT:
        return None
    if isinstance(v, np.generic):
        v = v.item()
    return v.to_pydatetime() if isinstance(v, pd.Timestamp) else v


def _rows(table):
    return table.to_pylist()


def _made(out: dict, new: dict[str, ColumnDescriptor]) -> dict:
    if not isinstance(out, dict) or set(out) != set(new):
        raise ValueError(f"the function must give the columns {sorted(new)}, not {out!r}")
    for c, d in new.items():
        v = out[c]
        if v is not None and not d.column_type.accepts(v):
            raise ValueError(f"{v!r} doesn't fit the column {c!r}, declared as {d.column_type.value}")
        if d.column_type is ColumnType.DECIMAL and v is not None:
            out[c] = v = float(v)
            if (v != v and not d.allow_nan) or (v in (float("inf"), float("-inf")) and not d.allow_inf):
                raise ValueError(f"{v!r} in column {c!r}, declared without such values")
    return out


def _run_rows(df: DataFrame, f, new: tuple, augment: bool, many: bool, most: int | None) -> DataFrame:
    """A row function over Arrow batches; `many`: it gives a list of rows, cut at `most`."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    new_ = dict(new)
    out = T.StructType([*(df.schema.fields if augment else []), *[T.StructField(c, d.column_type.spark) for c, d in new]])
    arrow = to_arrow_schema(out)
    if len(out.fields) == 0:
        raise ValueError("a row needs a column")

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                got = f(dict(r))
                for x in (list(got)[:most] if most is not None else got) if many else [got]:
                    x = _made(dict(x), new_)
                    rows.append({**r, **x} if augment else x)
            yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in arrow.names} for r in rows], schema=arrow)

    return df.mapInArrow(run, out)


@lower.register
def _(n: N.MapRows, catalog):
    return _run_rows(lower(n.child, catalog), n.f, n.new, n.augment, False, None)


@lower.register
def _(n: N.Derive, catalog):
    df = lower(n.child, catalog)
    return df.select(*[col(c) for c in df.columns], *[(F.expr(e) if isinstance(e, str) else e).cast(d.column_type.spark).alias(c) for c, e, d in n.new])


@lower.register
def _(n: N.FlatMap, catalog):
    most = None if analyze(n.child, catalog).ids else n.max_rows
    return _run_rows(lower(n.child, catalog), n.f, n.new, n.augment, True, most)


@lower.register
def _(n: N.FlatMapByID, catalog):
    import pandas as pd
    from pyspark.sql import Row

    df, i, new = lower(n.child, catalog), analyze(n.child, catalog).schema.id_column, dict(n.new)
    out = T.StructType([df.schema[i], *[T.StructField(c, d.column_type.spark) for c, d in n.new]])
    f = n.f

    def run(group):
        rows = [Row(**{k: _plain(v) if v == v else (None if group[k].dtype.kind != "f" else v) for k, v in r.items()}) for r in group.to_dict("records")]
        key = rows[0][i]
        made = [{i: key, **_made(dict(x), new)} for x in f(rows)]
        return pd.DataFrame(made, columns=out.names)

    return df.groupBy(col(i)).applyInPandas(run, out)


@lower.register
def _(n: N.BinColumn, catalog):
    df, s = lower(n.child, catalog), analyze(n.child, catalog).schema
    return df.select(*[col(c) for c in df.columns], n.spec.expression(col(n.column), s[n.column]).alias(n.name))


def _overlapping(left: DataFrame, right: DataFrame, over: dict, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with the names that the join gives to columns of both."""
    left = left.select(*[col(c) for c in on], *[col(c).alias(over[c][0] if c in over else c) for c in left.columns if c not in on])
    return left, right.select(*[col(c).alias(over[c][1] if c in over else c) for c in right.columns])


@lower.register
def _(n: N.JoinPublic, catalog):
    s, table = analyze(n.child, catalog).schema, catalog.public_table(n.table)
    r = schema_of(table)
    on = join_on(s, r, n.on)
    return null_safe_join(*_overlapping(lower(n.child, catalog), table, overlap(s, r, on), on), on, n.how)


def _cut(strategy):
    def cut(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
        return keep_rows(df, keys, strategy.max_rows, columns) if isinstance(strategy, TruncationStrategy.DropExcess) else keep_unique(df, keys)

    return cut


@lower.register
def _(n: N.JoinPrivate, catalog):
    a, b = analyze(n.child, catalog), analyze(n.right, catalog)
    on = join_on(a.schema, b.schema, n.on)
    both = _overlapping(lower(n.child, catalog), lower(n.right, catalog), overlap(a.schema, b.schema, on), on)
    if a.ids:
        return null_safe_join(*both, on, "inner")
    return truncated_join(*both, on, _cut(n.left_strategy), _cut(n.right_strategy))


def _changed(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else col(c) for c in df.columns])


@lower.register
def _(n: N.ReplaceNullNan, catalog):
    s = analyze(n.child, catalog).schema
    out = {}
    for c, v in replacements(s, n.values).items():
        v = literal(v, s[c].column_type)
        out[c] = F.coalesce(F.nanvl(col(c), v) if s[c].column_type is ColumnType.DECIMAL else col(c), v)
    return _changed(lower(n.child, catalog), out)


INF = float("inf")


@lower.register
def _(n: N.ReplaceInf, catalog):
    cols = infinities(analyze(n.child, catalog).schema, n.values)
    return _changed(lower(n.child, catalog), {c: F.when(col(c) == INF, F.lit(float(hi))).when(col(c) == -INF, F.lit(float(lo))).otherwise(col(c)) for c, (lo, hi) in cols.items()})


@lower.register
def _(n: N.DropNullNan, catalog):
    s, df = analyze(n.child, catalog).schema, lower(n.child, catalog)
    for c in clean_columns(s, n.columns, lambda d: d.open):
        df = df.where(col(c).isNotNull() & ~F.isnan(col(c)) if s[c].column_type is ColumnType.DECIMAL else col(c).isNotNull())
    return df


@lower.register
def _(n: N.DropInf, catalog):
    df = lower(n.child, catalog)
    for c in infinities(analyze(n.child, catalog).schema, tuple((c, (0.0, 0.0)) for c in n.columns)):
        df = df.where(~F.abs(col(c)).eqNullSafe(F.lit(INF)))
    return df


def enforce(df: DataFrame, id_column: str, constraint) -> DataFrame:
    if isinstance(constraint, MaxRowsPerID):
        return keep_rows(df, [id_column], constraint.max)
    if isinstance(constraint, MaxGroupsPerID):
        return keep_groups(df, id_column, constraint.grouping_column, constraint.max)
    if isinstance(constraint, MaxRowsPerGroupPerID):
        return keep_rows(df, [id_column, constraint.grouping_column], constraint.max)
    raise TypeError(f"{constraint!r} is no constraint")


@lower.register
def _(n: N.Enforce, catalog):
    return enforce(lower(n.child, catalog), analyze(n.child, catalog).schema.id_column, n.constraint)
