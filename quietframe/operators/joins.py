"""Null-safe joins and deterministic truncation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Natural equi-join where null equals null; join columns come once, from the left,
    then the left's and the right's others (which must differ in name).

    The right side is projected to fresh names first, so a side that is derived from
    the other one is never confused with it.  Spark picks the strategy; it broadcasts
    a side by its own size check only."""
    r = right.select(*[right[f"`{c}`"].alias(f"_r{i}") for i, c in enumerate(right.columns)])
    at = {c: f"_r{i}" for i, c in enumerate(right.columns)}
    cond = None
    for c in on:
        eq = left[f"`{c}`"].eqNullSafe(r[at[c]])
        cond = eq if cond is None else cond & eq
    both = left.crossJoin(r) if cond is None else left.join(r, cond, how)
    if how in ("left_anti", "left_semi"):
        return both
    return both.select(*[left[f"`{c}`"] for c in left.columns], *[r[at[c]].alias(c) for c in right.columns if c not in on])


_ZERO = {"string": "''", "date": "DATE'1970-01-01'", "timestamp": "TIMESTAMP'1970-01-01'"}


def keyed(df: DataFrame, on: list[str], nullable: list[bool]) -> tuple[DataFrame, list[str]]:
    """`df` with plain columns that are equal where `on` is or both are null, and their
    names.  What truncates by them and what joins by them share one exchange."""
    new: dict[str, Column] = {}
    for i, (c, null) in enumerate(zip(on, nullable, strict=True)):
        x, kind = F.col(f"`{c}`"), df.schema[c].dataType.typeName()
        new[f"__k{i}"] = F.coalesce(x, F.expr(_ZERO.get(kind, f"CAST(0 AS {df.schema[c].dataType.simpleString()})"))) if null else x
        if null:
            new[f"__z{i}"] = F.isnull(x)
    return df.select("*", *[v.alias(k) for k, v in new.items()]), list(new)


def truncated_join(left: DataFrame, right: DataFrame, on: list[str], cut_left, cut_right) -> DataFrame:
    """Inner join of two truncated tables, as null_safe_join() gives it; `cut_left` and
    `cut_right` take a table, the names of its key columns and the columns that make up
    its rows.  One exchange a side serves truncation and join."""
    nullable = [left.schema[c].nullable or right.schema[c].nullable for c in on]
    a, keys = keyed(left, on, nullable)
    b, _ = keyed(right, on, nullable)
    a, b = cut_left(a, keys, left.columns), cut_right(b, keys, right.columns)
    b = b.select(*[b[f"`{c}`"].alias(f"_r{i}") for i, c in enumerate([*right.columns, *keys])])
    at = {c: f"_r{i}" for i, c in enumerate([*right.columns, *keys])}
    cond = None
    for k in keys:
        eq = a[k] == b[at[k]]
        cond = eq if cond is None else cond & eq
    both = a.join(b, cond)
    return both.select(*[a[f"`{c}`"] for c in left.columns], *[b[at[c]].alias(c) for c in right.columns if c not in on])


def row_hash(columns: list[str]) -> list[Column]:
    """A hash of the whole row, then the row: an order that doesn't hang on the input's."""
    cols = [F.col(f"`{c}`") for c in sorted(columns)]
    return [F.xxhash64(*cols), *cols]


def keep_rows(df: DataFrame, keys: list[str], k: int, columns: list[str] | None = None) -> DataFrame:
    """At most k rows for each key; Spark limits them on the map side (WindowGroupLimit)."""
    w = Window.partitionBy(*[F.col(f"`{c}`") for c in keys]).orderBy(*row_hash(columns or df.columns))
    return df.withColumn("__nth", F.row_number().over(w)).where(F.col("__nth") <= k).drop("__nth")


def keep_groups(df: DataFrame, id_column: str, group: str, g: int) -> DataFrame:
    """All rows of at most g values of `group` for each ID."""
    i, c = F.col(f"`{id_column}`"), F.col(f"`{group}`")
    w = Window.partitionBy(i).orderBy(F.xxhash64(i, c), c)
    return df.withColumn("__nth", F.dense_rank().over(w)).where(F.col("__nth") <= g).drop("__nth")


def keep_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key (columns without nulls) no other row has.  The key's count is
    aggregated before the shuffle and joined back, so a hot key costs a row a task, not
    a window of its rows."""
    once = df.groupBy(*[F.col(f"`{c}`") for c in keys]).agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").drop("__n")
    return df.join(once, keys, "left_semi")
