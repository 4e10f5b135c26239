"""Logical column types, and what is known of a table's columns."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, replace
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class AnalyticsDefault:
    """What replaces null and NaN in columns of each type, unless told otherwise."""

    # Fixed values.
    INTEGER = 0
    DECIMAL = 0.0
    VARCHAR = ""
    DATE = datetime.date(1970, 1, 1)
    TIMESTAMP = datetime.datetime(1970, 1, 1)



class ColumnType(Enum):
    INTEGER = "INTEGER"
    DECIMAL = "DECIMAL"
    VARCHAR = "VARCHAR"
    DATE = "DATE"
    TIMESTAMP = "TIMESTAMP"

    @property
    def spark(self) -> T.DataType:
        return {"INTEGER": T.LongType(), "DECIMAL": T.DoubleType(), "VARCHAR": T.StringType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampType()}[self.value]

    @property
    def default(self):
        """What replace_null_and_nan() puts in where no value is given (UTC epochs)."""
        return getattr(AnalyticsDefault, self.value)

    @property
    def numeric(self) -> bool:
        return self in (ColumnType.INTEGER, ColumnType.DECIMAL)

    def accepts(self, v) -> bool:
        if isinstance(v, bool):
            return False
        if self is ColumnType.DATE:
            return isinstance(v, datetime.date) and not isinstance(v, datetime.datetime)
        return isinstance(v, {"INTEGER": int, "DECIMAL": (int, float), "VARCHAR": str, "TIMESTAMP": datetime.datetime}[self.value])


#: Stored Spark types and the logical types they load as.
LOADED = {T.IntegerType: ColumnType.INTEGER, T.LongType: ColumnType.INTEGER, T.FloatType: ColumnType.DECIMAL, T.DoubleType: ColumnType.DECIMAL, T.StringType: ColumnType.VARCHAR, T.DateType: ColumnType.DATE, T.TimestampType: ColumnType.TIMESTAMP}
KEY_TYPES = (ColumnType.INTEGER, ColumnType.VARCHAR, ColumnType.DATE)


@dataclass(frozen=True)
class ColumnDescriptor:
    column_type: ColumnType
    allow_null: bool = False
    allow_nan: bool = False
    allow_inf: bool = False

    @property
    def open(self) -> bool:
        return self.allow_null or self.allow_nan


def descriptor(x, udf: bool = False) -> ColumnDescriptor:
    """A declared column; a bare type allows everything.  What a UDF makes can be null."""
    if isinstance(x, str):
        x = ColumnType[x]
    if isinstance(x, ColumnType):
        return ColumnDescriptor(x, True, x is ColumnType.DECIMAL, x is ColumnType.DECIMAL)
    return replace(x, allow_null=True) if udf else x


@dataclass(frozen=True)
class TableSchema:
    columns: tuple[tuple[str, ColumnDescriptor], ...]
    grouping_column: str | None = None
    id_column: str | None = None
    id_space: str | None = None

    def __post_init__(self):
        names = [c for c, _ in self.columns]
        if "" in names:
            raise ValueError('a column has the name ""')
        if len(set(names)) < len(names):
            raise ValueError(f"columns with one name: {sorted(c for c in names if names.count(c) > 1)}")

    @property
    def names(self) -> list[str]:
        return [c for c, _ in self.columns]

    def __contains__(self, c: str) -> bool:
        return c in self.names

    def __getitem__(self, c: str) -> ColumnDescriptor:
        for n, d in self.columns:
            if n == c:
                return d
        raise ValueError(f"there is no column {c!r}; there are {self.names}")

    def need(self, cols) -> None:
        for c in cols:
            self[c]

    def having(self, new: dict[str, ColumnDescriptor]) -> TableSchema:
        """With these columns changed, or added at the end."""
        old = tuple((c, new.get(c, d)) for c, d in self.columns)
        return replace(self, columns=old + tuple((c, d) for c, d in new.items() if c not in self))

    @property
    def special(self) -> set[str]:
        return {c for c in (self.grouping_column, self.id_column) if c}

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c, d.column_type.spark, d.allow_null) for c, d in self.columns])


def coerce(df: DataFrame) -> DataFrame:
    """int to long, float to double, zone-less timestamps to timestamps, by one projection."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampNTZType):
            out.append(df[f"`{f.name}`"].cast("timestamp").alias(f.name))
            continue
        kind = LOADED.get(type(f.dataType))
        if kind is None:
            raise ValueError(f"column {f.name!r} has the unsupported type {f.dataType.simpleString()}")
        out.append(df[f"`{f.name}`"].cast(kind.spark).alias(f.name) if f.dataType != kind.spark else df[f"`{f.name}`"])
    if len({f.name for f in df.schema.fields}) < len(df.columns):
        raise ValueError("columns with one name")
    return df.select(*out)


def schema_of(df: DataFrame) -> TableSchema:
    """Of a coerced frame.  Spark can't rule out NaN and infinities."""
    cols = []
    for f in df.schema.fields:
        kind = LOADED[type(f.dataType)]
        cols.append((f.name, ColumnDescriptor(kind, f.nullable, kind is ColumnType.DECIMAL, kind is ColumnType.DECIMAL)))
    return TableSchema(tuple(cols))


def literal(v, kind: ColumnType):
    return F.lit(v).cast(kind.spark)
