"""Tables of a folder, as sessions take them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """`name`.parquet of a folder, just these columns if any are named.  Zone-less
    timestamps become dates, which can be keys and joined on."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cols = columns or df.columns
    return df.select(*[F.to_date(c).alias(c) if isinstance(df.schema[c].dataType, T.TimestampNTZType) else F.col(c) for c in cols])
