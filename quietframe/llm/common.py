"""Scratch tables in the shared folder, skew-safe lookups and small helpers."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import checkpoint_folder, ship

#: Spread of one key over tasks in lookups and first-occurrence searches.
SALTS = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, or
    that set by hand; only where neither is (tests, local mode) a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = checkpoint_folder(spark)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quietframe/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows of an Arrow batch, unless the session says other than Spark's 10,000: texts and
#: vectors are long, and each batch stands several times in JVM and Python memory.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package and keep Arrow batches small; for all that reads whole texts."""
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    return ship(spark)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and reread it: lineage ends
    there, lost executors cost nothing that was done, and Spark knows the size
    when it plans what comes next.  The shuffle files that led to the table are
    not needed again and go."""
    spark = prepare(df.sparkSession)
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    try:
        spark.conf.set(_CLEANUP, "true")
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete a table that materialize() wrote and nothing will read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in df.inputFiles()[:1]:
        top = jvm.org.apache.hadoop.fs.Path(f).getParent()
        if "/quietframe/" in top.toString():
            top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(top, True)


def pick(df: DataFrame, *cols: str) -> DataFrame:
    """Just these columns, by position-free and case-exact reference, so that
    extra columns never clash with ours."""
    return df.select(*[df[f"`{c}`"].alias(c) for c in cols])


def fresh(columns: list[str], name: str) -> str:
    """`name`, with as many underscores before it as make it unlike all of `columns`."""
    have = {c.lower() for c in columns}
    while name.lower() in have:
        name = "_" + name
    return name


def crc_of_id(c: Column) -> Column:
    """crc32 of the id written as text, as the splits of op2 and op8 want it."""
    return F.crc32(c.cast("string"))


def salted_lookup(left: DataFrame, keys: list[str], spread: str, table: DataFrame, salts: int = 16) -> DataFrame:
    """`left` left-joined with `table` (unique in `keys`), where one key may hold
    a large share of `left`: rows of `left` get a salt from column `spread`,
    `table` is repeated once for each salt."""
    a = left.withColumn("_salt", F.pmod(F.xxhash64(F.col(spread)), F.lit(salts)).cast("int"))
    b = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*keys, "_salt"], "left").drop("_salt")


def default_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def open_fs(path: str):
    """pyarrow file system and inner path of a URI or plain path."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def write_file(path: str, chunks) -> int:
    """Write byte chunks to a new file of the shared folder; returns its size."""
    from pyarrow import fs

    f, inner = open_fs(path)
    f.create_dir(os.path.dirname(inner), recursive=True)
    local = isinstance(f, fs.LocalFileSystem)  # object stores show a file once it is whole
    to, n = f"{inner}.{uuid.uuid4().hex}" if local else inner, 0
    with f.open_output_stream(to) as out:
        for c in chunks:
            out.write(c)
            n += len(c)
    if local:
        os.replace(to, inner)
    return n
