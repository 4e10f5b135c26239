"""House-keeping."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .session import check_installation

__all__ = ["check_installation", "cleanup", "remove_all_temp_tables"]


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cleanup(spark: SparkSession | None = None) -> None:
    """Delete the answers that this application has settled; none can be read afterwards."""
    spark = spark or SparkSession.getActiveSession()
    top = spark and spark.sparkContext.getCheckpointDir()
    if top:
        _delete(spark, top)
        spark.sparkContext.setCheckpointDir(top.rstrip("/").rpartition("/")[0])


def remove_all_temp_tables(spark: SparkSession | None = None) -> None:
    """Delete what earlier applications have left in the checkpoint folder: folders named
    by a UUID, as Spark names them.  Not while another application is using it."""
    import re

    spark = spark or SparkSession.builder.getOrCreate()
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        return
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    own = (spark.sparkContext.getCheckpointDir() or "").rstrip("/").rpartition("/")[2]
    for f in fs.listStatus(path) if fs.exists(path) else []:
        name = f.getPath().getName()
        if re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", name) and name != own:
            fs.delete(f.getPath(), True)
