"""Makes the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, unless they find it
    on the PYTHONPATH that they inherit."""
    top = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(top)
    app = spark.sparkContext.applicationId
    if app in _shipped or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return spark
    path = os.path.join(tempfile.mkdtemp(prefix="quietframe-"), "quietframe.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where that is unset, and driver and executors
    are one process, a folder of our own."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top:
        return top
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="quietframe-")
