"""What every query needs of its session: the shared folder, written tables, and this package on the workers' path."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SHIPPED: set[str] = set()


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process; local-cluster is a cluster."""
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; where it is unset, a local one in a local session and an error on a cluster."""
    if not (where := spark.conf.get("spark.checkpoint.dir", None)):
        if not is_local(spark):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tablescope-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def folder(spark: SparkSession, tag: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def written(rows: DataFrame, tag: str) -> DataFrame:
    """The rows written to the shared folder and read back: lineage ends here, and what is read again is what was there before."""
    path = folder(rows.sparkSession, tag)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever the driver's program was started: by the path in a local session, else by a copy that Spark sends to the executors once."""
    env = spark.sparkContext.environment
    if ROOT not in (paths := env.get("PYTHONPATH", "").split(os.pathsep)):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, *paths]))
    context = spark.sparkContext
    if is_local(spark) or context.applicationId in _SHIPPED:
        return
    package = os.path.join(ROOT, "tablescope")
    path = os.path.join(tempfile.mkdtemp(prefix="tablescope-"), "tablescope.zip")  # addPyFile copies it from the driver to the executors
    with zipfile.ZipFile(path, "w") as out:
        for where, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                whole = os.path.join(where, name)
                out.write(whole, os.path.relpath(whole, ROOT))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)
