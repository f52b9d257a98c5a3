"""Shared storage for intermediate tables, and shipping the package to executors.

Lineage is cut by writing Parquet under the folder the cluster names in
``spark.checkpoint.dir``: every executor can read it, so a lost executor costs
one task retry and not a recomputation of the whole plan.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_OWN = "strandlake-tables"
_written: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder. Only a local session without one gets its own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    named = named or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="strandlake-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of what was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{_OWN}/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, if a scan gives fewer: for heavy maps over small tables."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def scratch(spark: SparkSession) -> str:
    """A path in the shared folder for files of one's own; deleted with the written tables."""
    path = f"{shared_dir(spark)}/{_OWN}/{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written() -> int:
    """How many tables there are to delete; with :func:`drop_written` a mark to delete from."""
    return len(_written)


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def drop_written(since: int) -> None:
    """Delete the tables written since a mark, but the last: for a step whose result is written and whose inputs are done with."""
    for spark, path in _written[since:-1]:
        _delete(spark, path)
    del _written[since:-1]


def drop_materialized() -> None:
    """Delete the tables :func:`materialize` wrote in this process."""
    while _written:
        try:
            _delete(*_written.pop())
        except Exception:  # the session may have ended first
            return


atexit.register(drop_materialized)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="strandlake-ship-"), "strandlake.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
