"""The folder that the driver and all executors share, for tables between steps."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Where the session names none, a temporary folder is set if the master is local (as in
    tests); on a cluster that is an error, as executors couldn't reach such a folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_end_with_their_query(spark: SparkSession):
    """Shuffle files of a query go when it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there.

    A lost executor costs a re-read, not a recomputation.  The shuffle files of the write
    are removed when it ends.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with _shuffles_end_with_their_query(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spool_path = path
    return out


def unspool(*frames: DataFrame) -> None:
    """Delete tables of spool() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_spool_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
