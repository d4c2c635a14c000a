"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset, as in tests, a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="tracesift-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, computed once: written as a Parquet table to the shared folder and read back.

    It cuts the lineage, so a lost executor costs no recomputation, and the plan. A checkpointed DataFrame
    would hand the constraints of its plan on, which in loops makes plans take ever longer to optimize.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def drop_stored(*tables: DataFrame | None) -> None:
    """Deletes tables of stored() that no result reads any more."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            spark = df.sparkSession
            found = spark._jvm.org.apache.hadoop.fs.Path(path)
            found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)
