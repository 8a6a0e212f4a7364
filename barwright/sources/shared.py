"""Tables in the folder that the driver and all executors share: one folder an application, which the JVM deletes when it ends,
even if the session was stopped before."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}


def place(spark: SparkSession, path: str):
    """Hadoop's path and its file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir. Where that is unset, as in tests on one machine, under a new
    temporary folder; on a cluster, where executors could not see that one, it is an error."""
    context = spark.sparkContext
    known = _FOLDERS.get(context.applicationId)
    if known:
        return known
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="barwright-"))
        base = context.getCheckpointDir()
    path = f"{base.rstrip('/')}/barwright/{context.applicationId}"
    target, system = place(spark, path)
    system.mkdirs(target)
    system.deleteOnExit(target)
    _FOLDERS[context.applicationId] = path
    return path


def saved(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors, and gives the same rows
    to all that read it."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
