"""The folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local session gets one of its own; a cluster has none that would do."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    held = context._jsc.sc().getCheckpointDir()
    if not found and held.isDefined():
        found = held.get()
    if not found:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quire-")
    if held.isEmpty():
        context.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession) -> str:
    """A new path in a folder of this session under the shared one, which is deleted when the session's JVM ends."""
    context = spark.sparkContext
    top = context._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/quire-{context.applicationId}")
    top.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(top)
    return f"{top.toString()}/{uuid.uuid4().hex}"


def settled_table(df: DataFrame) -> DataFrame:
    """df computed once, as Parquet in the shared folder, and read again."""
    at = scratch_path(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)
