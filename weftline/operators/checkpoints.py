"""Lineage is cut through the shared folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a session without executors of its own may go without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if named is None and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or _local()).rstrip("/")


@functools.cache
def _local() -> str:
    return tempfile.mkdtemp(prefix="checkpoints-")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read again: they outlive a lost executor, and the plan starts anew with their real
    size. The files go when the driver's program ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/steps-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_delete, spark)
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def _delete(spark: SparkSession) -> None:
    """Deletes the written tables, by the session's own Hadoop settings; a session that was stopped before leaves them to the folder's owner."""
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for path in _written:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
