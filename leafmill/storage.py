"""Intermediate tables that outlive executors, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where that is unset, one of our own is made, which only a session in one process may do: elsewhere RuntimeError."""
    context = spark.sparkContext
    told = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not told:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="leafmill-"))
        told = context.getCheckpointDir()
    return told.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there, and the loss of an executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/leafmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(removed, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of whatever file system; a session that has ended leaves that to the folder's owner."""
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001
        return


def swept(spark: SparkSession) -> None:
    """Let the driver collect its garbage now: the shuffle files of queries that have ended are removed then, not whenever it happens to run short."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
