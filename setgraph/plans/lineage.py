"""Cutting the lineage of iterative jobs."""

from __future__ import annotations

import time
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

from ..errors import SetGraphError

#: Seconds between two hints that shuffle files are no longer needed.
HINT_EVERY = 3.0

_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_hinted = time.monotonic()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a session on one machine may do without and gets
    its warehouse's."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise SetGraphError("spark.checkpoint.dir has to name a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the session's shared folder and read it from there."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, *used: DataFrame) -> DataFrame:
    """Write df as parquet to the session's shared folder and read it from there; then forget the tables used.

    A checkpoint keeps its plan's estimate of size, which a join takes as the product of both sides: carried on from round
    to round it soon is a number of millions of digits. Files are read with their own size.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    found = spark.read.schema(df.schema).parquet(folder)
    _folders[found] = folder
    forget(spark, *used)
    return found


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove the files of tables that written() made. Spark removes shuffle files when the JVM's garbage collector finds their
    plans unused, which it is hinted to do."""
    global _hinted
    for table in tables:
        if folder := _folders.pop(table, None):
            remove_folder(spark, folder)
    if time.monotonic() - _hinted >= HINT_EVERY:
        spark.sparkContext._jvm.System.gc()
        _hinted = time.monotonic()


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
