"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

OWN_FOLDER = "/tmp/checkpoints/quillon"
_REGISTERED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session has one of
    ours; on a cluster it is an error, for a machine's own disk is lost with its executor. What is in it goes when Python
    ends."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        own = context.getConf().get("spark.checkpoint.dir")
        if not own and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(own or OWN_FOLDER)
    folder = f"{context.getCheckpointDir()}/quillon"
    if folder not in _REGISTERED:
        _REGISTERED.add(folder)
        atexit.register(_at_end, spark, folder)
    return folder


def _at_end(spark: SparkSession, folder: str) -> None:
    try:
        delete(spark, folder)
    except (Py4JError, OSError):  # the JVM has gone before
        pass


def delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this application has written between steps. Results not yet written elsewhere are lost with it."""
    delete(spark, shared_folder(spark))


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives any executor, and Spark knows its size."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stash(*frames: DataFrame) -> None:
    """Delete the files of stashes that no later plan reads."""
    for df in frames:
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            delete(df.sparkSession, folder)
