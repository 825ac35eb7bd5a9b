"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, else the context's checkpoint folder. Where neither is set, a folder of our own if all runs on one machine;
    a cluster is refused, as its executors don't see each other's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if found:
        return str(found).rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return f"file://{os.path.join(tempfile.gettempdir(), 'leafcast-work')}"
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


#: Tables written by this process and not dropped yet, in the order they were written.
_written: dict[str, None] = {}


def written() -> list[str]:
    """What `stored` has written and nothing has dropped: a caller that has put a result elsewhere may drop what came up on the way."""
    return list(_written)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/leafcast/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *by: str) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors. `by`: rows of a file are in this order, so that
    filters on it pass over row groups."""
    spark = df.sparkSession
    path = new_path(spark, name)
    _written[path] = None
    (df.sortWithinPartitions(*by) if by else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove written tables that nothing reads any more."""
    jvm = spark._jvm
    for p in paths:
        _written.pop(p, None)
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
