"""Topics as folders: `root/topic=<name>` holds text files with one message a line. For runs without a broker; Kafka's topics give the same columns (see `changes`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOPICS = ("data", "query", "deletion", "tick")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def create(spark: SparkSession, root: str, *names: str) -> None:
    """Empty topics; existing ones lose their messages."""
    for name in names or TOPICS:
        path, fs = _fs(spark, f"{root}/topic={name}")
        fs.delete(path, True)
        fs.mkdirs(path)


def topics(spark: SparkSession, root: str) -> list[str]:
    path, fs = _fs(spark, root)
    return sorted(s.getPath().getName().removeprefix("topic=") for s in fs.listStatus(path) if s.getPath().getName().startswith("topic="))


def send(lines: DataFrame, root: str, name: str) -> None:
    """Append the messages (column `value`) to a topic."""
    lines.select("value").write.mode("append").text(f"{root}/topic={name}")


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All messages of a topic so far, from its beginning."""
    return spark.read.schema("value string").option("recursiveFileLookup", True).text(f"{root}/topic={name}")


def size(spark: SparkSession, root: str, name: str) -> int:
    return read(spark, root, name).count()


def describe(spark: SparkSession, root: str) -> DataFrame:
    """topic and its number of messages."""
    return spark.createDataFrame([(t, size(spark, root, t)) for t in topics(spark, root)], "topic string, messages long")


def stream(spark: SparkSession, root: str, files_a_batch: int | None = None, latest: bool = False) -> DataFrame:
    """All topics as one stream of (topic, value), from the beginning or, with `latest`, from what comes after the start."""
    reader = spark.readStream.schema("value string, topic string").option("latestFirst", False)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    found = reader.text(root)
    if latest:
        seen = spark.sql("SELECT unix_millis(current_timestamp())").first()[0]
        found = found.where(F.unix_millis("_metadata.file_modification_time") > seen)
    return found.select("topic", "value")
