"""Change logs as streams, and signed sums by leaf over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import summary
from ..operators.partition import Leaves


def read_changes(spark: SparkSession, folder: str, schema: T.StructType, files_a_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as they come."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(folder)


def kafka_changes(spark: SparkSession, servers: str, topics: list[str], start: str = "latest") -> DataFrame:
    """Lines of several topics with the topic as op; needs Spark's Kafka package on the class path."""
    got = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("startingOffsets", start).load()
    return messages(got)


def messages(got: DataFrame) -> DataFrame:
    """Kafka's rows as (topic, value), the columns that solvers take."""
    return got.selectExpr("topic", "CAST(value AS STRING) AS value")


def kafka_sink(lines: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    """Messages of a stream (column `value`) to a topic."""
    return lines.selectExpr("value").writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def leaf_changes(changes: DataFrame, leaves: Leaves, target: str, name: str, checkpoint: str) -> StreamingQuery:
    """Signed count and sum of each leaf, as the in-memory table `name` after each batch. State: one row for each leaf."""
    return summary.signed(changes, leaves, target).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
