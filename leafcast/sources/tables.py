"""Readers and writers: CSV lines, files, pages of rows, results, truths and workloads."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Dataset
from ..functions.scalars import line_hash
from ..plans.query import RangeQuery

HASH = "__tuplehash__"


def parse_lines(lines: DataFrame, schema: T.StructType, column: str = "value", separator: str = ",") -> DataFrame:
    """Raw CSV lines as typed rows with the line's hash; a field that doesn't parse is null."""
    row = F.from_csv(column, F.lit(schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")), {"sep": separator, "mode": "PERMISSIVE"})
    return lines.select(row.alias("r"), line_hash(F.col(column)).alias(HASH)).select("r.*", HASH)


def to_lines(df: DataFrame, separator: str = ",") -> DataFrame:
    return df.select(F.to_csv(F.struct(*df.columns), {"sep": separator}).alias("value"))


def read_csv(spark: SparkSession, path: str, data: Dataset, header: bool = True) -> DataFrame:
    """The file's columns as they are."""
    reader = spark.read.option("header", header)
    return (reader.schema(data.schema) if data.schema else reader.option("inferSchema", True)).csv(path)


def load(spark: SparkSession, path: str, data: Dataset) -> DataFrame:
    """A data set as its users take it: rows that miss a value dropped where that is so, derived columns added, the wanted ones kept."""
    df = read_csv(spark, path, data)
    df = df.na.drop("any") if data.complete else df
    if data.derived:
        df = df.withColumns({c: F.expr(e) for c, e in data.derived.items()})
    return df.select(*data.wanted) if data.wanted else df


def complete_rows(df: DataFrame, *columns: str) -> DataFrame:
    """The columns, without rows that miss any of them."""
    return df.select(*columns).na.drop("any")


def fetch(stored: DataFrame, hashes: DataFrame) -> DataFrame:
    """Stored rows by the hash of incoming lines."""
    return stored.join(hashes.select(HASH).distinct(), HASH, "left_semi")


def rows_in(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"))


def write_results(df: DataFrame, path: str) -> None:
    """Answers of a workload: its columns as they are, as CSV with a header; what the folder had is replaced."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_results(spark: SparkSession, folder: str, schema: str, truth: str = "groundtruth") -> DataFrame:
    """All result files of a folder; is_truth by the file's name."""
    return spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(folder).withColumn("is_truth", F.lower(F.input_file_name()).contains(truth))


def write_truth(spark: SparkSession, rows: list[tuple[float, str, float, int, float]], path: str) -> None:
    """{fraction: {query: [sum, cnt, avg]}} as JSON text; a workload's truths are a list that the driver holds."""
    out: dict = {}
    for fraction, query, total, n, mean in rows:
        out.setdefault(str(fraction), {})[query] = [total, n, mean]
    spark.createDataFrame([(json.dumps(out),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_truth(spark: SparkSession, path: str) -> list[tuple[float, str, float, int, float]]:
    (text,) = spark.read.text(path, wholetext=True).first()
    return [(float(p), q, *v) for p, qs in json.loads(text).items() for q, v in qs.items()]


def write_workload(spark: SparkSession, queries: list[RangeQuery], path: str) -> None:
    """One query a line; an existing workload stays as it is."""
    spark.createDataFrame([(str(q),) for q in queries], "value string").coalesce(1).write.mode("ignore").text(path)


def read_workload(spark: SparkSession, path: str) -> list[RangeQuery]:
    return [RangeQuery.parse(r[0]) for r in spark.read.text(path).collect() if r[0].strip()]
