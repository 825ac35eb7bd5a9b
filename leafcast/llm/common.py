"""What the operators of this subpackage share: inputs, Arrow batches of bounded size, memory that tasks give back."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  binds pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import drop, new_path, shared_dir, stored, written  # noqa: F401  the operators take them from here
from ..ship import ship

#: Words of all contracts: runs of anything but the six ASCII white-space bytes, which is how bytes.split() cuts.
WORD = r"[^\x20\x09-\x0D]+"

#: Columns of the table `documents`; extra columns of an input are never read under these names.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bytes of a batch on its way to a Python worker, and bytes of text that an operator cuts into words at a time: a word's object takes some ten times its letters.
BATCH_BYTES = 4_000_000
CUT_BYTES = 1_000_000


def batches(parts: Iterable[pa.RecordBatch], texts: str, most: int = CUT_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about `most` bytes of text at most (one row at least), so that a task's memory doesn't follow the batch size."""
    for batch in parts:
        column = batch.column(batch.schema.get_field_index(texts))
        sizes = pa.compute.binary_length(column).fill_null(0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


def give_back() -> None:
    """Return what a task has freed to the system: workers live on for other tasks, and what they hold counts for their executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def _prepare(spark: SparkSession) -> None:
    """This package for the workers, and batches bounded by bytes, where the session has no bound of its own."""
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow, with this package on the workers."""

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(parts)
        finally:
            give_back()

    _prepare(df.sparkSession)
    return df.mapInArrow(task, schema)


def map_groups(df: DataFrame, keys: list[str], run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """applyInArrow, with this package on the workers; callers bound the size of a group."""
    _prepare(df.sparkSession)
    return df.groupBy(*keys).applyInArrow(run, schema)


def id_edges(df: DataFrame, column: str, rows_per_bucket: int, most: int = 1 << 16) -> list:
    """Approximate quantiles of a column, as edges of range buckets; at most `most` values come to the driver."""
    n = df.count()
    k = int(min(most, max(1, n // rows_per_bucket)))
    if k < 2:
        return []
    found = df.agg(F.percentile_approx(column, [i / k for i in range(1, k)], max(10_000, 10 * k)).alias("e")).first()["e"]
    return sorted(set(found or []))
