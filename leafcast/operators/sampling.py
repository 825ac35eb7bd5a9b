"""Samples that depend on keys alone: mergeable, in any order, safe under deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import below, salted


def hash_sample(df: DataFrame, rate: float, *key: str, salt: str = "s") -> DataFrame:
    """Each row with probability `rate`, decided by its key; its size follows the table under inserts and deletes."""
    return df.filter(F.substring(salted(salt, *key), 1, 8) < below(rate))


def bottom(df: DataFrame, n: int, *key: str, salt: str = "p") -> DataFrame:
    """n rows without replacement: those of least salted hash. Each task keeps n rows, so nothing but those meets in one place."""
    return df.withColumn("__h", salted(salt, *key)).orderBy("__h", *key).limit(n).drop("__h")


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def page(df: DataFrame, n: int, offset: int, *order: str) -> DataFrame:
    """n rows from an offset on; a negative n rewinds: the |n| rows before it."""
    start, size = (offset, n) if n >= 0 else (max(0, offset + n), min(-n, offset))
    return df.orderBy(*order).offset(start).limit(size)


def _lost(p: float, key: tuple[str, ...], round_: int):
    chosen = F.substring(F.sha2(F.concat_ws("|", F.lit(f"e{round_}"), F.col("leaf_id").cast("string")).cast("binary"), 256), 1, 8) < below(p)
    return chosen & (F.substring(salted(f"h{round_}", *key), 1, 8) < below(0.5))


def evict(sample: DataFrame, p: float, *key: str, round_: int = 0) -> DataFrame:
    """What stays when each leaf, with probability p, loses the half of its sample rows of lesser hash."""
    return sample.filter(~_lost(p, key, round_))


def evicted(sample: DataFrame, p: float, *key: str, round_: int = 0) -> DataFrame:
    """What `evict` takes away."""
    return sample.filter(_lost(p, key, round_))


def evict_nth(sample: DataFrame, n: int, *key: str) -> DataFrame:
    """The sample without its n-th row (from 0), leaf after leaf and by key within a leaf. Leaf sizes say which leaf holds it; only that one's rows are put in order."""
    before = 0
    for r in sample.groupBy("leaf_id").agg(F.count("*").alias("n")).orderBy("leaf_id").collect():  # a row for each leaf
        if n < before + r["n"]:
            leaf = r["leaf_id"]
            place = F.row_number().over(Window.partitionBy("leaf_id").orderBy(*key)) - 1
            own = sample.filter(F.col("leaf_id") == leaf).withColumn("__i", place).filter(F.col("__i") != n - before).drop("__i")
            return sample.filter(F.col("leaf_id") != leaf).unionByName(own)
        before += r["n"]
    return sample
