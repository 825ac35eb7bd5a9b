"""Errors of estimates against the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def relative_error(truth: Column, estimate: Column) -> Column:
    """|truth - estimate| / |truth|; the estimate's own size where the truth is 0."""
    return F.when(truth == 0, F.abs(estimate)).otherwise(F.abs(truth - estimate) / F.abs(truth))


def errors(truth: DataFrame, estimate: DataFrame, on: str = "qid") -> DataFrame:
    t, e = truth.alias("t"), estimate.alias("e")
    return t.join(e, on).select(on, *(relative_error(F.col(f"t.{c}"), F.col(f"e.{c}")).alias(f"err_{c}") for c in ("cnt", "sum", "avg")))


def percentiles(found: DataFrame, column: str, shares: tuple[float, ...] = (0.25, 0.5, 0.95)) -> DataFrame:
    """With linear interpolation."""
    return found.agg(*(F.percentile(column, F.lit(p)).alias(f"p{round(p * 100)}") for p in shares))


def worst(found: DataFrame, n: int = 10, by: str = "err_cnt", on: str = "qid") -> DataFrame:
    return found.orderBy(F.desc(by), on).limit(n)


def profile(df: DataFrame, *columns: str) -> DataFrame:
    """column, cnt, mean, std, min, p25, p50, p75, max of each column, for results and columns of few distinct values (percentiles are exact)."""
    out = []
    for c in columns:
        quartiles = F.percentile(c, F.array(*map(F.lit, (0.25, 0.5, 0.75))))
        named = {"cnt": F.count(c), "mean": F.avg(F.col(c)), "std": F.stddev_samp(c), "min": F.min(c).cast("double"), "q": quartiles, "max": F.max(c).cast("double")}
        out.append(F.struct(F.lit(c).alias("column"), *(v.alias(k) for k, v in named.items())))
    return df.agg(F.array(*out).alias("a")).select(F.inline("a")).select("column", "cnt", "mean", "std", "min", *(F.col("q")[i].alias(f"p{p}") for i, p in enumerate((25, 50, 75))), "max")


def assert_close(truth: DataFrame, found: DataFrame, on: str = "qid", columns: tuple[str, ...] = ("cnt", "sum", "avg", "min", "max"), within: float = 1e-4) -> None:
    """AssertionError unless both have the same rows and their values differ by `within` at most, or are null in both."""
    t, f = truth.alias("t"), found.alias("f")
    same = F.lit(True)
    for c in columns:
        a, b = F.col(f"t.{c}"), F.col(f"f.{c}")
        same = same & (F.coalesce(F.abs(a - b) <= within, F.lit(False)) | (a.isNull() & b.isNull()))
    off = t.join(f, F.col(f"t.{on}") == F.col(f"f.{on}"), "full").filter(F.col(f"t.{on}").isNull() | F.col(f"f.{on}").isNull() | ~same).limit(5).collect()
    assert not off, f"results differ: {off}"
