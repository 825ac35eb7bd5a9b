"""Workloads: random range queries, growing prefixes, and command scripts."""

from __future__ import annotations

import math
import re
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.scalars import arithmetic, count_at_most, salted, total
from ..plans.query import RangeQuery
from .estimate import by_query
from .sampling import bottom


def random_ranges(df: DataFrame, attrs: list[str], target: str, n: int, key: str, least_rows: int = 20, salt: str = "w") -> list[RangeQuery]:
    """n queries whose edges are those of two random rows, in whole numbers; ranges that are empty or hold fewer than `least_rows` rows are left out, and further
    pairs take their place, as long as the table has any."""
    size, out = 6 * n, []
    while True:
        pool = bottom(df, size, key, salt=salt).select(*attrs).collect()
        candidates = []
        for a, b in zip(pool[::2], pool[1::2], strict=False):
            if any(v is None for v in (*a, *b)):
                continue
            box = tuple((x, float(math.floor(min(a[x], b[x]))), float(math.ceil(max(a[x], b[x])))) for x in sorted(attrs))
            if all(lo < hi for _, lo, hi in box):
                candidates.append(RangeQuery(target, box))
        if candidates:
            counts = {r["qid"]: r["cnt"] for r in by_query(df.withColumn("__one", F.lit(1)), candidates, "__one").select("qid", "cnt").collect()}
            out = [q for i, q in enumerate(candidates) if counts.get(i, 0) >= least_rows]
        if len(out) >= n or len(pool) < size:
            return out[:n]
        size *= 4


def values_at(df: DataFrame, order: str, ranks: list[int], buckets: int = 255) -> dict[int, object]:
    """The values of a unique column `order` at some ranks (from 1). Approximate quantiles cut the table in buckets, which are counted; only the buckets that hold a rank are put in
    order, each in a task. The quantiles are read once, so that all steps see the same buckets."""
    shares = F.array(*(F.lit((i + 1) / (buckets + 1)) for i in range(buckets)))
    edges = sorted(set(df.agg(F.percentile_approx(order, shares, 20 * buckets).alias("e")).first()["e"] or []))
    if isinstance(df.schema[order].dataType, T.NumericType):
        # doubles keep the order of numbers, if not all differences, which is all that buckets need
        place = count_at_most(F.col(order).cast("double"), sorted({float(e) for e in edges}))
    else:
        place = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(order))) if edges else F.lit(0)
    placed = df.select(order, F.when(F.col(order).isNull(), -1).otherwise(place).alias("__b"))
    sizes = {r["__b"]: r["n"] for r in placed.groupBy("__b").agg(F.count("*").alias("n")).collect()}
    within, at = {}, 0
    for b in sorted(sizes):
        within |= {(b, e - at): e for e in ranks if at < e <= at + sizes[b]}
        at += sizes[b]
    if not within:
        return {}
    ordered = placed.filter(F.col("__b").isin(sorted({b for b, _ in within}))).withColumn("__n", F.row_number().over(Window.partitionBy("__b").orderBy(order)))
    found = ordered.filter(F.struct("__b", "__n").isin([F.struct(F.lit(b), F.lit(n)) for b, n in within])).collect()
    return {within[r["__b"], r["__n"]]: r[order] for r in found}


def prefix_truth(df: DataFrame, queries: list[RangeQuery], target: str, order: str, fractions: tuple[float, ...]) -> DataFrame:
    """fraction, qid, cnt, sum, avg of every query over the first floor(fraction * rows) rows in the order of a unique column.

    Prefix ends come from the order's values, so no row number is given to the table. Rows are summed by query and by the stretch between two ends, in one scan; a
    prefix adds up its stretches.
    """
    spark, n = df.sparkSession, df.count()
    ends = sorted((math.floor(n * p), p) for p in fractions)
    marks = values_at(df, order, [e for e, _ in ends])
    stretch = F.lit(0)
    for e, _ in ends:
        stretch = stretch + ((F.col(order) > F.lit(marks[e])).cast("int") if e in marks else F.lit(1))
    columns = {order, target, *(a for q in queries for a, _, _ in q.box)}
    inside = df.select(*sorted(columns)).withColumn("__stretch", stretch).filter(F.col("__stretch") < len(ends))
    parts = by_query(inside, queries, target, "__stretch").select("__stretch", F.col("qid").alias("__q"), "cnt", "sum")
    upto = F.array(*(F.struct(F.lit(p).alias("fraction"), F.lit(j).alias("__j")) for j, (_, p) in enumerate(ends)))
    wanted = spark.range(len(queries)).select(F.col("id").cast("int").alias("qid"), F.inline(upto))
    found = wanted.join(parts, (F.col("qid") == F.col("__q")) & (F.col("__stretch") <= F.col("__j")), "left").groupBy("fraction", "qid")
    found = found.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("cnt"), F.coalesce(total(F.col("sum")), F.lit(0.0)).alias("sum"))
    return found.withColumn("avg", F.when(F.col("cnt") > 0, F.col("sum") / F.col("cnt")))


def random_pair(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.orderBy(salted(f"r{seed}", key), key).limit(2)


@dataclass(frozen=True)
class Command:
    name: str
    n: int = 0
    offset: int | None = None
    timed: bool = False
    word: str = ""


def parse_command(line: str) -> Command:
    """`insert|delete|query: n [offset]` (with `t_` for a timed one), `sleep: s`, `tick`, `tock`, `exit`, `query: save|exit|rndelete`; numbers may be arithmetic."""
    name, _, rest = line.strip().partition(":")
    name, rest = name.strip().lower(), rest.strip()
    timed = name.startswith("t_")
    name = name.removeprefix("t_")
    if name in ("tick", "tock", "exit") and not rest:
        return Command(name)
    if name == "query" and rest in ("save", "exit", "rndelete"):
        return Command(name, word=rest)
    if name not in ("insert", "delete", "query", "sleep") or not rest:
        raise ValueError(f"not a command: {line!r}")
    parts = re.split(r"\s+(?![-+*/%)])(?<![-+*/%(]\s)", rest)
    n = int(arithmetic(parts[0]))
    return Command(name, n, int(arithmetic(" ".join(parts[1:]))) if len(parts) > 1 else None, timed)


def run_commands(lines: list[str], handlers: dict[str, Callable[[Command], object]]) -> list[tuple[str, float]]:
    """Commands in turn, with the seconds each took; `exit` ends, a tick starts the clock that the next tock reads."""
    out, started = [], time.monotonic()
    for line in lines:
        if not line.strip():
            continue
        c = parse_command(line)
        if c.name == "exit" or c.word == "exit":
            break
        began = time.monotonic()
        if c.name == "sleep":
            time.sleep(c.n)
        elif c.name == "tick":
            started = began
        elif c.name != "tock":
            handlers[c.word or c.name](c)
        out.append((line.strip(), time.monotonic() - (started if c.name == "tock" else began)))
    return out


def phases(total: int, queries: int, kind: str) -> list[str]:
    """Scripts of the usual experiments: query only, insert and delete, or queries after each tenth of the rows."""
    tenth = total // 10
    if kind == "query":
        return [f"t_query: {queries}", "query: save", "exit"]
    if kind == "insert_delete":
        return ["tick", f"t_insert: {total}", "tock", f"t_delete: {total}", f"t_query: {queries}", "query: save", "exit"]
    if kind == "tenths":
        return [line for i in range(1, 10) for line in (f"t_query: {queries}", "query: save", f"t_insert: {tenth} {tenth * i}")] + ["exit"]
    if kind == "evict":
        return [line for i in range(1, 10) for line in ("query: rndelete", f"t_insert: {tenth} {tenth * i}", f"t_query: {queries}", "query: save")] + ["exit"]
    raise ValueError(f"unknown kind {kind!r}")
