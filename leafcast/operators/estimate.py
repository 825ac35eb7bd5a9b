"""Answers of range queries: exact, from a uniform sample, and from a synopsis (leaf summaries where a leaf is covered, its sample rows where it isn't).

A workload is a list that the driver holds. Its plans don't grow with it: rows are summed once by the cells that the workload's edges cut, which Spark does where the rows are, and
what comes back (a row for each cell, leaf or pair of query and partly covered leaf) is added up with numpy, all queries at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..functions.scalars import count_at_most, salted, total
from ..plans.query import RangeQuery
from .partition import Leaves

#: Queries that get a conditional aggregate each; larger workloads go by cells, whose plans don't grow with the workload.
FEW = 16
#: Cells of a workload's grid over several attributes, and pairs of query and cell that a join broadcasts, at most: finer grids are coarsened, nothing is left out.
MOST_CELLS, MOST_PAIRS = 4096, 200_000
ANSWER = "qid int, cnt double, sum double, avg double, min double, max double"


def by_query(df: DataFrame, queries: list[RangeQuery], target: str, by: str | None = None) -> DataFrame:
    """`by`, qid, cnt, sum, min, max of queries that have rows, in one or two scans; a query without rows may be missing, or be there with cnt 0.

    Few queries are conditional aggregates. Larger workloads over one attribute cut it at all their edges: rows are summed by cell, and a query is the sum of its
    cells. Workloads over several attributes lay a grid over the space, cut at some of their edges: cells that a query covers are summed once, and rows of cells that it
    cuts meet it in a hash join on the cell. Partial aggregates leave each task, never more than cells or queries.
    """
    keys, t = [by] if by else [], F.col(target).cast("double")
    measures = (F.count("*").alias("cnt"), total(t).alias("sum"), F.min(t).alias("min"), F.max(t).alias("max"))
    if len(queries) <= FEW:
        aggs = []
        for i, q in enumerate(queries):
            v = F.when(q.predicate(), t)
            aggs += [F.count(F.when(q.predicate(), 1)).alias(f"c{i}"), total(v).alias(f"s{i}"), F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}")]
        rows = [F.struct(F.lit(i).alias("qid"), F.col(f"c{i}").alias("cnt"), F.col(f"s{i}").alias("sum"), F.col(f"l{i}").alias("min"), F.col(f"h{i}").alias("max")) for i in range(len(queries))]
        return df.groupBy(*keys).agg(*aggs).select(*keys, F.inline(F.array(*rows)))
    attrs = sorted({a for q in queries for a, _, _ in q.box})
    if len(attrs) == 1 and all(len(q.box) == 1 for q in queries):
        return _by_cells(df, queries, attrs[0], keys, measures)
    return _by_grid(df, queries, attrs, target, keys, measures)


def _by_cells(df: DataFrame, queries: list[RangeQuery], attr: str, keys: list[str], measures: tuple[Column, ...]) -> DataFrame:
    edges = sorted({float(e) for q in queries for e in q.box[0][1:]})
    number = {e: i for i, e in enumerate(edges)}
    cells = df.withColumn("__cell", count_at_most(F.col(attr), edges)).filter((F.col("__cell") > 0) & (F.col("__cell") < len(edges))).groupBy(*keys, "__cell").agg(*measures)
    table = df.sparkSession.createDataFrame([(i, number[float(lo)] + 1, number[float(hi)]) for i, q in enumerate(queries) for _, lo, hi in q.box], "qid int, __first int, __last int")
    met = cells.join(F.broadcast(table), F.col("__cell").between(F.col("__first"), F.col("__last")))
    return met.groupBy(*keys, "qid").agg(F.sum("cnt").alias("cnt"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"))


class Grid:
    """Cells of a workload over several attributes: each is cut at some of the workload's edges, evenly by their number. Queries touch a range of cells of each attribute
    and cover a range within that."""

    def __init__(self, queries: list[RangeQuery], attrs: list[str], most_cells: int = MOST_CELLS, most_pairs: int = MOST_PAIRS):
        self.attrs, self.boxes = attrs, [dict((a, (float(lo), float(hi))) for a, lo, hi in q.box) for q in queries]
        each = max(2, int(most_cells ** (1 / len(attrs))))
        while True:
            self._cut(each)
            if self.pairs() <= most_pairs or each == 1:
                break
            each //= 2

    def _cut(self, each: int) -> None:
        self.edges: list[list[float]] = []
        for a in self.attrs:
            found = sorted({e for b in self.boxes if a in b for e in b[a]})
            self.edges.append(found if len(found) < each else [found[i * len(found) // each] for i in range(each)][1:] if each > 1 else [])
        self.touched, self.covered = [], []
        for box in self.boxes:
            t, c = [], []
            for a, edges in zip(self.attrs, self.edges, strict=True):
                n = len(edges)
                if a not in box:  # rows that miss the attribute are in cell 0
                    t.append((0, n + 1))
                    c.append((0, n + 1))
                    continue
                lo, hi = box[a]
                low, high = np.searchsorted(edges, lo, side="right"), np.searchsorted(edges, hi, side="left")
                t.append((int(low), int(high) + 1) if lo < hi else (0, 0))
                first = int(np.searchsorted(edges, lo, side="left")) + 1
                last = int(np.searchsorted(edges, hi, side="right"))
                c.append((first, max(first, last)))
            self.touched.append(t)
            self.covered.append(c)

    def cell(self) -> Column:
        out = F.lit(0).cast("long")
        for a, edges in zip(self.attrs, self.edges, strict=True):
            out = out * (len(edges) + 1) + count_at_most(F.col(a), edges)
        return out

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(len(e) + 1 for e in self.edges)

    def pairs(self) -> int:
        size = lambda r: math.prod(max(0, b - a) for a, b in r)
        return sum(size(t) - size(c) for t, c in zip(self.touched, self.covered, strict=True))

    def _masks(self, ranges: list) -> np.ndarray:
        out = np.zeros((len(self.boxes), *self.shape), bool)
        for i, r in enumerate(ranges):
            out[(i, *(slice(*x) for x in r))] = True
        return out.reshape(len(self.boxes), -1)

    def cut_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Queries and the cells that they touch and don't cover."""
        return np.nonzero(self._masks(self.touched) & ~self._masks(self.covered))

    def covered_runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries and the first and last of each run of cells that they cover; cells are numbered along the last attribute."""
        step = np.diff(np.pad(self._masks(self.covered).view(np.int8), ((0, 0), (1, 1))), axis=1)
        qid, first = np.nonzero(step == 1)
        return qid, first, np.nonzero(step == -1)[1] - 1


def _by_grid(df: DataFrame, queries: list[RangeQuery], attrs: list[str], target: str, keys: list[str], measures: tuple[Column, ...]) -> DataFrame:
    spark, grid, parts = df.sparkSession, Grid(queries, attrs), ["qid", "cnt", "sum", "min", "max"]
    rows = df.select(*dict.fromkeys([*keys, target, *attrs])).withColumn("__cell", grid.cell())
    runs, cut = grid.covered_runs(), grid.cut_pairs()
    edges = {f"__{e}_{a}": pa.array([b.get(a, (None, None))[k] for b in grid.boxes], pa.float64()).take(pa.array(cut[0])) for a in attrs for k, e in enumerate(("lo", "hi"))}
    table = spark.createDataFrame(pa.table({"qid": pa.array(cut[0], pa.int32()), "__cell": pa.array(cut[1], pa.int64()), **edges}))
    fits = F.lit(True)
    for a in attrs:
        fits = fits & (F.col(f"__lo_{a}").isNull() | (F.col(a) >= F.col(f"__lo_{a}")) & (F.col(a) < F.col(f"__hi_{a}")))
    # the pairs are MOST_PAIRS at most
    both = rows.join(F.broadcast(table), "__cell").filter(fits).groupBy(*keys, "qid").agg(*measures).select(*keys, *parts)
    if len(runs[0]):
        stretches = spark.createDataFrame(pa.table({"qid": pa.array(runs[0], pa.int32()), "__a": pa.array(runs[1], pa.int64()), "__b": pa.array(runs[2], pa.int64())}))
        sums = rows.groupBy(*keys, "__cell").agg(*measures)
        both = both.unionByName(sums.join(F.broadcast(stretches), F.col("__cell").between(F.col("__a"), F.col("__b"))).select(*keys, *parts))
    return both.groupBy(*keys, "qid").agg(F.sum("cnt").alias("cnt"), total(F.col("sum")).alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"))


def exact(df: DataFrame, queries: list[RangeQuery], target: str) -> DataFrame:
    """qid, cnt, sum, avg, min, max of every query in one scan; the predicate of a single query is pushed to the scan."""
    if len(queries) == 1:
        df = df.filter(queries[0].predicate())
    found = by_query(df, queries, target)
    if len(queries) > FEW:
        ids = df.sparkSession.range(len(queries)).select(F.col("id").cast("int").alias("qid"))
        found = ids.join(found, "qid", "left").fillna(0, ["cnt"])
    return _with_average(found)


def _with_average(df: DataFrame) -> DataFrame:
    return df.withColumn("sum", F.coalesce("sum", F.lit(0.0))).withColumn("avg", F.when(F.col("cnt") > 0, F.col("sum") / F.col("cnt"))).select("qid", "cnt", "sum", "avg", "min", "max")


def from_sample(sample: DataFrame, queries: list[RangeQuery], target: str, population: int, size: int) -> DataFrame:
    """Counts and sums of a uniform sample, divided by its share of the population."""
    by = population / max(size, 1)
    return _with_average(exact(sample, queries, target).withColumns({"cnt": F.col("cnt") * by, "sum": F.col("sum") * by}))


def classify(queries: DataFrame, table: DataFrame, attrs: list[str]) -> DataFrame:
    """Leaves that a query touches: qid, leaf_id, covered, and the query's box. Both sides are small (leaves and queries of a workload)."""
    at = queries.alias("q").join(F.broadcast(table.alias("l")), g.intersects("q", "l", attrs))
    return at.select("q.*", "l.leaf_id", g.covers("q", "l", attrs).alias("covered"))


class Workload:
    """A workload against a synopsis' leaves, as arrays: which leaves each query covers, and which it cuts."""

    def __init__(self, queries: list[RangeQuery], leaves: Leaves):
        self.queries, self.attrs = queries, list(leaves.attrs)
        if strange := {a for q in queries for a, _, _ in q.box} - set(self.attrs):
            raise ValueError(f"the leaves tell nothing about {', '.join(sorted(strange))}; they have {', '.join(self.attrs)}")
        box = np.array(leaves.boxes, float).reshape(1, len(leaves.boxes), len(self.attrs), 2)
        self.asked = np.array([[q.edges(a) for a in self.attrs] for q in queries], float).reshape(len(queries), len(self.attrs), 2)
        lo, hi = self.asked[:, None, :, 0], self.asked[:, None, :, 1]
        meets = (np.maximum(lo, box[..., 0]) < np.minimum(hi, box[..., 1])).all(axis=2)
        self.covered = meets & ((lo <= box[..., 0]) & (box[..., 1] <= hi)).all(axis=2)
        self.cut = meets & ~self.covered


def leaf_arrays(summary: DataFrame, n: int) -> dict[str, np.ndarray]:
    """The summaries of all leaves, by leaf number: a row for each, which is what a synopsis is small by."""
    out = {"cnt": np.zeros(n), "sum": np.zeros(n), "min": np.full(n, np.nan), "max": np.full(n, np.nan), "min_known": np.ones(n, bool), "max_known": np.ones(n, bool)}
    for r in summary.collect():
        for c in out:
            if c in r and r[c] is not None:
                out[c][r["leaf_id"]] = r[c]
    return out


def _arrays(df: DataFrame) -> dict[str, np.ndarray]:
    found = df.toArrow()
    return {c: found.column(c).to_numpy() for c in found.column_names}


def _by_partial_leaf(work: Workload, sample: DataFrame, target: str, sizes: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """For each pair of a query and a leaf that it cuts: the pair, the leaf's sample rows, and number, sum, least and greatest of those in the query.

    One attribute: rows are summed by leaf and by the cell between two edges of the workload, and a query takes the cells of its range. Several: rows meet the
    queries that cut their leaf in a hash join. Rows of other leaves are not read."""
    qs, ls = np.nonzero(work.cut)
    n_leaves = work.cut.shape[1]
    leaves = np.unique(ls).tolist()
    rows = sample.filter(F.col("leaf_id").isin(leaves)) if len(leaves) < n_leaves else sample
    v = F.col("__v").cast("double")
    rows = rows.select("leaf_id", F.col(target).alias("__v"), *work.attrs)
    measures = (F.count("*").alias("m"), total(v).alias("s"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    if len(work.attrs) == 1:
        edges = np.unique(work.asked[qs, 0])
        cells = _arrays(rows.groupBy("leaf_id", count_at_most(F.col(work.attrs[0]), edges.tolist()).alias("c")).agg(*measures))
        stride = len(edges) + 2
        place = cells["leaf_id"].astype(np.int64) * stride + cells["c"]
        order = np.argsort(place)
        place = place[order]
        a = np.searchsorted(place, ls * stride + np.searchsorted(edges, work.asked[qs, 0, 0], side="right"))
        b = np.maximum(a, np.searchsorted(place, ls * stride + np.searchsorted(edges, work.asked[qs, 0, 1], side="right")))
        upto = lambda c: np.concatenate([[0.0], np.cumsum(np.nan_to_num(cells[c][order].astype(float)))])
        m, s = (upto(c)[b] - upto(c)[a] for c in "ms")

        def of(c: str, least: np.ufunc, empty: float) -> np.ndarray:
            values = np.append(np.nan_to_num(cells[c][order].astype(float), nan=empty), empty)
            return np.where(a < b, least.reduceat(values, np.stack([a, b], axis=1).ravel())[::2], empty) if len(a) else np.zeros(0)

        n = np.bincount(cells["leaf_id"], cells["m"], n_leaves)
        return qs, ls, n[ls], m, s, of("lo", np.minimum, np.inf), of("hi", np.maximum, -np.inf)
    if sizes is None:
        found = _arrays(rows.groupBy("leaf_id").agg(F.count("*").alias("n")))
        sizes = np.bincount(found["leaf_id"], found["n"], n_leaves)
    m, s, low, high = np.zeros(len(qs)), np.zeros(len(qs)), np.full(len(qs), np.inf), np.full(len(qs), -np.inf)
    # pairs go out in tables of MOST_PAIRS at most
    for start in range(0, len(qs), MOST_PAIRS):
        q, leaf = qs[start : start + MOST_PAIRS], ls[start : start + MOST_PAIRS]
        edges = {f"{e}_{a}": work.asked[q, j, k] for j, a in enumerate(work.attrs) for k, e in enumerate(("lo", "hi"))}
        boxes = sample.sparkSession.createDataFrame(pa.table({"pair": np.arange(start, start + len(q)), "leaf_id": leaf.astype(np.int32), **edges}))
        met = rows.join(F.broadcast(boxes), "leaf_id").filter(_inside(work.attrs)).groupBy("pair").agg(*measures)
        found = _arrays(met)
        at = found["pair"]
        m[at], s[at] = found["m"], np.nan_to_num(found["s"].astype(float))
        low[at], high[at] = np.nan_to_num(found["lo"].astype(float), nan=np.inf), np.nan_to_num(found["hi"].astype(float), nan=-np.inf)
    return qs, ls, sizes[ls], m, s, low, high


def hybrid(queries: list[RangeQuery], leaves: Leaves, summary: DataFrame | dict, sample: DataFrame, target: str, pooled: bool = False, budget: int | None = None, key: str | None = None, sizes: np.ndarray | None = None) -> DataFrame:
    """qid, cnt, sum, avg, min, max of every query.

    Covered leaves give their summaries. A partial leaf's sample rows in the query count N / n each (stratified), or all partial leaves share one ratio (pooled). `budget` caps
    the sample rows of a query, by hash of `key`. A partial leaf without sample rows is taken as half covered. `summary` is a table or its `leaf_arrays`; `sizes` are the sample
    rows of each leaf, where they are known. The summary's rows (one a leaf) come to the driver; of the sample, a row for each cell or each pair of a query and a leaf that it cuts.
    """
    spark, n = sample.sparkSession, len(queries)
    if not n:
        return spark.createDataFrame([], ANSWER)
    work = Workload(queries, leaves)
    leaf = summary if isinstance(summary, dict) else leaf_arrays(summary, len(leaves.boxes))
    cnt, value = work.covered @ leaf["cnt"], work.covered @ leaf["sum"]
    low = np.where(work.covered, np.nan_to_num(leaf["min"], nan=np.inf), np.inf).min(axis=1, initial=np.inf)
    high = np.where(work.covered, np.nan_to_num(leaf["max"], nan=-np.inf), -np.inf).max(axis=1, initial=-np.inf)
    if work.cut.any():
        if budget is not None:
            qs, *found = _within_budget(work, leaf["cnt"], sample, target, budget, key)
        else:
            qs, ls, rows, m, s, least, most = _by_partial_leaf(work, sample, target, sizes)
            population = leaf["cnt"][ls]
            if pooled:
                population, rows = (np.bincount(qs, x, n)[qs] for x in (population, rows))
            by = np.divide(population, rows, out=np.zeros_like(population), where=rows > 0)
            half = 0.0 if pooled else 0.5
            found = (np.where(rows > 0, by * m, half * population), np.where(rows > 0, by * s, half * leaf["sum"][ls]), least, most)
        np.add.at(cnt, qs, found[0])
        np.add.at(value, qs, found[1])
        np.minimum.at(low, qs, found[2])
        np.maximum.at(high, qs, found[3])
    # an extreme over a leaf whose kept ones are all deleted isn't known, whatever the other leaves have
    sure = {side: ~(work.covered & ~leaf[f"{side}_known"]).any(axis=1) for side in ("min", "max")}
    return answers(spark, cnt, value, np.where(sure["min"], low, np.inf), np.where(sure["max"], high, -np.inf))


def answers(spark: SparkSession, cnt: np.ndarray, value: np.ndarray, low: np.ndarray, high: np.ndarray) -> DataFrame:
    """A row for each query of the workload; averages of nothing and extremes of nothing are null."""
    average = np.divide(value, cnt, out=np.zeros_like(value), where=cnt > 0)
    columns = {"qid": pa.array(np.arange(len(cnt)), pa.int32()), "cnt": cnt, "sum": value, "avg": pa.array(average, mask=~(cnt > 0)), "min": pa.array(low, mask=~np.isfinite(low)), "max": pa.array(high, mask=~np.isfinite(high))}
    return spark.createDataFrame(pa.table(columns))


def _within_budget(work: Workload, population: np.ndarray, sample: DataFrame, target: str, budget: int, key: str) -> tuple[np.ndarray, ...]:
    """Partial leaves pooled, over the `budget` sample rows of least hash of each query: one ratio a query, of the rows that were kept."""
    qs, ls = np.nonzero(work.cut)
    edges = {f"{e}_{a}": work.asked[qs, j, k] for j, a in enumerate(work.attrs) for k, e in enumerate(("lo", "hi"))}
    boxes = sample.sparkSession.createDataFrame(pa.table({"qid": qs.astype(np.int32), "leaf_id": ls.astype(np.int32), **edges}))
    rows = boxes.join(sample.select("leaf_id", F.col(target).cast("double").alias("__v"), *dict.fromkeys([*work.attrs, key])), "leaf_id")
    rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy("qid").orderBy(salted("b", key), key))).filter(F.col("__r") <= budget)
    inside = _inside(work.attrs)
    v = F.when(inside, F.col("__v"))
    got = _arrays(rows.groupBy("qid").agg(F.count("*").alias("n"), F.count(F.when(inside, 1)).alias("m"), total(v).alias("s"), F.min(v).alias("lo"), F.max(v).alias("hi")))
    at = got["qid"]
    by = np.bincount(qs, population[ls], len(work.queries))[at] / got["n"]
    full = lambda c, empty: np.nan_to_num(got[c].astype(float), nan=empty)
    return at, by * got["m"], by * full("s", 0.0), full("lo", np.inf), full("hi", -np.inf)


def _inside(attrs: list[str]) -> Column:
    out = F.lit(True)
    for a in attrs:
        out = out & (F.col(a) >= F.col(f"lo_{a}")) & (F.col(a) < F.col(f"hi_{a}"))
    return out

