"""Partitioners: from a bounded sample to a tree of splits, whose leaves are disjoint boxes that cover the space.

A tree is a leaf number or (attr, value, left, right); rows with attr < value go left. Partitioners see at most a few thousand sample rows, whatever the table, and so run on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import HIGH, LOW


@dataclass(frozen=True)
class Leaves:
    attrs: tuple[str, ...]
    tree: object
    boxes: tuple[tuple[tuple[float, float], ...], ...]

    @classmethod
    def of(cls, attrs: list[str], tree: object) -> Leaves:
        """Leaves are numbered from the left."""
        boxes: list = []

        def walk(node, box):
            if not isinstance(node, tuple):
                boxes.append(tuple(box[a] for a in attrs))
                return len(boxes) - 1
            a, v, left, right = node
            lo, hi = box[a]
            return a, v, walk(left, {**box, a: (lo, v)}), walk(right, {**box, a: (v, hi)})

        numbered = walk(tree, {a: (LOW, HIGH) for a in attrs})
        return cls(tuple(attrs), numbered, tuple(boxes))

    def leaf_id(self) -> Column:
        """The leaf of a row, by nested comparisons: no join, depth log2 of the leaves. Null where an attribute is null, NaN or beyond the edges of unbounded boxes: such rows
        are in no box, and in no range of that attribute."""

        def expression(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(node)
            a, v, left, right = node
            return F.when(F.col(a) < v, expression(left)).otherwise(expression(right))

        inside = F.lit(True)
        for a in self.attrs:
            inside = inside & (F.col(a) >= LOW) & (F.col(a) < HIGH)
        return F.when(inside, expression(self.tree))

    def place(self, df: DataFrame) -> DataFrame:
        """The rows that lie in a leaf, with its number as leaf_id."""
        return df.withColumn("leaf_id", self.leaf_id()).filter(F.col("leaf_id").isNotNull())

    def show(self) -> str:
        """The tree as indented text, for people."""

        def lines(node, depth: int) -> list[str]:
            if not isinstance(node, tuple):
                return [f"{'  ' * depth}leaf {node}"]
            a, v, left, right = node
            return [*lines(left, depth + 1), f"{'  ' * depth}{a} < {v:g}", *lines(right, depth + 1)]

        return "\n".join(lines(self.tree, 0))

    def inner(self, spark: SparkSession) -> DataFrame:
        """Nodes of the merge tree over the leaves in their order: level (0: the leaves), node, first_leaf, last_leaf. Neighbours merge in pairs, an odd last one goes up alone."""
        rows, level, n = [], 0, len(self.boxes)
        while True:
            nodes = -(-n // (1 << level))
            rows += [(level, i, i << level, min(n, (i + 1) << level) - 1) for i in range(nodes)]
            if nodes <= 1:
                return spark.createDataFrame(rows, "level int, node int, first_leaf int, last_leaf int")
            level += 1

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, *(float(e) for edge in box for e in edge)) for i, box in enumerate(self.boxes)]
        return spark.createDataFrame(rows, "leaf_id int, " + ", ".join(f"lo_{a} double, hi_{a} double" for a in self.attrs))


def from_cuts(attr: str, cuts: list[float]) -> Leaves:
    cuts = sorted(set(cuts))

    def balanced(lo: int, hi: int):
        if lo == hi:
            return 0
        mid = (lo + hi) // 2
        return attr, cuts[mid], balanced(lo, mid), balanced(mid + 1, hi)

    return Leaves.of([attr], balanced(0, len(cuts)))


def equal_depth_cuts(values: list[float], k: int) -> list[float]:
    """k - 1 cuts at every floor(n / k)-th value in order; equal cuts are one."""
    ordered, size = sorted(values), len(values) // k
    return sorted({ordered[(i + 1) * size - 1] for i in range(k - 1)}) if size else []


def equal_depth(sample: DataFrame, attr: str, k: int) -> Leaves:
    return from_cuts(attr, equal_depth_cuts([r[0] for r in sample.select(attr).dropna().collect()], k))


def median(values: np.ndarray) -> float | None:
    """Upper median; None if all values are equal."""
    if not len(values) or values.min() == values.max():
        return None
    return float(np.sort(values)[len(values) // 2])


def kd(sample: DataFrame, attrs: list[str], k: int, least_rows: int = 2, target: str | None = None, population: int | None = None) -> Leaves:
    """Median splits, attributes in turn by depth: the shallowest node first, of those the one where a query may err most (see `box_oracle`), then the leftmost. Without a target
    nodes of a depth go from the left."""
    columns = [*attrs, *([target] if target and target not in attrs else [])]
    rows = np.array([tuple(r) for r in sample.select(*columns).dropna().collect()], float).reshape(-1, len(columns))
    rows = rows[~np.isnan(rows).any(axis=1)]
    value = columns.index(target) if target else 0
    by = (population or len(rows)) / max(1, len(rows))

    def node(some: np.ndarray, depth: int, path: str) -> dict:
        err = box_oracle(some[:, : len(attrs)], some[:, value], by, least_rows) if target else 0.0
        return {"rows": some, "depth": depth, "split": None, "path": path, "err": err}

    root = node(rows, 0, "")
    open_, n = [root], 1
    while open_ and n < k:
        at = open_.pop(min(range(len(open_)), key=lambda i: (open_[i]["depth"], -open_[i]["err"], open_[i]["path"])))
        a = at["depth"] % len(attrs)
        if len(at["rows"]) <= least_rows or (v := median(at["rows"][:, a])) is None or not (at["rows"][:, a] < v).any():
            continue
        left = at["rows"][:, a] < v
        children = [node(at["rows"][m], at["depth"] + 1, at["path"] + side) for m, side in ((left, "0"), (~left, "1"))]
        at["split"] = (attrs[a], v, children)
        open_ += children
        n += 1

    def tree(node):
        return 0 if node["split"] is None else (node["split"][0], node["split"][1], tree(node["split"][2][0]), tree(node["split"][2][1]))

    return Leaves.of(attrs, tree(root))


def cross(sample: DataFrame, attrs: list[str]) -> Leaves:
    """All attributes split at once at their medians over the sample: up to 2 ** len(attrs) boxes. An attribute whose values are all equal isn't split."""
    rows = np.array([tuple(r) for r in sample.select(*attrs).dropna().collect()], float).reshape(-1, len(attrs))
    cuts = [(a, v) for i, a in enumerate(attrs) if (v := median(rows[:, i])) is not None]

    def tree(depth: int):
        return 0 if depth == len(cuts) else (*cuts[depth], tree(depth + 1), tree(depth + 1))

    return Leaves.of(attrs, tree(0))


def interval_variance(sample: DataFrame, order: list[str], target: str, population: int, intervals: list[tuple[int, int]]) -> DataFrame:
    """first, last, variance of stretches of a bounded sample in order (rows counted from 0, both ends included), from running sums; what VarianceOracle takes the maximum of:
    the squared sampling ratio times the sum of squares, less the squared sum over the number of rows."""
    n = sample.count()
    v, whole = F.col(target).cast("double"), Window.orderBy(*order)  # a bounded sample: one task suffices
    upto = whole.rowsBetween(Window.unboundedPreceding, 0)
    sums = sample.select((F.row_number().over(whole) - 1).alias("i"), F.sum(v).over(upto).alias("s1"), F.sum(v * v).over(upto).alias("s2"))
    asked = sample.sparkSession.createDataFrame(intervals, "first int, last int")
    at = asked.join(sums.alias("e"), F.col("last") == F.col("e.i")).join(sums.alias("b"), F.col("first") - 1 == F.col("b.i"), "left")
    less = lambda c: F.col(f"e.{c}") - F.coalesce(F.col(f"b.{c}"), F.lit(0.0))
    by = population / max(n, 1)
    return at.select("first", "last", (F.lit(by * by) * less("s2") - less("s1") * less("s1") / (F.col("last") - F.col("first") + 1)).alias("variance"))


class VarianceOracle:
    """Largest error a query inside an interval of sorted sample rows may have: the maximum over the whole interval and a fixed grid of `grid` * `grid` sub-intervals of
    `least_rows` rows or more, of ratio**2 * sum of squares - squared sum / rows of the interval. Intervals of up to `grid` places are searched in full."""

    def __init__(self, values: np.ndarray, population: int, least_rows: int = 64, grid: int = 32):
        self.by, self.least, self.grid = population / max(1, len(values)), least_rows, grid
        self.sums = np.concatenate([[0.0], np.cumsum(values)])
        self.squares = np.concatenate([[0.0], np.cumsum(values * values)])

    def __call__(self, i: int, j: int) -> float:
        """Of rows i to j, both included."""
        size = j - i + 1
        least = min(self.least, size)
        starts = np.unique(np.linspace(i, j + 1 - least, self.grid).astype(int))
        lengths = np.unique(np.linspace(least, size, self.grid).astype(int))
        s, w = np.meshgrid(starts, lengths)
        w = np.minimum(w, j + 1 - s)
        sq, sm = self.squares[s + w] - self.squares[s], self.sums[s + w] - self.sums[s]
        return float((self.by**2 * sq - sm * sm / size).max(initial=0.0))


def box_oracle(points: np.ndarray, values: np.ndarray, by: float, least_rows: int) -> float:
    """Largest error in a box of several attributes: the greatest of the oracles over its rows in the order of each attribute. `by` is the sampling ratio."""
    if not len(values):
        return 0.0
    n = round(by * len(values))
    return max(VarianceOracle(values[np.argsort(points[:, a], kind="stable")], n, least_rows)(0, len(values) - 1) for a in range(points.shape[1]))


def budget_bounds(values: np.ndarray, population: int) -> tuple[float, float]:
    """Variance budgets between which the best one lies: half the least square, and the largest square times the squared population."""
    if not len(values):
        return 0.0, 0.0
    return float(values.min()) ** 2 / 2, float(np.abs(values).max()) ** 2 * float(population) ** 2


def variance_cuts(attr_values: np.ndarray, target_values: np.ndarray, population: int, k: int, least_rows: int = 8, steps: int = 40) -> list[float]:
    """Cuts of k buckets whose largest oracle value is about the least: bisection on the budget, and for each budget greedy filling with a
    bisection for the widest next bucket. Falls back to equal depth where no budget gives k buckets."""
    order = np.argsort(attr_values, kind="stable")
    x, y = attr_values[order], target_values[order]
    if len(x) < least_rows * k:
        return equal_depth_cuts(x.tolist(), k)
    oracle = VarianceOracle(y, population, least_rows)

    def fill(budget: float) -> list[int] | None:
        """First rows of the buckets after the first one; None if more than k are needed."""
        at, out = 0, []
        while True:
            lo, hi = min(at + least_rows, len(x)), len(x)
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if oracle(at, mid - 1) <= budget else (lo, mid - 1)
            if lo >= len(x):
                return out
            at = lo
            out.append(at)
            if len(out) >= k:
                return None

    low, high = budget_bounds(y, population)
    low, high, best = max(low, 1e-9 * high), max(high, 1.0), None
    for _ in range(steps):
        mid = (low * high) ** 0.5 if low > 0 else high / 2
        found = fill(mid)
        if found is None:
            low = mid
        else:
            best, high = found, mid
            if len(found) == k - 1 and high - low < 1e-3 * high:
                break
    cuts = sorted({float(x[i]) for i in best or [] if x[i] > x[0]})
    return cuts or equal_depth_cuts(x.tolist(), k)


def variance(sample: DataFrame, attr: str, target: str, population: int, k: int) -> Leaves:
    rows = np.array([tuple(r) for r in sample.select(attr, target).dropna().collect()], float).reshape(-1, 2)
    return from_cuts(attr, variance_cuts(rows[:, 0], rows[:, 1], population, k))
