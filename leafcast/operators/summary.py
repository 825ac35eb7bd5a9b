"""Leaf summaries: partial aggregates that merge, retract and scale, and the extremes that changes are merged into."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import total
from .partition import Leaves


def summarise(df: DataFrame, leaves: Leaves, target: str) -> DataFrame:
    """leaf_id, cnt, sum, min, max of each leaf that has rows: one scan, partial aggregates of at most as many rows as leaves. Rows without a leaf count nowhere."""
    t = F.col(target)
    return leaves.place(df).groupBy("leaf_id").agg(F.count("*").alias("cnt"), total(t).alias("sum"), F.min(t).alias("min"), F.max(t).alias("max"))


def sign(op: str = "op"):
    return F.when(F.col(op) == "D", -1).otherwise(1)


def signed(changes: DataFrame, leaves: Leaves, target: str, op: str = "op") -> DataFrame:
    """Change of each leaf's cnt and sum from a log of inserts (I) and deletes (D), in any order."""
    return leaves.place(changes).groupBy("leaf_id").agg(F.sum(sign(op)).cast("long").alias("cnt"), total(F.col(target) * sign(op)).alias("sum"))


def merge(*parts: DataFrame) -> DataFrame:
    """Sum of summaries, in the type of their counts (scaled ones stay fractions); extremes of those that have them."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    aggs = [F.sum("cnt").alias("cnt"), total(F.col("sum")).alias("sum")]
    aggs += [F.min("min").alias("min"), F.max("max").alias("max")] if "min" in whole.columns else []
    return whole.groupBy("leaf_id").agg(*aggs)


def retract(base: DataFrame, gone: DataFrame) -> DataFrame:
    """Counts and sums without those of deleted rows; extremes can't be retracted from a summary (see `ends_after`)."""
    less = gone.select("leaf_id", (-F.col("cnt")).alias("cnt"), (-F.col("sum")).alias("sum"))
    return merge(base.select("leaf_id", "cnt", "sum"), less)


def scale(summary: DataFrame, population: int, seen: int) -> DataFrame:
    """Catch-up over `seen` of `population` rows, blown up to all of them."""
    by = population / max(seen, 1)
    return summary.withColumns({"cnt": F.col("cnt") * by, "sum": F.col("sum") * by})


def extremes(df: DataFrame, leaves: Leaves, target: str, key: str, n: int = 10) -> DataFrame:
    """The n smallest and n largest (value, key) of each leaf, so that extremes survive up to n - 1 deletes. Each task hands on at most n rows a leaf."""
    at = leaves.place(df).select("leaf_id", F.col(target).alias("value"), F.col(key).alias("key"))
    out = None
    for side, order in (("min", F.col("value").asc()), ("max", F.col("value").desc())):
        ranked = at.withColumn("rank", F.row_number().over(Window.partitionBy("leaf_id").orderBy(order, "key"))).filter(F.col("rank") <= n).withColumn("side", F.lit(side))
        out = ranked if out is None else out.unionByName(ranked)
    return out.select("leaf_id", "side", "rank", "value", "key")


def ends(df: DataFrame, leaves: Leaves, target: str, key: tuple[str, ...], n: int, sample: DataFrame | None = None) -> DataFrame:
    """The extremes of each leaf as a state that changes are merged into: leaf_id, side, edge, value, key, times.

    All rows strictly beyond `edge` are in the state, and some at it; a null edge says that all rows of the leaf are. Rows without a target have no part in it. `sample`: rows of the
    table with their leaf_id. The n-th extreme of a leaf's sample rows bounds that of its rows, so that all rows but about n over the sampling rate are passed over before any is sorted.
    """
    rows = df.filter(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double"))).withColumn("__key", F.struct(*key))
    if sample is not None:
        known = sample.filter(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double")))
        place = lambda order: F.row_number().over(Window.partitionBy("leaf_id").orderBy(order))
        ranked = known.select("leaf_id", F.col(target).alias("v"), place(F.col(target).asc()).alias("up"), place(F.col(target).desc()).alias("down")).filter((F.col("up") == n) | (F.col("down") == n))
        bounds = ranked.groupBy("leaf_id").agg(F.max(F.when(F.col("up") == n, F.col("v"))).alias("__low"), F.max(F.when(F.col("down") == n, F.col("v"))).alias("__high"))
        # a row a leaf
        near = F.col("__low").isNull() | (F.col(target) <= F.col("__low")) | (F.col(target) >= F.col("__high"))
        rows = leaves.place(rows).join(F.broadcast(bounds), "leaf_id", "left").filter(near).drop("leaf_id", "__low", "__high")
    found = extremes(rows, leaves, target, "__key", n)
    return _trimmed(found.select("leaf_id", "side", F.lit(None).cast("double").alias("edge"), F.col("value").cast("double").alias("value"), "key", F.lit(1).cast("long").alias("times")), n, True)


def _beyond(value: str, edge: str):
    return F.col(edge).isNull() | F.when(F.col("side") == "min", F.col(value) < F.col(edge)).otherwise(F.col(value) > F.col(edge))


def _trimmed(state: DataFrame, n: int, full: bool = False) -> DataFrame:
    """At most n rows a leaf and side, with the edge moved to the last of them where rows were left out (or may have been: `full`). Deletes that wait for their insert stay."""
    order = F.when(F.col("side") == "min", F.col("value")).otherwise(-F.col("value"))
    by = Window.partitionBy("leaf_id", "side", F.col("times") > 0)
    ranked = state.withColumns({"r": F.row_number().over(by.orderBy(order, "key")), "c": F.count("*").over(by)})
    last = F.max(F.when((F.col("r") == n) & (F.col("times") > 0) & ((F.col("c") >= n) if full else (F.col("c") > n)), F.struct("value"))).over(Window.partitionBy("leaf_id", "side"))
    moved = ranked.withColumn("last", last).filter((F.col("r") <= n) | (F.col("times") < 0))
    return moved.select("leaf_id", "side", F.coalesce("last.value", "edge").alias("edge"), "value", "key", "times")


def ends_after(state: DataFrame, changes: DataFrame, leaves: Leaves, target: str, key: tuple[str, ...], n: int) -> DataFrame:
    """The state with a log's inserts put in and its deletes taken out, by value and key, in any order. A leaf and side whose rows have all gone keeps one row without a value,
    for its edge. The state is n rows a leaf and side at most, besides deletes that came before their insert."""
    rows = leaves.place(changes).filter(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double")))
    new = rows.select("leaf_id", F.explode(F.array(F.lit("min"), F.lit("max"))).alias("side"), F.col(target).cast("double").alias("value"), F.struct(*key).alias("key"), sign().cast("long").alias("times"))
    edges = state.groupBy("leaf_id", "side").agg(F.max("edge").alias("edge"))
    held = state.filter("times > 0").select("leaf_id", "side", "value", "key", F.lit(True).alias("held"))
    # states are small: 2 * n rows a leaf; rows beyond the edge and those of the state itself are what changes it
    near = new.join(F.broadcast(edges), ["leaf_id", "side"], "left").join(F.broadcast(held.distinct()), ["leaf_id", "side", "value", "key"], "left").filter(_beyond("value", "edge") | F.col("held"))
    both = state.filter("value is not null").select("leaf_id", "side", "value", "key", "times").unionByName(near.select("leaf_id", "side", "value", "key", "times"))
    net = both.groupBy("leaf_id", "side", "value", "key").agg(F.sum("times").alias("times")).filter("times <> 0").join(F.broadcast(edges), ["leaf_id", "side"], "left")
    marks = edges.filter("edge is not null").select("leaf_id", "side", "edge", F.lit(None).cast("double").alias("value"), F.lit(None).cast(state.schema["key"].dataType).alias("key"), F.lit(0).cast("long").alias("times"))
    kept = _trimmed(net.select("leaf_id", "side", "edge", "value", "key", "times"), n)
    return kept.unionByName(marks.join(F.broadcast(kept.filter("times > 0").select("leaf_id", "side").distinct()), ["leaf_id", "side"], "left_anti"))


def ends_now(state: DataFrame) -> DataFrame:
    """leaf_id, min, max, min_known, max_known: an extreme isn't known if rows beyond the state may be left and none in it is."""
    side = lambda s, c: F.when((F.col("side") == s) & (F.col("times") > 0), F.col(c))
    lost = lambda s: F.max(F.when((F.col("side") == s) & F.col("edge").isNotNull(), 1)).isNotNull() & F.max(side(s, "times")).isNull()
    return state.groupBy("leaf_id").agg(F.min(side("min", "value")).alias("min"), F.max(side("max", "value")).alias("max"), (~lost("min")).alias("min_known"), (~lost("max")).alias("max_known"))


def totals(summary: DataFrame) -> DataFrame:
    return summary.agg(F.sum("cnt").alias("cnt"), total(F.col("sum")).alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"))


def inner_summaries(summary: DataFrame, nodes: DataFrame) -> DataFrame:
    """Summaries of all nodes of the merge tree (`Leaves.inner`) from those of the leaves: level, node, cnt, sum, min, max."""
    met = summary.join(F.broadcast(nodes), F.col("leaf_id").between(F.col("first_leaf"), F.col("last_leaf")))
    return met.groupBy("level", "node").agg(F.sum("cnt").alias("cnt"), total(F.col("sum")).alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"))


def report(table: DataFrame, summary: DataFrame, sample: DataFrame) -> DataFrame:
    """Each leaf's box, population and sample size."""
    sizes = sample.groupBy("leaf_id").agg(F.count("*").alias("sampled"))
    return table.join(summary.select("leaf_id", "cnt", "sum"), "leaf_id", "left").join(sizes, "leaf_id", "left").fillna(0, ["cnt", "sum", "sampled"])
