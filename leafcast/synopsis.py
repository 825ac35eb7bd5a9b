"""A synopsis of one table: leaves, their summaries and a sample, kept as written tables, answered from, changed, rebuilt, saved and loaded."""

from __future__ import annotations

import json
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import SynopsisConfig
from .functions.scalars import total
from .operators import estimate, partition, sampling, summary
from .operators.partition import Leaves
from .plans.query import RangeQuery
from .shared import drop, stored

#: So many batches of changes are put into the sample's own table together.
COMPACT_LOGS = 16
#: Rows of a table that is sent to all executors, at most.
MOST_BROADCAST = 500_000


class NotReady(RuntimeError):
    """The catch-up has not been done yet."""


@dataclass(frozen=True)
class Synopsis:
    """All tables are written in the shared folder, so a query reads them alone, never the table that they are of.

    `base` has the catch-up counts and sums of each leaf (null before the catch-up), `delta` the signed change since, `sample` the rows kept (leaf_id, key, attributes and
    target, in the order of leaves), `log` rows that change the sample, each with how many of it come or (below 0) go, `ends` the extremes (see `summary.ends`). Rows that miss an attribute are in no leaf: a
    synopsis answers for rows that have all of them. `epoch` counts the changes that are in, `batch` is the last numbered one.
    """

    leaves: Leaves
    target: str
    key: tuple[str, ...]
    config: SynopsisConfig
    sample: DataFrame
    ends: DataFrame
    base: DataFrame | None = None
    delta: DataFrame | None = None
    log: DataFrame | None = None
    epoch: int = 0
    batch: int = -1
    logs: int = 0
    _kept: dict = field(default_factory=dict, compare=False, repr=False)

    @classmethod
    def build(cls, df: DataFrame, attrs: list[str], target: str, key: tuple[str, ...], config: SynopsisConfig = SynopsisConfig(), partitioner: str = "equal_depth", ready: bool = True) -> Synopsis:
        """Partition on a bounded sample, then one pass over the table for each of summaries, sample and extremes; the sample is a filter on the key. catch_up below 1 summarises
        that share of the rows and scales it. ready=False leaves the catch-up for later (`catch_up`); changes may come meanwhile."""
        wanted = list(dict.fromkeys([*key, *attrs, target]))
        df = df.select(*wanted)
        chosen = sampling.bottom(df, config.partition_sample, *key).select(*dict.fromkeys([*attrs, target]))
        if len(attrs) > 1:
            leaves = partition.kd(chosen, attrs, config.leaves, target=target, population=df.count())
        elif partitioner == "variance":
            leaves = partition.variance(chosen, attrs[0], target, df.count(), config.leaves)
        else:
            leaves = partition.equal_depth(chosen, attrs[0], config.leaves)
        sample = leaves.place(sampling.hash_sample(df, config.sample_rate * config.oversample, *key)).select("leaf_id", *wanted)
        # ranges of leaves and, in a large leaf, of keys: a query reads the files of the leaves that it cuts
        sample, _ = stored(sample.repartitionByRange("leaf_id", *key), "sample", "leaf_id")
        ends, _ = stored(summary.ends(df, leaves, target, key, config.extremes, sample).coalesce(1), "ends")
        out = cls(leaves, target, key, config, sample, ends)
        return out.catch_up(df) if ready else out

    def catch_up(self, df: DataFrame) -> Synopsis:
        """Summaries of the table as it was when the synopsis was built: the caller passes that snapshot, and what came after it as changes, so no row is counted twice."""
        seen = df if self.config.catch_up >= 1 else sampling.hash_sample(df, self.config.catch_up, *self.key, salt="c")
        # rows without a leaf are counted too, as the share is one of all rows
        sums = seen.groupBy(self.leaves.leaf_id().alias("leaf_id")).agg(F.count("*").alias("cnt"), total(F.col(self.target)).alias("sum"))
        sums, path = stored(sums.coalesce(1), "sums")
        base = sums.filter("leaf_id is not null")
        if self.config.catch_up < 1:
            base = summary.scale(base, df.count(), sums.agg(F.sum("cnt")).first()[0] or 0)
        base, _ = stored(base.select("leaf_id", F.col("cnt").cast("double").alias("cnt"), "sum"), "base")
        drop(df.sparkSession, path)
        return replace(self, base=base, _kept={})

    @property
    def ready(self) -> bool:
        return self.base is not None

    def apply(self, changes: DataFrame, batch: int | None = None) -> Synopsis:
        """A log of whole rows with op I or D (a delete carries its row's values): counts and sums by sign, sample rows and extremes by row. Signs commute, so a delete may come
        before its insert, and a row may go and come back. A numbered batch that is in already changes nothing, so that a stream may send it again."""
        if batch is not None and batch <= self.batch:
            return self
        delta = summary.signed(changes, self.leaves, self.target)
        sampled = sampling.hash_sample(changes, self.config.sample_rate * self.config.oversample, *self.key)
        log = self.leaves.place(sampled).withColumn("times", summary.sign().cast("long")).select(*self.sample.columns, "times")
        log = self._net(log if self.log is None else self.log.unionByName(log))
        # three small tables, each from one scan of the changes, written side by side
        parts = (
            ((delta if self.delta is None else summary.merge(self.delta, delta)).coalesce(1), "delta"), (log.coalesce(8), "log", "leaf_id"),
            (summary.ends_after(self.ends, changes, self.leaves, self.target, self.key, self.config.extremes).coalesce(1), "ends"),
        )
        with ThreadPoolExecutor(len(parts)) as pool:
            (delta, _), (log, _), (ends, _) = (f.result() for f in [pool.submit(stored, *p) for p in parts])
        out = replace(self, delta=delta, log=log, ends=ends, logs=self.logs + 1, epoch=self.epoch + 1, batch=self.batch if batch is None else batch, _kept={})
        return out.compact() if out.logs >= COMPACT_LOGS else out

    def _net(self, log: DataFrame) -> DataFrame:
        """One row for each of the log's rows that it changes at all."""
        return log.groupBy(*self.sample.columns).agg(F.sum("times").alias("times")).filter("times <> 0")

    def _copies(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("times", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))).select(*self.sample.columns)

    def rows_now(self) -> DataFrame:
        """The sample with the log's inserts and without its deletes: of equal rows, as many as there are left. Sample rows that no delete names pass as they are; the log goes out to
        them while it is small, and meets them by a shuffle beyond that."""
        if self.log is None:
            return self.sample
        if "gone" not in self._kept:
            gone = self.log.filter("times < 0")
            self._kept["gone"] = F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone
        s, g = self.sample.alias("s"), self._kept["gone"].alias("g")
        same = reduce(and_, (F.col(f"s.{c}").eqNullSafe(F.col(f"g.{c}")) for c in self.sample.columns))
        left = s.join(g, same).groupBy(*(F.col(f"s.{c}") for c in self.sample.columns)).agg((F.count("*") + F.min("g.times")).alias("times")).filter("times > 0")
        return s.join(g, same, "left_anti").unionByName(self._copies(left)).unionByName(self._copies(self.log.filter("times > 0")))

    def compact(self) -> Synopsis:
        """The sample as one table again. Deletes that wait for their insert stay in the log."""
        if self.log is None:
            return self
        s, g = self.sample.alias("s"), self.log.filter("times < 0").alias("g")
        same = reduce(and_, (F.col(f"s.{c}").eqNullSafe(F.col(f"g.{c}")) for c in self.sample.columns))
        met = s.join(g, same).groupBy(*(F.col(f"g.{c}") for c in self.sample.columns)).agg(F.count("*").alias("times"))
        waiting, _ = stored(self._net(g.select("g.*").unionByName(met)).filter("times < 0").coalesce(1), "log")
        sample, _ = stored(self.rows_now().repartitionByRange("leaf_id", *self.key), "sample", "leaf_id")
        return replace(self, sample=sample, log=None if waiting.isEmpty() else waiting, logs=0, _kept={})

    def counts(self) -> DataFrame:
        if self.base is None:
            raise NotReady("the synopsis answers queries after its catch-up")
        return self.base if self.delta is None else summary.merge(self.base, self.delta)

    def summary(self) -> DataFrame:
        """Counts and sums with the extremes of the rows there are now; these are null once the kept ones of a leaf are all deleted (`rescan` finds them again)."""
        return self.counts().join(F.broadcast(summary.ends_now(self.ends)), "leaf_id", "left")

    def rescan(self, df: DataFrame) -> Synopsis:
        """Extremes from the table as it is now, for the leaves whose kept ones are all deleted; other leaves stay. One scan, of those leaves' rows alone."""
        lost = [r[0] for r in summary.ends_now(self.ends).filter("not (min_known and max_known)").select("leaf_id").collect()]
        if not lost:
            return self
        there = self.leaves.place(df).filter(F.col("leaf_id").isin(lost)).drop("leaf_id")
        ends, _ = stored(self.ends.filter(~F.col("leaf_id").isin(lost)).unionByName(summary.ends(there, self.leaves, self.target, self.key, self.config.extremes)).coalesce(1), "ends")
        return replace(self, ends=ends, _kept={})

    def evict(self, p: float, round_: int = 0) -> Synopsis:
        """Each leaf, with probability p, loses the half of its sample rows of lesser hash, and their part of its counts and sums."""
        kept = sampling.evict(self.rows_now(), p, *self.key, round_=round_)
        gone = sampling.evicted(self.rows_now(), p, *self.key, round_=round_).withColumn("op", F.lit("D"))
        delta = summary.signed(gone, self.leaves, self.target)
        delta, _ = stored((delta if self.delta is None else summary.merge(self.delta, delta)).coalesce(1), "delta")
        sample, _ = stored(kept.repartitionByRange("leaf_id", *self.key), "sample", "leaf_id")
        return replace(self, delta=delta, sample=sample, log=None, logs=0, epoch=self.epoch + 1, _kept={})

    def preload(self) -> Synopsis:
        """Keep the sample in the executors' memory (on their disks where it doesn't fit), and the leaves' numbers in the driver's."""
        self._now().persist(StorageLevel.MEMORY_AND_DISK).count()
        self._leaf()
        return self

    def _now(self) -> DataFrame:
        if "rows" not in self._kept:
            self._kept["rows"] = self.rows_now()
        return self._kept["rows"]

    def _leaf(self) -> dict[str, np.ndarray]:
        if "leaf" not in self._kept:
            self._kept["leaf"] = estimate.leaf_arrays(self.summary(), len(self.leaves.boxes))
            sizes = {r["leaf_id"]: r["n"] for r in self._now().groupBy("leaf_id").agg(F.count("*").alias("n")).collect()}
            self._kept["sizes"] = np.array([sizes.get(i, 0) for i in range(len(self.leaves.boxes))], float)
        return self._kept["leaf"]

    def query(self, queries: list[RangeQuery], pooled: bool = False, budget: int | None = None) -> DataFrame:
        if not self.ready:
            raise NotReady("the synopsis answers queries after its catch-up")
        return estimate.hybrid(queries, self.leaves, self._leaf(), self._now(), self.target, pooled, budget, self.key[0] if budget else None, self._kept["sizes"])

    def query_async(self, pool: ThreadPoolExecutor, queries: list[RangeQuery]) -> Future:
        """The answers' rows, from a thread of the pool: workloads of several callers run side by side in Spark's scheduler."""
        return pool.submit(lambda: self.query(queries).collect())

    def rows(self) -> DataFrame:
        return self.counts().agg(F.sum("cnt").alias("cnt"))

    def sampled(self) -> int:
        return self.rows_now().count()

    def save(self, path: str) -> None:
        """All tables and, last, a marker that says they are whole: a reader that finds it may load."""
        spark = self.sample.sparkSession
        tables = {"base": self.base, "delta": self.delta, "sample": self.sample, "log": self.log, "ends": self.ends}
        for name, df in tables.items():
            if df is not None:
                df.write.mode("overwrite").parquet(f"{path}/{name}")
        meta = {"attrs": self.leaves.attrs, "tree": self.leaves.tree, "target": self.target, "key": self.key, "epoch": self.epoch, "batch": self.batch, "config": self.config.__dict__, "tables": [k for k, v in tables.items() if v is not None]}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def saved(spark: SparkSession, path: str) -> bool:
        """Whether a whole synopsis is there."""
        mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta/_SUCCESS")
        return bool(mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Synopsis:
        if not cls.saved(spark, path):
            raise NotReady(f"no whole synopsis in {path}")
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])

        def tree(x):
            return tuple([x[0], x[1], tree(x[2]), tree(x[3])]) if isinstance(x, list) else x

        found = {name: spark.read.parquet(f"{path}/{name}") for name in meta["tables"]}
        config = SynopsisConfig(**{**meta["config"], "baselines": tuple(meta["config"]["baselines"])})
        return cls(Leaves.of(meta["attrs"], tree(meta["tree"])), meta["target"], tuple(meta["key"]), config, epoch=meta["epoch"], batch=meta["batch"], **found)

