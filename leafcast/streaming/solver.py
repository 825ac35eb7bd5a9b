"""Solvers: consumers of messages that keep a synopsis (or the truth) current and answer the queries among them."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import estimate
from ..operators.partition import Leaves
from ..plans.query import RangeQuery
from ..shared import stored
from ..sources import tables
from ..synopsis import Synopsis

CONTROL = ("save", "exit", "rndelete")


@dataclass
class Messages:
    """One micro-batch by topic: `changes` are typed rows with op I or D, `queries` the workload in it, `control` its control words, `ticks` its marks."""

    changes: DataFrame
    queries: list[RangeQuery]
    control: list[str]
    ticks: list[str]
    batch: int

    @classmethod
    def of(cls, rows: DataFrame, schema: T.StructType, batch: int) -> Messages:
        """Lines of `data` and `deletion` are CSV rows of the schema; those of `query` are queries (their number is a workload's, which the driver holds) or control words."""
        lines = rows.filter(F.col("topic").isin("data", "deletion"))
        parsed = [tables.parse_lines(lines.filter(F.col("topic") == t), schema).withColumn("op", F.lit(op)) for t, op in (("data", "I"), ("deletion", "D"))]
        few = rows.filter(F.col("topic").isin("query", "tick")).collect()
        said = [r["value"].strip() for r in few if r["topic"] == "query" and r["value"].strip()]
        return cls(parsed[0].unionByName(parsed[1]), [RangeQuery.parse(x) for x in said if x not in CONTROL], [x for x in said if x in CONTROL], [r["value"] for r in few if r["topic"] == "tick"], batch)


@dataclass
class Solver:
    """Takes batches in turn: changes first, then control words, then queries. Answers go to `results`, a folder for each batch, so that a batch sent again replaces its own."""

    name: str
    results: str
    times: list[tuple[str, float]] = field(default_factory=list)
    done: bool = False

    def take(self, m: Messages) -> None:
        if self.done:
            return
        began = time.monotonic()
        self.change(m.changes, m.batch)
        for word in m.control:
            if word == "rndelete":
                self.evict(m.batch)
            elif word == "save":
                self.save()
        if m.queries:
            found = self.answer(m.queries)
            texts = found.sparkSession.createDataFrame([(i, str(q), q.hash) for i, q in enumerate(m.queries)], "qid int, query string, qhash string")
            spent = (time.monotonic() - began) / len(m.queries)
            tables.write_results(texts.join(F.broadcast(found), "qid").withColumn("time", F.lit(spent)).coalesce(1), f"{self.results}/{self.name}/batch={m.batch}")
        self.times += [(x, time.time()) for x in m.ticks]
        self.done = "exit" in m.control

    def change(self, changes: DataFrame, batch: int) -> None:
        raise NotImplementedError

    def answer(self, queries: list[RangeQuery]) -> DataFrame:
        raise NotImplementedError

    def evict(self, batch: int) -> None:
        """Solvers without a sample have nothing to evict."""

    def save(self) -> None:
        """Solvers without a state of their own have nothing to save: answers are written with their batch."""


@dataclass
class SynopsisSolver(Solver):
    synopsis: Synopsis = None  # type: ignore[assignment]
    state: str = ""

    def change(self, changes: DataFrame, batch: int) -> None:
        if batch > self.synopsis.batch:
            self.synopsis = self.synopsis.apply(changes.drop(tables.HASH), batch)
            self.save()

    def evict(self, batch: int) -> None:
        self.synopsis = self.synopsis.evict(0.1, round_=batch)
        self.save()

    def answer(self, queries: list[RangeQuery]) -> DataFrame:
        return self.synopsis.query(queries)

    def save(self) -> None:
        """What the state is made of: names of files that are written already, so this costs a few KB a batch, whatever the sample's size."""
        if self.state:
            remember(self.synopsis, self.state)


@dataclass
class ExactSolver(Solver):
    """The truth: the table's rows with inserts and without deletes, row by row."""

    table: DataFrame = None  # type: ignore[assignment]
    log: DataFrame | None = None
    last: int = -1

    def change(self, changes: DataFrame, batch: int) -> None:
        if batch > self.last:
            new, _ = stored(changes.select(*self.table.columns, F.when(F.col("op") == "D", -1).otherwise(1).alias("times")), "log")
            self.log, self.last = new if self.log is None else self.log.unionByName(new), batch

    def rows(self) -> DataFrame:
        if self.log is None:
            return self.table
        both = self.table.withColumn("times", F.lit(1)).unionByName(self.log)
        net = both.groupBy(*self.table.columns).agg(F.sum("times").alias("times")).filter("times > 0")
        return net.withColumn("times", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))).drop("times")

    def answer(self, queries: list[RangeQuery]) -> DataFrame:
        return estimate.exact(self.rows(), queries, queries[0].target)


def remember(synopsis: Synopsis, path: str) -> None:
    """A synopsis' state as the names of its written files."""
    spark = synopsis.sample.sparkSession
    held = {"base": synopsis.base, "delta": synopsis.delta, "sample": synopsis.sample, "log": synopsis.log, "ends": synopsis.ends}
    files = {k: sorted(v.inputFiles()) for k, v in held.items() if v is not None}
    meta = {"attrs": synopsis.leaves.attrs, "tree": synopsis.leaves.tree, "target": synopsis.target, "key": synopsis.key, "epoch": synopsis.epoch, "batch": synopsis.batch, "files": files, "schemas": {k: held[k].schema.json() for k in files}}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("append").text(path)


def resume(spark: SparkSession, path: str, config) -> Synopsis:
    """The last remembered state."""
    metas = [json.loads(r[0]) for r in spark.read.text(path).collect()]  # one line a batch
    meta = max(metas, key=lambda m: (m["epoch"], m["batch"]))

    def tree(x):
        return tuple([x[0], x[1], tree(x[2]), tree(x[3])]) if isinstance(x, list) else x

    found = {k: spark.read.schema(T.StructType.fromJson(json.loads(meta["schemas"][k]))).parquet(*v) for k, v in meta["files"].items() if v}
    return Synopsis(Leaves.of(meta["attrs"], tree(meta["tree"])), meta["target"], tuple(meta["key"]), config, epoch=meta["epoch"], batch=meta["batch"], **found)


def run(messages: DataFrame, solvers: list[Solver], schema: T.StructType, checkpoint: str) -> StreamingQuery:
    """Every micro-batch of (topic, value) to all solvers in turn; ends when what is there has been taken. Batches are numbered by the checkpoint, so one that is sent again
    after a failure is known by its number."""

    def dispatch(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            m = Messages.of(kept, schema, number)
            for s in solvers:
                s.take(m)
        finally:
            kept.unpersist()

    return messages.writeStream.foreachBatch(dispatch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
