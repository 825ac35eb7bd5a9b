"""Command line: make a workload of random range queries, or answer one by a synopsis and its baselines, and write the answers and their errors."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .operators import accuracy, estimate, sampling, workload
from .plans.query import RangeQuery
from .sources import tables
from .synopsis import Synopsis

DEFAULTS = config.SynopsisConfig()
KEY = "__tuplehash__"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="leafcast", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    make = commands.add_parser("workload", help="write random range queries, one a line; a file that is there already stays")
    make.add_argument("-n", type=int, default=2000)
    run = commands.add_parser("run", help="answer a workload")
    run.add_argument("-k", type=int, default=DEFAULTS.leaves, help="leaves")
    run.add_argument("--catchup", type=float, default=DEFAULTS.catch_up, help="share of the rows that the summaries are made of")
    run.add_argument("--samplerate", type=float, default=DEFAULTS.sample_rate)
    run.add_argument("--oversamplex", type=float, default=DEFAULTS.oversample)
    run.add_argument("--baselines", default=",".join(DEFAULTS.baselines), help="of synopsis, exact, uniform")
    run.add_argument("--partitioner", choices=("equal_depth", "variance"), default="equal_depth")
    run.add_argument("--out", required=True, help="folder of the answers")
    for p in (make, run):
        p.add_argument("name", choices=sorted(config.WORKLOADS), help="which workload")
        p.add_argument("csv", help="the data set's file")
        p.add_argument("file", help="the workload's file")
    return top


def read(spark: SparkSession, args: argparse.Namespace) -> tuple[config.Workload, DataFrame]:
    """The workload's attributes and target of each row that has them all, with the row's hash as its key."""
    kind = config.WORKLOADS[args.name]
    df = tables.load(spark, args.csv, config.dataset(kind.dataset))
    columns = list(dict.fromkeys([*kind.attrs, kind.target]))
    return kind, tables.complete_rows(df.withColumn(KEY, F.sha2(F.to_json(F.struct(*df.columns)).cast("binary"), 256)), KEY, *columns)


def answer(name: str, df: DataFrame, queries: list[RangeQuery], kind: config.Workload, settings: config.SynopsisConfig, partitioner: str) -> DataFrame:
    if name == "exact":
        return estimate.exact(df, queries, kind.target)
    if name == "uniform":
        sample = sampling.hash_sample(df, settings.sample_rate, KEY)
        return estimate.from_sample(sample, queries, kind.target, df.count(), sample.count())
    if name == "synopsis":
        return Synopsis.build(df, sorted(kind.attrs), kind.target, (KEY,), settings, partitioner).query(queries)
    raise ValueError(f"no baseline {name!r}")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("leafcast").getOrCreate()
    kind, df = read(spark, args)
    if args.command == "workload":
        tables.write_workload(spark, workload.random_ranges(df, list(kind.attrs), kind.target, args.n, KEY), args.file)
        return
    settings = config.SynopsisConfig(leaves=args.k, catch_up=args.catchup, sample_rate=args.samplerate, oversample=args.oversamplex, baselines=tuple(args.baselines.split(",")))
    queries = tables.read_workload(spark, args.file)
    texts = spark.createDataFrame([(i, str(q), q.hash) for i, q in enumerate(queries)], "qid int, query string, qhash string")
    found = {name: answer(name, df, queries, kind, settings, args.partitioner) for name in settings.baselines}
    for name, rows in found.items():
        tables.write_results(texts.join(F.broadcast(rows), "qid").coalesce(1), f"{args.out}/{'groundtruth' if name == 'exact' else name}")
        if name != "exact" and "exact" in found:
            accuracy.percentiles(accuracy.errors(found["exact"], rows), "err_sum").withColumn("name", F.lit(name)).show()


if __name__ == "__main__":
    main()
