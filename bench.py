"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Each runs once to warm up and is then timed; registered queries are written to nowhere.

The synopsis is built with 128 leaves and a 0.01 sample (256 leaves for several attributes), stored, loaded into memory and then asked 2000 different range queries at once.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from leafcast import catalog, config
from leafcast.operators import estimate, partition, sampling, summary, workload
from leafcast.plans.query import RangeQuery
from leafcast.synopsis import Synopsis

HEADLINES = ("exact_range_1d", "exact_range_nd", "leaf_summary_full", "leaf_assign_1d", "hybrid_1d", "hybrid_nd", "uniform_estimate", "topk_extremes", "changelog_agg", "ground_truth_prefixes", "relative_error")
RATES = (0.1, 0.2, 0.3, 0.4, 0.5)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "8g"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    more: dict[str, float] = {}  # timed as well, but no part of the sum, which is over the same queries every round

    def timed(name, run, into=times) -> None:
        run()
        began = time.perf_counter()
        run()
        into[name] = round(time.perf_counter() - began, 3)

    registered = catalog.queries()
    for name in HEADLINES:
        timed(name, lambda f=registered[name]: f(spark, sf_dir).write.format("noop").mode("overwrite").save())

    extra: dict[str, object] = {}
    rng = np.random.default_rng(5)

    def ranges(df, attrs: list[str], target: str, n: int) -> list[RangeQuery]:
        """n different boxes between random values of a sample."""
        pool = {a: np.array(v) for a, v in zip(attrs, zip(*sampling.bottom(df, 4000, *keys[target]).select(*attrs).collect(), strict=True), strict=True)}
        pick = lambda a: sorted(map(float, rng.choice(pool[a], 2, replace=False)))
        return [RangeQuery(target, tuple((a, lo, hi if hi > lo else lo + 1) for a in attrs for lo, hi in [pick(a)])) for _ in range(n)]

    ev, li = catalog.events(spark, sf_dir).select("event_id", "x", "value").cache(), catalog.lineitem(spark, sf_dir).select(*catalog.ND_KEY, *catalog.ND).cache()
    keys = {"value": ("event_id",), "l_extendedprice": catalog.ND_KEY}
    for name, df, attrs, target, leaves in (("1d", ev, ["x"], "value", 128), ("nd", li, list(catalog.ND), "l_extendedprice", 256)):
        rows = df.count()
        settings = config.SynopsisConfig(leaves=leaves, sample_rate=0.01, catch_up=0.1)
        build = lambda df=df, attrs=attrs, target=target, settings=settings: Synopsis.build(df, attrs, target, keys[target], settings)
        timed(f"synopsis_build_{name}", build, more)
        timed("rebuild_128_leaves" if name == "1d" else "rebuild_nd", lambda df=df, attrs=attrs, target=target, settings=settings: _rebuild(df, attrs, target, keys[target], settings), times if name == "1d" else more)
        syn = build().preload()
        queries = ranges(df, attrs, target, 2000)
        batch = "batch_2000_queries" if name == "1d" else "batch_2000_queries_nd"
        timed(batch, lambda syn=syn, queries=queries: syn.query(queries).collect(), times if name == "1d" else more)
        timed(f"exact_2000_queries_{name}", lambda df=df, queries=queries, target=target: estimate.exact(df, queries, target).collect(), more)
        truth = {r["qid"]: r["sum"] for r in estimate.exact(df, queries, target).collect()}
        errors = [abs(r["sum"] - truth[r["qid"]]) / truth[r["qid"]] for r in syn.query(queries).collect() if truth[r["qid"]]]
        extra |= {f"rows_{name}": rows, f"queries_per_s_{name}": round(2000 / (times | more)[batch]), f"p95_relative_error_{name}": round(float(np.quantile(errors, 0.95)), 4)}
        # as many changes as the table has rows, under keys of their own
        log = df.withColumn("op", F.lit("I")).withColumn(keys[target][0], F.col(keys[target][0]) + 10**9).cache()
        n = log.count()
        for kind, op in (("inserts", "I"), ("deletes", "D")):
            timed(f"apply_{kind}_{name}", lambda syn=syn, log=log, op=op: syn.apply(log.withColumn("op", F.lit(op))), more)
            extra[f"{kind}_per_s_{name}"] = round(n / more[f"apply_{kind}_{name}"])
        if name == "1d":
            leaves_1d = syn.leaves
            timed("apply_changes", lambda: summary.signed(catalog._log(ev), leaves_1d, "value").collect())
    sampler: dict[str, float] = {}
    for rate in RATES:
        timed(str(rate), lambda rate=rate: sampling.hash_sample(ev, rate, "event_id").write.format("noop").mode("overwrite").save(), sampler)
    timed("random_range_queries", lambda: workload.random_ranges(ev, ["x"], "value", 50, "event_id"), more)
    print(json.dumps({"metric": "sum of headline query seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf_dir).name, "more": more, **extra, "sampler_rows_per_s": {k: round(ev.count() / v) for k, v in sampler.items()}}))
    spark.stop()


def _rebuild(df, attrs: list[str], target: str, key: tuple[str, ...], settings: config.SynopsisConfig) -> None:
    """What re-optimisation costs: a new tree from a sample, and its catch-up over a share of the rows."""
    chosen = sampling.bottom(df, settings.partition_sample, *key)
    leaves = partition.kd(chosen, attrs, settings.leaves, target=target) if len(attrs) > 1 else partition.equal_depth(chosen, attrs[0], settings.leaves)
    summary.summarise(sampling.hash_sample(df, settings.catch_up, *key, salt="c"), leaves, target).collect()


if __name__ == "__main__":
    main()
