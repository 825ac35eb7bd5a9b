"""Operators on the 19-row fixture and small tables, and every registered query with SQL against DuckDB."""

import random
import time
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from leafcast import __main__ as cli
from leafcast import catalog, config, shared
from leafcast.functions import geometry
from leafcast.functions.scalars import arithmetic
from leafcast.operators import accuracy, estimate, partition, sampling, summary, workload
from leafcast.plans.query import RangeQuery
from leafcast.sources import tables
from leafcast.streaming import changes, solver, topics
from leafcast.synopsis import NotReady, Synopsis

A = [3, 4, 5, 5, 5, 7, 8, 9, 10, 12, 13, 14, 21, 7, 71, 81, 1, 14, 2]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("events", "lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_against_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    for c in columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


def test_equal_depth_on_nineteen_rows(spark):
    assert partition.equal_depth_cuts(A, 5) == [3, 5, 7, 10]
    df = spark.createDataFrame([(i, float(a)) for i, a in enumerate(A)], "id long, a double")
    leaves = partition.equal_depth(df, "a", 5)
    counts = {r["leaf_id"]: r["cnt"] for r in summary.summarise(df, leaves, "a").collect()}
    assert [counts[i] for i in range(5)] == [2, 2, 3, 4, 8]
    assert partition.median(np.array(A, float)) == 8


def test_leaves_are_disjoint_and_cover(spark):
    rng = random.Random(3)
    rows = [(i, rng.random(), rng.random(), rng.random()) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, a double, b double, e double")
    leaves = partition.kd(df, ["a", "b"], 8, target="e")
    assert len(leaves.boxes) == 8
    for _, a, b, _ in rows:
        assert sum(lo <= a < hi and l2 <= b < h2 for (lo, hi), (l2, h2) in leaves.boxes) == 1
    assert summary.summarise(df, leaves, "e").agg(F.sum("cnt")).first()[0] == 2000


def test_variance_cuts_follow_the_spread():
    x = np.arange(1000.0)
    y = np.where(x < 900, 1.0, np.random.default_rng(1).normal(0, 1000, 1000))
    cuts = partition.variance_cuts(x, y, 100_000, 10)
    assert cuts == sorted(set(cuts)) and sum(c >= 850 for c in cuts) >= 5
    assert partition.variance_cuts(x[:5], y[:5], 10, 4) == partition.equal_depth_cuts(x[:5].tolist(), 4)


def test_parse_format_and_sub_query():
    q = RangeQuery.parse("v; a:[1, 5] ;b:[-2.5, 1e3]")
    assert RangeQuery.parse(str(q)) == q and len(q.hash) == 10
    assert q.within({"a": (3.0, 9.0)}).edges("a") == (3.0, 5.0) and q.within({"a": (5.0, 9.0)}) is None
    assert q.sql("t") == "SELECT SUM(v) AS total FROM t WHERE a >= 1.0 AND a < 5.0 AND b >= -2.5 AND b < 1000.0"
    for bad in ("v;a:1-2", ";a:[1, 2]"):
        with pytest.raises(ValueError):
            RangeQuery.parse(bad)


def test_insert_then_delete_is_identity_and_aligned_queries_are_exact(spark, tmp_path):
    rows = [(i, float(i % 97), float(i % 13)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, x double, v double")
    syn = Synopsis.build(df, ["x"], "v", ("id",), config.SynopsisConfig(leaves=8, sample_rate=0.2, catch_up=1.0))
    more = spark.createDataFrame([(10_000 + i, float(i % 97), 2.0) for i in range(500)], "id long, x double, v double")
    log = more.withColumn("op", F.lit("I")).unionByName(more.withColumn("op", F.lit("D")))
    after = syn.apply(log)
    (lo, hi) = syn.leaves.boxes[2][0]
    queries = [RangeQuery("v", (("x", lo, hi),)), RangeQuery("v", ()), RangeQuery("v", (("x", 10.5, 60.5),))]
    before, now = (sorted(s.query(queries).select("qid", "cnt", "sum").collect()) for s in (syn, after))
    assert before == now
    truth = sorted(estimate.exact(df, queries, "v").select("qid", "cnt", "sum").collect())
    assert [tuple(r) for r in before[:2]] == [(r[0], float(r[1]), r[2]) for r in truth[:2]]
    assert abs(before[2]["cnt"] - truth[2]["cnt"]) < 0.1 * truth[2]["cnt"]
    after.save(str(tmp_path / "s"))
    again = Synopsis.load(spark, str(tmp_path / "s"))
    assert sorted(again.query(queries).select("qid", "cnt", "sum").collect()) == now and again.epoch == 1


def test_sample_does_not_depend_on_order(spark):
    df = spark.range(5000)
    a = {r[0] for r in sampling.bottom(df.repartition(7), 100, "id").collect()}
    assert a == {r[0] for r in sampling.bottom(df.orderBy(F.desc("id")), 100, "id").collect()} and len(a) == 100


def test_tree_beats_uniform_sample(spark):
    ev = catalog.events(spark, "/root/testdata/sf0.01")
    qs = workload.random_ranges(ev, ["x"], "value", 60, "event_id")
    leaves = catalog.event_leaves(ev, 32)
    truth = {r["qid"]: r["sum"] for r in estimate.exact(ev, qs, "value").collect()}
    s = sampling.hash_sample(ev, 0.05, "event_id")
    tree = estimate.hybrid(qs, leaves, summary.summarise(ev, leaves, "value"), leaves.place(s), "value")
    flat = estimate.from_sample(s, qs, "value", ev.count(), s.count())
    p95 = lambda df: np.quantile([abs(r["sum"] - truth[r["qid"]]) / truth[r["qid"]] for r in df.collect()], 0.95)
    assert len(qs) >= 40 and p95(tree) < p95(flat)


def test_commands():
    assert workload.parse_command("t_insert: 766000 766779") == workload.Command("insert", 766000, 766779, True)
    assert workload.parse_command("delete: 10*(2+3)").n == 50
    assert workload.parse_command("query: rndelete").word == "rndelete"
    seen = []
    workload.run_commands(["tick", "insert: 5", "query: save", "tock", "exit", "insert: 6"], {"insert": seen.append, "save": seen.append})
    assert [c.n for c in seen] == [5, 0]
    for bad in ("frobnicate: 3", "insert:", "insert: __import__('os')"):
        with pytest.raises(ValueError):
            workload.parse_command(bad)
    assert arithmetic("-(2 + 3) * 4") == -20


def test_registry_and_files(spark, tmp_path):
    assert config.dataset(" TAXI ").bounds["trip_distance"] == (0.0, 1000.0)
    with pytest.raises(ValueError):
        config.dataset("nothing")
    qs = [RangeQuery("v", (("x", 1.0, 2.0),))]
    tables.write_workload(spark, qs, str(tmp_path / "w"))
    tables.write_workload(spark, qs * 2, str(tmp_path / "w"))
    assert tables.read_workload(spark, str(tmp_path / "w")) == qs
    tables.write_truth(spark, [(0.1, "q", 5.0, 2, 2.5)], str(tmp_path / "t.json"))
    assert tables.read_truth(spark, str(tmp_path / "t.json")) == [(0.1, "q", 5.0, 2, 2.5)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, x double, v double")
    leaves = partition.equal_depth(df, "x", 4)
    found = estimate.hybrid([RangeQuery("v", ())], leaves, summary.summarise(df, leaves, "v"), leaves.place(df), "v").first()
    assert (found["cnt"], found["sum"], found["avg"]) == (0.0, 0.0, None)


def test_profile_and_cross_split_of_small_tables(spark):
    one = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (None, 5.0)], "a double, b double")
    got = {r["column"]: r for r in accuracy.profile(one, "a", "b").collect()}
    assert (got["a"]["cnt"], got["a"]["mean"], got["a"]["p50"], got["b"]["std"]) == (2, 1.5, 1.5, 0.0)
    leaves = partition.cross(one, ["a", "b"])  # b is constant: it isn't split
    assert [box[0] for box in leaves.boxes] == [(config.LOW, 2.0), (2.0, config.HIGH)]
    assert len(partition.cross(one.limit(0), ["a", "b"]).boxes) == 1


def test_large_workloads_against_sql(spark):
    rng = random.Random(4)
    found = [(i, None if rng.random() < 0.05 else float(rng.randrange(50)), float("nan") if k == 7 else None if k == 9 else rng.random() * 9, rng.random() * 100) for k, i in enumerate(rng.sample(range(10**6), 600))]
    df = spark.createDataFrame(found, "id long, x double, y double, v double")
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id BIGINT, x DOUBLE, y DOUBLE, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [list(r) for r in found])

    def box(*attrs):
        return RangeQuery("v", tuple((a, *sorted((float(rng.randrange(-3, 55)), float(rng.randrange(-3, 55))))) for a in attrs))

    one = [box("x") for _ in range(150)] + [RangeQuery("v", (("x", config.LOW, config.HIGH),)), RangeQuery("v", (("x", 5.0, 5.0),))]
    several = [box("x", "y") for _ in range(30)] + [box("y"), RangeQuery("v", ())]

    def truth(q, first=None):
        where = " AND ".join(["true", *(f"{a} >= {lo!r}::DOUBLE AND {a} < {hi!r}::DOUBLE" for a, lo, hi in q.box)])
        source = "t" if first is None else f"(SELECT * FROM t ORDER BY id LIMIT {first})"
        return con.execute(f"SELECT count(*), round(coalesce(sum(v), 0), 6), min(v), max(v) FROM {source} WHERE {where}").fetchone()

    for queries in (one[:3], one, several):
        got = {r["qid"]: (r["cnt"], round(r["sum"], 6), r["min"], r["max"]) for r in estimate.exact(df, queries, "v").collect()}
        assert got == {i: truth(q) for i, q in enumerate(queries)}
    fractions = (0.5, 0.001, 1.0, 0.25)
    for queries in (one[:3], one[-40:], several):
        got = {(r["fraction"], r["qid"]): (r["cnt"], round(r["sum"], 6)) for r in workload.prefix_truth(df, queries, "v", "id", fractions).collect()}
        assert got == {(p, i): truth(q, int(len(found) * p))[:2] for p in fractions for i, q in enumerate(queries)}
    empty = df.limit(0)
    assert {(r["cnt"], r["sum"]) for r in estimate.exact(empty, one, "v").collect()} == {(0, 0.0)}
    assert {(r["cnt"], r["sum"]) for r in workload.prefix_truth(empty, several, "v", "id", fractions).collect()} == {(0, 0.0)}


def test_values_at_ranks(spark):
    df = spark.range(0, 30_000, 1, 7).select((F.col("id") * 7919 % 30_011).alias("k"))
    ordered = sorted(r[0] for r in df.collect())
    ranks = [1, 2, 117, 15_000, 29_999, 30_000]
    assert workload.values_at(df, "k", ranks) == {r: ordered[r - 1] for r in ranks}
    assert workload.values_at(df, "k", [0, 30_001]) == {}


def test_extremes_follow_changes(spark, tmp_path):
    rows = [(i, float(i), float((i * 37) % 1000)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    whole = [RangeQuery("y", (("x", config.LOW, config.HIGH),))]
    ends = lambda s: tuple(s.query(whole).select("min", "max").first())
    syn = Synopsis.build(df, ["x"], "y", ("id",), config.SynopsisConfig(leaves=4, catch_up=0.1))
    assert ends(syn) == (0.0, 999.0)
    low = [r for r in rows if r[2] < 3]
    log = spark.createDataFrame([("I", 5000, 10.0, 7777.0), ("I", 5001, 10.0, -5.0), ("D", 5001, 10.0, -5.0), *[("D", *r) for r in low]], "op string, id long, x double, y double")
    after = syn.apply(log)
    assert ends(after) == (3.0, 7777.0)
    after.save(str(tmp_path))
    assert ends(Synopsis.load(spark, str(tmp_path))) == (3.0, 7777.0)
    gone = [r for r in rows if r[1] < 300 and r[2] < 500]
    some = spark.createDataFrame([("D", *r) for r in gone] + [("I", 6000, 10.0, 900.0)], "op string, id long, x double, y double")
    spent = syn.apply(some)
    assert ends(spent) == (None, 999.0)
    now = df.join(some.filter("op = 'D'").select("id"), "id", "left_anti").unionByName(some.filter("op = 'I'").drop("op"))
    assert ends(spent.rescan(now)) == (now.agg(F.min("y")).first()[0], 999.0)


def test_random_changes_against_brute_force(spark):
    """Counts, sums, sample and extremes after many batches, with deletes before their inserts, rows that come back, repeated rows and ties."""
    rng = random.Random(21)
    cfg = config.SynopsisConfig(leaves=4, sample_rate=0.5, catch_up=1.0, extremes=3)
    start = [(i, float(rng.randrange(40)), float(rng.randrange(12))) for i in range(300)]
    df = lambda found: spark.createDataFrame(found, "op string, id long, x double, v double")
    syn = Synopsis.build(df([("I", *r) for r in start]).drop("op"), ["x"], "v", ("id",), cfg)
    table = Counter(start)
    owed: Counter = Counter()
    for step in range(6):
        batch = []
        for _ in range(60):
            if rng.random() < 0.6 and table:
                row = rng.choice(sorted(table))
                batch.append(("D", *row))
            else:
                row = (rng.randrange(400), float(rng.randrange(40)), float(rng.randrange(-3, 15)))
                if rng.random() < 0.2:
                    owed[row] += 1  # its delete comes first
                    batch.append(("D", *row))
                else:
                    batch.append(("I", *row))
        if step % 2:
            batch += [("I", *r) for r in owed.elements()]
            owed.clear()
        for op, *row in batch:
            table[tuple(row)] += 1 if op == "I" else -1
        table = Counter({k: n for k, n in table.items() if n})
        syn = syn.apply(df(batch), step)
        assert syn.apply(df(batch), step) is syn
        syn = syn.compact() if step == 3 else syn
        if owed or min(table.values()) < 0:
            continue
        place = lambda x: next(i for i, ((lo, hi),) in enumerate(syn.leaves.boxes) if lo <= x < hi)
        leaves: dict = {}
        for (_, x, v), n in table.items():
            leaves.setdefault(place(x), []).extend([v] * n)
        got = {r["leaf_id"]: r for r in syn.summary().collect()}
        for leaf, values in leaves.items():
            r = got[leaf]
            assert (r["cnt"], r["sum"]) == (len(values), sum(values))
            assert r["min"] == min(values) if r["min_known"] else r["min"] is None
            assert r["max"] == max(values) if r["max_known"] else r["max"] is None
        all_rows = spark.createDataFrame([r for r, n in table.items() for _ in range(n)], "id long, x double, v double")
        sampled = Counter((r["id"], r["x"], r["v"]) for r in sampling.hash_sample(all_rows, 0.5, "id").collect())
        assert Counter((r["id"], r["x"], r["v"]) for r in syn.rows_now().collect()) == sampled
        fresh = syn.rescan(all_rows).summary().collect()
        assert all((r["min"], r["max"]) == (min(leaves[r["leaf_id"]]), max(leaves[r["leaf_id"]])) for r in fresh if r["leaf_id"] in leaves)


def test_hybrid_against_brute_force(spark):
    """Workloads of one and two attributes against loops over leaves and sample rows."""
    rng = random.Random(22)
    rows = [(i, rng.random() * 10, rng.random() * 10, rng.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, x double, y double, v double")
    sample = sampling.hash_sample(df, 0.1, "id")
    kept = {r["id"] for r in sample.collect()}
    for attrs, leaves in ((["x"], partition.equal_depth(df, "x", 9)), (["x", "y"], partition.kd(df, ["x", "y"], 8, target="v"))):
        at = {"x": 1, "y": 2}
        queries = [RangeQuery("v", tuple((a, *sorted((rng.random() * 12 - 1, rng.random() * 12 - 1))) for a in attrs[: 1 + i % len(attrs)])) for i in range(40)] + [RangeQuery("v", ()), RangeQuery("v", (("x", 3.0, 3.0),))]
        sums = summary.summarise(df, leaves, "v")
        for pooled in (False, True):
            got = {r["qid"]: r for r in estimate.hybrid(queries, leaves, sums, leaves.place(sample), "v", pooled=pooled).collect()}
            for i, q in enumerate(queries):
                inside = lambda r: all(lo <= r[at[a]] < hi for a, lo, hi in q.box)  # noqa: E731, B023
                cnt = total = 0.0
                ends, parts = [], []
                for box in leaves.boxes:
                    mine = [r for r in rows if all(lo <= r[at[a]] < hi for a, (lo, hi) in zip(leaves.attrs, box, strict=True))]
                    asked = [q.edges(a) for a in leaves.attrs]
                    if any(max(lo, a) >= min(hi, b) for (lo, hi), (a, b) in zip(box, asked, strict=True)):
                        continue
                    if all(a <= lo and hi <= b for (lo, hi), (a, b) in zip(box, asked, strict=True)):
                        cnt, total = cnt + len(mine), total + sum(r[3] for r in mine)
                        ends += [r[3] for r in mine]
                        continue
                    some = [r for r in mine if r[0] in kept]
                    hit = [r[3] for r in some if inside(r)]
                    ends += hit
                    parts.append((len(mine), len(some), len(hit), sum(hit)))
                if pooled and parts:
                    n = sum(p[1] for p in parts)
                    parts = [(sum(p[0] for p in parts), n, sum(p[2] for p in parts), sum(p[3] for p in parts))]
                for population, n, m, s in parts:
                    cnt, total = cnt + population / n * m, total + population / n * s
                r = got[i]
                assert r["cnt"] == pytest.approx(cnt) and r["sum"] == pytest.approx(total)
                assert (r["min"], r["max"]) == ((min(ends), max(ends)) if ends else (None, None))


def test_grid_of_many_queries_is_coarsened_and_stays_exact(spark):
    rng = random.Random(23)
    rows = [(float(rng.randrange(30)), float(rng.randrange(30)), float(rng.randrange(30)), rng.random()) for _ in range(2000)]
    df = spark.createDataFrame(rows, "x double, y double, z double, v double")
    queries = [RangeQuery("v", tuple((a, *map(float, sorted((rng.randrange(-2, 33), rng.randrange(-2, 33))))) for a in rng.sample("xyz", rng.randint(1, 3)))) for _ in range(120)]
    grid = estimate.Grid(queries, ["x", "y", "z"], most_pairs=2000)
    assert grid.pairs() <= 2000 and len(grid.cut_pairs()[0]) == grid.pairs()
    got = {r["qid"]: (r["cnt"], r["sum"]) for r in estimate.exact(df, queries, "v").collect()}
    for i, q in enumerate(queries):
        hit = [r[3] for r in rows if all(lo <= r["xyz".index(a)] < hi for a, lo, hi in q.box)]
        assert got[i][0] == len(hit) and got[i][1] == pytest.approx(sum(hit))


def test_null_attributes_and_fine_sums(spark):
    rows = [(i, None if i % 10 == 0 else float("nan") if i % 10 == 1 else float(i), 0.004) for i in range(1000)] + [(5000, 3.0, 1e17)]
    df = spark.createDataFrame(rows, "id long, x double, v double")
    syn = Synopsis.build(df, ["x"], "v", ("id",), config.SynopsisConfig(leaves=4, catch_up=1.0))
    whole = [RangeQuery("v", (("x", config.LOW, config.HIGH),))]
    got, want = syn.query(whole).first(), estimate.exact(df, whole, "v").first()
    assert got["cnt"] == want["cnt"] == 801 and got["sum"] == want["sum"] == pytest.approx(1e17)
    assert estimate.exact(df.filter("id < 1000"), [RangeQuery("v", ())], "v").first()["sum"] == pytest.approx(4.0)


def test_catch_up_may_come_after_changes(spark):
    df = spark.range(1000).select("id", F.col("id").cast("double").alias("x"), F.lit(1.0).alias("v"))
    syn = Synopsis.build(df, ["x"], "v", ("id",), config.SynopsisConfig(leaves=4, catch_up=1.0), ready=False)
    more = df.withColumn("id", F.col("id") + 5000).withColumn("op", F.lit("I"))
    later = syn.apply(more)
    whole = [RangeQuery("v", ())]
    for s in (syn, later):
        assert not s.ready
        with pytest.raises(NotReady):
            s.query(whole)
    assert later.catch_up(df).query(whole).first()["cnt"] == 2000.0
    with ThreadPoolExecutor(2) as pool:
        ready = syn.catch_up(df)
        assert {f.result()[0]["cnt"] for f in [ready.query_async(pool, whole) for _ in range(3)]} == {1000.0}
    assert ready.sampled() == ready.rows_now().count() and ready.rows().first()["cnt"] == 1000.0


def test_queries_read_the_stored_tables_alone(spark):
    syn = Synopsis.build(catalog.events(spark, SF), ["x"], "value", ("event_id",), config.SynopsisConfig(leaves=8, sample_rate=0.2, catch_up=1.0))
    syn = syn.apply(catalog._log(catalog.events(spark, SF).limit(50)))
    for df in (syn.rows_now(), syn.summary()):
        assert not any(SF in f for f in df.inputFiles())


def test_streaming_solvers_against_the_truth(spark, tmp_path):
    schema = "id long, x double, v double"
    old = spark.range(500).select("id", (F.col("id") % 50).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("v"))
    new = old.withColumn("id", F.col("id") + 1000)
    root, state = f"{tmp_path}/in", f"{tmp_path}/state"
    topics.create(spark, root)
    cfg = config.SynopsisConfig(leaves=4, sample_rate=0.5, catch_up=1.0)
    syn = Synopsis.build(old, ["x"], "v", ("id",), cfg)
    q = RangeQuery("v", ())
    consumers = [solver.SynopsisSolver("synopsis", f"{tmp_path}/out", synopsis=syn, state=state), solver.ExactSolver("truth", f"{tmp_path}/out", table=old)]
    text = lambda *lines: spark.createDataFrame([(x,) for x in lines], "value string")
    step = lambda some: solver.run(topics.stream(spark, root), some, syn.sample.select("id", "x", "v").schema, f"{tmp_path}/check").awaitTermination()
    topics.send(tables.to_lines(new), root, "data")
    topics.send(text(str(q), "save"), root, "query")
    topics.send(text("t0 1"), root, "tick")
    step(consumers)
    assert topics.describe(spark, root).collect() == [("data", 500), ("deletion", 0), ("query", 2), ("tick", 1)]
    topics.send(tables.to_lines(old.filter("id < 100")), root, "deletion")
    topics.send(text(str(q), "exit"), root, "query")
    # the solver is started anew from what it remembered
    again = solver.SynopsisSolver("synopsis", f"{tmp_path}/out", synopsis=solver.resume(spark, state, cfg), state=state)
    step([again, consumers[1]])
    assert again.done and [x for x, _ in consumers[0].times] == ["t0 1"]
    found = tables.read_results(spark, f"{tmp_path}/out", catalog.RESULT, truth="truth").select("qhash", "cnt", "sum", "is_truth", "time").collect()
    assert {(r["cnt"], r["is_truth"]) for r in found} == {(1000.0, True), (900.0, True), (1000.0, False), (900.0, False)}
    assert len({r["sum"] for r in found}) == 2 and {r["qhash"] for r in found} == {q.hash} and all(r["time"] >= 0 for r in found)
    topics.send(text("more"), root, "tick")
    before = again.synopsis
    again.take(solver.Messages.of(spark.createDataFrame([("data", "1,2.0,3.0")], "topic string, value string"), syn.sample.select("id", "x", "v").schema, 0))
    assert again.synopsis is before and schema


def test_kafka_rows_become_messages(spark):
    got = spark.createDataFrame([("data", bytearray(b"1,2"), 7)], "topic string, value binary, offset long")
    assert [tuple(r) for r in changes.messages(got).collect()] == [("data", "1,2")]


def test_loaders_and_workloads(spark, tmp_path):
    files = {
        "nyab": ("id,latitude,longitude\n1,40.64749,-73.97237\n2,,1.5\n", [(1, 4064749, -7397237)]),
        "mexborder": ("Port Name,State,Port Code,Border,Date,Measure,Value,Location\nA,B,207,C,03/01/2019 12:00:00 AM,T,3,P\nA,B,,C,03/01/2019 12:00:00 AM,T,3,P\n", None),
        "shopping": ("TIME,COUNT\n2017-01-03 10:20:30,5\n", None),
        "stock": ("pk,open,high,low,close,volume,idate\n1,2,3,4,5,6,7\n", [(2.0, 3.0, 4.0, 5.0, 7.0, 6.0)]),
        "taxi": ("pickup_date,pickup_datetime,dropoff_datetime,pickup_time,dropoff_date,dropoff_time,PULocationID,DOLocationID,trip_distance\n1,2,3,4,5,6,7,8,9\n", [(4.0, 9.0)]),
    }
    got = {}
    for name, (text, want) in files.items():
        (tmp_path / f"{name}.csv").write_text(text)
        got[name] = tables.load(spark, str(tmp_path / f"{name}.csv"), config.dataset(name)).collect()
        if want:
            assert [tuple(r) for r in got[name]] == want
    (row,) = got["mexborder"]
    assert (row["port"], row["idate"]) == ("207", pytest.approx(1551398400 / 1e6))
    (row,) = got["shopping"]
    assert (row["DATE"], row["TIME"], row["AMOUNT"], row["idate"], row["itime"]) == ("2017-01-03", "10:20:30", 5, 3, 102030)
    assert config.WORKLOADS["taxi"].file_name(2000) == "Taxi-RangeSumQuery-pickup_time-trip_distance-2000.txt" and len(config.DATASETS) == 19


def test_oracles_against_a_full_search():
    rng = np.random.default_rng(3)
    for n in (5, 20, 30):
        v = rng.normal(0, 5, n)
        oracle = partition.VarianceOracle(v, 10 * n, least_rows=3)
        for i, j in ((0, n - 1), (1, n - 2)):
            best = max(100 * (v[a : b + 1] ** 2).sum() - v[a : b + 1].sum() ** 2 / (j - i + 1) for a in range(i, j + 1) for b in range(a + 2, j + 1) if b <= j)
            assert oracle(i, j) == pytest.approx(max(best, 0.0))
    points, values = rng.random((30, 2)), rng.normal(0, 5, 30)
    want = max(partition.VarianceOracle(values[np.argsort(points[:, a])], 300, 3)(0, 29) for a in (0, 1))
    assert partition.box_oracle(points, values, 10.0, 3) == pytest.approx(want)
    assert partition.budget_bounds(np.array([2.0, -3.0]), 10) == (4.5, 900.0)


def test_variance_cuts_against_all_cuts():
    """Three buckets of a short sample: no choice of cuts has a largest oracle value much below that of the cuts found."""
    rng = np.random.default_rng(5)
    x = np.arange(40.0)
    y = np.where(x < 30, rng.normal(0, 1, 40), rng.normal(0, 20, 40))
    oracle = partition.VarianceOracle(y, 400, 4)
    worst = lambda cuts: max(oracle(a, b - 1) for a, b in zip([0, *cuts], [*cuts, 40], strict=True))
    best = min(worst([a, b]) for a in range(4, 33) for b in range(a + 4, 37))
    assert worst([int(c) for c in partition.variance_cuts(x, y, 400, 3, least_rows=4)]) <= 1.25 * best


def test_reports_of_a_tree(spark):
    leaves = partition.from_cuts("a", [3.0, 5.0])
    assert leaves.show() == "  leaf 0\na < 3\n    leaf 1\n  a < 5\n    leaf 2" or "a < 5" in leaves.show()
    nodes = [tuple(r) for r in leaves.inner(spark).collect()]
    assert nodes == [(0, 0, 0, 0), (0, 1, 1, 1), (0, 2, 2, 2), (1, 0, 0, 1), (1, 1, 2, 2), (2, 0, 0, 2)]
    edges = spark.createDataFrame([(-1e308,), (2.5,), (1e308,)], "e double").select(geometry.edge_text(F.col("e"))).collect()
    assert [r[0] for r in edges] == ["MIN", "2.50", "MAX"]


def test_single_rows_leave_a_sample(spark):
    df = spark.createDataFrame([(i, i // 4) for i in range(12)], "id long, leaf_id int")
    for n in (0, 5, 11):
        assert sorted(r["id"] for r in sampling.evict_nth(df, n, "id").collect()) == [i for i in range(12) if i != n]
    assert sampling.evict_nth(df, 99, "id").count() == 12
    assert workload.random_pair(df, "id", 1).count() == 2


def test_results_and_scripts(spark, tmp_path):
    df = spark.createDataFrame([(0, "q", 2.0)], "qid int, query string, cnt double")
    tables.write_results(df, f"{tmp_path}/groundtruth")
    tables.write_results(df.withColumn("cnt", F.lit(2.5)), f"{tmp_path}/synopsis")
    found = tables.read_results(spark, str(tmp_path), "qid int, query string, cnt double").collect()
    assert sorted((r["cnt"], r["is_truth"]) for r in found) == [(2.0, True), (2.5, False)]
    both = [spark.createDataFrame([(0, 1.0, None)], "qid int, cnt double, min double") for _ in range(2)]
    accuracy.assert_close(*both, columns=("cnt", "min"))
    with pytest.raises(AssertionError):
        accuracy.assert_close(both[0], both[1].withColumn("cnt", F.lit(1.1)), columns=("cnt", "min"))
    for kind in ("query", "insert_delete", "tenths", "evict"):
        assert all(workload.parse_command(x) for x in workload.phases(1000, 5, kind))


def test_a_shared_folder_is_needed_on_a_cluster(spark):
    class Session:
        """A cluster's session without a folder."""

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

            class _jsc:
                @staticmethod
                def sc():
                    class Context:
                        @staticmethod
                        def getCheckpointDir():  # noqa: N802
                            class Nothing:
                                getOrElse = staticmethod(lambda d: d)  # noqa: N815

                            return Nothing

                    return Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session)


def test_command_line(spark, tmp_path):
    rng = random.Random(31)
    columns = config.dataset("intelwireless").columns
    (tmp_path / "rows.csv").write_text(",".join(columns) + "\n" + "\n".join(",".join(["d", "t", "1", "m", *(f"{rng.random() * 1000:.3f}" for _ in columns[4:])]) for _ in range(2000)) + "\n")
    csv, file, out = (str(tmp_path / x) for x in ("rows.csv", "queries", "out"))
    cli.main(["workload", "-n", "20", "intel", csv, file], spark)
    assert len(tables.read_workload(spark, file)) == 20
    cli.main(["run", "--samplerate", "0.3", "--catchup", "1", "-k", "8", "--out", out, "intel", csv, file], spark)
    found = tables.read_results(spark, out, "qid int, query string, qhash string, cnt double, sum double, avg double, min double, max double").collect()
    assert len(found) == 60 and sum(r["is_truth"] for r in found) == 20
    with pytest.raises(SystemExit):
        cli.main(["run", "nothing", csv, file, "--out", out], spark)


def test_kd_splits_where_queries_may_err_most(spark):
    rng = np.random.default_rng(8)
    points = rng.random((200, 2))
    values = np.where(points[:, 0] < 0.5, rng.normal(0, 1, 200), rng.normal(0, 50, 200))
    df = spark.createDataFrame([(float(a), float(b), float(v)) for (a, b), v in zip(points, values, strict=True)], "a double, b double, v double")
    leaves = partition.kd(df, ["a", "b"], 3, target="v", population=2000)
    # the right half errs most, so it is the one that is split at depth 1
    cut = float(np.sort(points[:, 0])[100])
    assert [box[0] for box in leaves.boxes] == [(config.LOW, cut), (cut, config.HIGH), (cut, config.HIGH)]
    plain = partition.kd(df, ["a", "b"], 3)
    assert [box[0] for box in plain.boxes] == [(config.LOW, cut), (config.LOW, cut), (cut, config.HIGH)]


def test_streams_from_the_beginning_or_from_now(spark, tmp_path):
    root = f"{tmp_path}/in"
    topics.create(spark, root)
    send = lambda *lines: topics.send(spark.createDataFrame([(x,) for x in lines], "value string"), root, "tick")
    send("t0")
    time.sleep(1.1)
    late, whole = topics.stream(spark, root, latest=True), topics.stream(spark, root, files_a_batch=1)
    time.sleep(1.1)
    send("t1")
    for df, want in ((late, ["t1"]), (whole, ["t0", "t1"])):
        name = f"seen_{len(want)}"
        df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
        assert sorted(r["value"] for r in spark.table(name).collect()) == want
    assert topics.topics(spark, root) == sorted(topics.TOPICS) and topics.size(spark, root, "tick") == 2


def test_sizes_of_samples():
    cfg = config.SynopsisConfig(leaves=10, sample_rate=0.02, oversample=2.0)
    assert (cfg.reservoir(1000), cfg.partition_sample) == (40, 768)
