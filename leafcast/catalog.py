"""Registered queries of the engine and, for each, DuckDB SQL over the same tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .config import HIGH, LOW, SynopsisConfig
from .functions import geometry, scalars
from .operators import accuracy, estimate, partition, sampling, summary, workload
from .operators.partition import Leaves
from .plans.query import RangeQuery, any_of
from .shared import new_path
from .sources import tables
from .streaming import changes, solver, topics
from .synopsis import Synopsis

K = 16
PART = int(1.2 * 64 * K)
RATE = 0.1
DAY0 = 1704067200.0
QUERIES = [RangeQuery("value", (("x", lo, hi),)) for lo, hi in [(LOW, HIGH)] + [(DAY0 + a * 86400, DAY0 + b * 86400) for a, b in ((0.5, 12.25), (3.0, 27.5), (10.1, 10.9), (-5.0, 5.0), (20.0, 60.0), (28.0, 29.9))]]
ND = ("l_quantity", "l_extendedprice", "l_discount")
ND_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
ND_QUERIES = [RangeQuery("l_extendedprice", b) for b in ((("l_discount", 0.02, 0.07), ("l_extendedprice", 10000.0, 60000.0), ("l_quantity", 10.0, 40.0)), (("l_quantity", 5.0, 20.0),), (("l_discount", 0.0, 0.05), ("l_extendedprice", 5000.0, 90000.0)), (("l_discount", 0.9, 1.0),))]

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    def add(f):
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", scalars.seconds(F.col("ts")).alias("x"), "value", "event_type", "user_id")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def event_leaves(ev: DataFrame, k: int = K) -> Leaves:
    return partition.equal_depth(sampling.bottom(ev, PART, "event_id"), "x", k)


def line_leaves(li: DataFrame) -> Leaves:
    return partition.kd(sampling.bottom(li, 1024, *ND_KEY), list(ND), 8)


def r4(df: DataFrame, *columns: str) -> DataFrame:
    """Four places; eight of averages, as many of these lie on a half at four, where the order of additions decides."""
    return df.withColumns({c: F.round(F.col(c), 8 if c == "avg" else 4) for c in columns})


def r2(df: DataFrame) -> DataFrame:
    """For sums in the billions: two places of the sum, six of the average."""
    return df.withColumns({"sum": F.round("sum", 2), "avg": F.round("avg", 6)})


# SQL parts
EV = "ev AS (SELECT event_id, epoch_us(ts) / 1e6 AS x, value, event_type, user_id FROM events)"


def cuts_sql(source: str = "ev", key: str = "event_id", attr: str = "x", n: int = PART, k: int = K) -> str:
    return f"""samp AS (SELECT {attr} FROM (SELECT {attr}, row_number() OVER (ORDER BY sha256('p|' || {key}::VARCHAR), {key}) AS r FROM {source}) WHERE r <= {n}),
ranked AS (SELECT {attr}, row_number() OVER (ORDER BY {attr}) AS rn, count(*) OVER () AS n FROM samp),
cuts AS (SELECT DISTINCT {attr} AS cut FROM ranked WHERE rn % (n // {k}) = 0 AND rn // (n // {k}) < {k}),
leaves AS (SELECT (row_number() OVER (ORDER BY lo) - 1)::INTEGER AS leaf_id, lo AS lo_x, hi AS hi_x FROM (
  SELECT -1e308::DOUBLE AS lo, min(cut) AS hi FROM cuts UNION ALL SELECT cut, coalesce(lead(cut) OVER (ORDER BY cut), 1e308::DOUBLE) FROM cuts))"""


#: Sums of doubles depend on the order of additions in their last digits, so registered queries round what they return.
SUM = "sum({}::DOUBLE)"
SUMMARY = f"summary AS (SELECT leaf_id, count(*) AS cnt, {SUM.format('value')} AS sum, min(value) AS min, max(value) AS max FROM ev JOIN leaves ON x >= lo_x AND x < hi_x GROUP BY leaf_id)"
SAMPLE = f"sample AS (SELECT event_id, x, value, leaf_id FROM ev JOIN leaves ON x >= lo_x AND x < hi_x WHERE substr(sha256('s|' || event_id::VARCHAR), 1, 8) < '{scalars.below(RATE)}')"
BASE = f"WITH {EV}, {cuts_sql()}, {SUMMARY}, {SAMPLE}"


def queries_sql(queries: list[RangeQuery], attrs: tuple[str, ...]) -> str:
    rows = ", ".join("(" + ", ".join([str(i), *(f"{e!r}::DOUBLE" for a in attrs for e in q.edges(a))]) + ")" for i, q in enumerate(queries))
    return f"q AS (SELECT * FROM (VALUES {rows}) AS t(qid, {', '.join(f'lo_{a}, hi_{a}' for a in attrs)}))"


def hybrid_sql(queries: list[RangeQuery], attrs: tuple[str, ...], target: str, leaf: str, pooled: bool = False, budget: int | None = None, key: str = "event_id") -> str:
    """CTEs classes to answer, over summary, sample and leaves with the names lo_a, hi_a."""
    both = " AND ".join(f"greatest(q.lo_{a}, l.lo_{a}) < least(q.hi_{a}, l.hi_{a})" for a in attrs)
    over = " AND ".join(f"q.lo_{a} <= l.lo_{a} AND l.hi_{a} <= q.hi_{a}" for a in attrs)
    inside = " AND ".join(f"s.{a} >= c.lo_{a} AND s.{a} < c.hi_{a}" for a in attrs)
    cap = f"QUALIFY row_number() OVER (PARTITION BY c.qid ORDER BY sha256('b|' || s.{key}::VARCHAR), s.{key}) <= {budget}" if budget else ""
    one = pooled or budget is not None
    part = (
        """SELECT e.qid, sum(cnt) / sum(n) * sum(m) AS cnt, sum(cnt) / sum(n) * coalesce(sum(s), 0) AS sum, min(e.min) AS min, max(e.max) AS max FROM each_leaf e GROUP BY e.qid"""
        if one
        else "SELECT qid, coalesce(cnt / n * m, cnt * 0.5) AS cnt, CASE WHEN n IS NULL THEN leaf_sum * 0.5 ELSE cnt / n * coalesce(s, 0) END AS sum, min, max FROM each_leaf"
    )
    return f"""{queries_sql(queries, attrs)},
classes AS (SELECT q.*, l.leaf_id, {over} AS covered FROM q JOIN leaves l ON {both}),
rows_in AS (SELECT c.qid, c.leaf_id, s.{target} AS v, ({inside}) AS ins FROM classes c JOIN sample s ON s.leaf_id = c.leaf_id WHERE NOT c.covered {cap}),
found AS (SELECT qid, leaf_id, count(*)::DOUBLE AS n, count(*) FILTER (WHERE ins)::DOUBLE AS m, sum(v::DOUBLE) FILTER (WHERE ins) AS s,
  min(v) FILTER (WHERE ins) AS min, max(v) FILTER (WHERE ins) AS max FROM rows_in GROUP BY qid, leaf_id),
each_leaf AS (SELECT c.qid, c.leaf_id, u.cnt::DOUBLE AS cnt, u.sum AS leaf_sum, f.n, f.m, f.s, f.min, f.max FROM classes c JOIN summary u ON u.leaf_id = c.leaf_id LEFT JOIN found f ON f.qid = c.qid AND f.leaf_id = c.leaf_id WHERE NOT c.covered),
parts AS (SELECT c.qid, u.cnt::DOUBLE AS cnt, u.sum, u.min, u.max FROM classes c JOIN summary u ON u.leaf_id = c.leaf_id WHERE c.covered UNION ALL {part}),
answer AS (SELECT q.qid, coalesce(sum(p.cnt), 0) AS cnt, coalesce(sum(p.sum), 0) AS sum, min(p.min) AS min, max(p.max) AS max FROM q LEFT JOIN parts p ON p.qid = q.qid GROUP BY q.qid)"""


ANSWER = "SELECT qid, round(cnt, 4) AS cnt, round(sum, 4) AS sum, round(CASE WHEN cnt > 0 THEN sum / cnt END, 8) AS avg, min, max FROM answer"
EXACT = f"exact AS (SELECT q.qid, count(x) AS cnt, coalesce({SUM.format('value')}, 0) AS sum, min(value) AS min, max(value) AS max FROM q LEFT JOIN ev ON x >= lo_x AND x < hi_x GROUP BY q.qid)"
EXACT_OUT = "SELECT qid, cnt, round(sum, 2) AS sum, round(CASE WHEN cnt > 0 THEN sum / cnt END, 6) AS avg, min, max FROM "
SUMMARY_OUT = "SELECT leaf_id, cnt, round(sum, 4) AS sum, min, max FROM summary"

ND_CONDITION = " AND ".join(f"{a} >= lo_{a} AND {a} < hi_{a}" for a in ND)
KD = f"""keyed AS (SELECT *, sha256('p|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey) AS h FROM lineitem),
samp AS (SELECT * FROM keyed ORDER BY h, {', '.join(ND_KEY)} LIMIT 1024),
c1 AS (SELECT l_quantity AS v FROM (SELECT l_quantity, row_number() OVER (ORDER BY l_quantity) AS rn, count(*) OVER () AS n FROM samp) WHERE rn = n // 2 + 1),
s1 AS (SELECT s.*, CASE WHEN l_quantity < c1.v THEN 0 ELSE 1 END AS b1 FROM samp s, c1),
c2 AS (SELECT b1, l_extendedprice AS v FROM (SELECT b1, l_extendedprice, row_number() OVER (PARTITION BY b1 ORDER BY l_extendedprice) AS rn, count(*) OVER (PARTITION BY b1) AS n FROM s1) WHERE rn = n // 2 + 1),
s2 AS (SELECT s.*, CASE WHEN l_extendedprice < c2.v THEN 0 ELSE 1 END AS b2 FROM s1 s JOIN c2 USING (b1)),
c3 AS (SELECT b1, b2, l_discount AS v FROM (SELECT b1, b2, l_discount, row_number() OVER (PARTITION BY b1, b2 ORDER BY l_discount) AS rn, count(*) OVER (PARTITION BY b1, b2) AS n FROM s2) WHERE rn = n // 2 + 1),
leaves AS (SELECT (4 * c3.b1 + 2 * c3.b2 + s)::INTEGER AS leaf_id,
  CASE WHEN c3.b1 = 0 THEN -1e308::DOUBLE ELSE c1.v END AS lo_l_quantity, CASE WHEN c3.b1 = 0 THEN c1.v ELSE 1e308::DOUBLE END AS hi_l_quantity,
  CASE WHEN c3.b2 = 0 THEN -1e308::DOUBLE ELSE c2.v END AS lo_l_extendedprice, CASE WHEN c3.b2 = 0 THEN c2.v ELSE 1e308::DOUBLE END AS hi_l_extendedprice,
  CASE WHEN s = 0 THEN -1e308::DOUBLE ELSE c3.v END AS lo_l_discount, CASE WHEN s = 0 THEN c3.v ELSE 1e308::DOUBLE END AS hi_l_discount
  FROM c3 JOIN c2 ON c2.b1 = c3.b1, c1, (VALUES (0), (1)) AS side(s))"""
ND_SUMMARY = f"summary AS (SELECT leaf_id, count(*) AS cnt, {SUM.format('l_extendedprice')} AS sum, min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem JOIN leaves ON {ND_CONDITION} GROUP BY leaf_id)"
ND_SAMPLE = f"sample AS (SELECT k.*, leaf_id FROM lineitem k JOIN leaves ON {ND_CONDITION} WHERE substr(sha256('s|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey), 1, 8) < '{scalars.below(RATE)}')"


@query(f"WITH {EV}, {queries_sql(QUERIES, ('x',))}, {EXACT} {EXACT_OUT} exact")
def exact_range_1d(spark, sf):
    return r2(estimate.exact(events(spark, sf), QUERIES, "value"))


@query(f"WITH {queries_sql(ND_QUERIES, ND)}, exact AS (SELECT q.qid, count(l_quantity) AS cnt, coalesce({SUM.format('l_extendedprice')}, 0) AS sum, min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM q LEFT JOIN lineitem ON {ND_CONDITION} GROUP BY q.qid) {EXACT_OUT} exact")
def exact_range_nd(spark, sf):
    return r2(estimate.exact(lineitem(spark, sf), ND_QUERIES, "l_extendedprice"))


@query("SELECT o_orderkey, '0x' || substr(sha256(o_orderkey || ',' || o_custkey || ',' || o_orderstatus), 1, 16) AS tuple_hash FROM orders")
def tuple_hash(spark, sf):
    line = F.concat_ws(",", *(F.col(c).cast("string") for c in ("o_orderkey", "o_custkey", "o_orderstatus")))
    return table(spark, sf, "orders").select("o_orderkey", scalars.line_hash(line).alias("tuple_hash"))


@query("SELECT o_orderkey, substr(sha256('t;k:[' || o_orderkey || ', ' || o_custkey || ']'), 1, 10) AS query_hash FROM orders")
def query_hash(spark, sf):
    text = F.concat(F.lit("t;k:["), F.col("o_orderkey").cast("string"), F.lit(", "), F.col("o_custkey").cast("string"), F.lit("]"))
    return table(spark, sf, "orders").select("o_orderkey", scalars.query_hash(text).alias("query_hash"))


@query(f"SELECT event_id, value FROM events WHERE substr(sha256('s|' || event_id::VARCHAR), 1, 8) < '{scalars.below(0.01)}'")
def hash_sample(spark, sf):
    return sampling.hash_sample(table(spark, sf, "events"), 0.01, "event_id").select("event_id", "value")


@query(f"SELECT {', '.join(ND_KEY)} FROM lineitem ORDER BY sha256('p|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey), {', '.join(ND_KEY)} LIMIT 500")
def bottomk_sample(spark, sf):
    return sampling.bottom(lineitem(spark, sf), 500, *ND_KEY).select(*ND_KEY)


@query(f"WITH {EV}, {cuts_sql()} SELECT cut FROM cuts")
def equal_depth_cuts(spark, sf):
    at = event_leaves(events(spark, sf)).table(spark)
    return at.filter(F.col("lo_x") > LOW).select(F.col("lo_x").alias("cut"))


@query(f"WITH {EV}, {cuts_sql()} SELECT event_id, leaf_id FROM ev JOIN leaves ON x >= lo_x AND x < hi_x")
def leaf_assign_1d(spark, sf):
    ev = events(spark, sf)
    return ev.select("event_id", event_leaves(ev).leaf_id().alias("leaf_id"))


@query(f"WITH {cuts_sql('orders', 'o_orderkey', 'o_totalprice', 1200, 32)} SELECT leaf_id, count(*) AS cnt FROM orders JOIN leaves ON o_totalprice >= lo_x AND o_totalprice < hi_x GROUP BY leaf_id")
def leaf_counts_orders(spark, sf):
    o = table(spark, sf, "orders")
    leaves = partition.equal_depth(sampling.bottom(o, 1200, "o_orderkey"), "o_totalprice", 32)
    return o.groupBy(leaves.leaf_id().alias("leaf_id")).agg(F.count("*").alias("cnt"))


@query(f"{BASE} {SUMMARY_OUT}")
def leaf_summary_full(spark, sf):
    ev = events(spark, sf)
    return r4(summary.summarise(ev, event_leaves(ev), "value"), "sum")


@query(f"WITH {EV}, {cuts_sql()}, seen AS (SELECT * FROM ev WHERE substr(sha256('c|' || event_id::VARCHAR), 1, 8) < '{scalars.below(0.2)}'), f AS (SELECT (SELECT count(*) FROM ev)::DOUBLE / (SELECT count(*) FROM seen) AS f) SELECT leaf_id, round(count(*) * any_value(f), 4) AS cnt, round({SUM.format('value')} * any_value(f), 4) AS sum, min(value) AS min, max(value) AS max FROM seen JOIN leaves ON x >= lo_x AND x < hi_x, f GROUP BY leaf_id")
def leaf_summary_scaled(spark, sf):
    ev = events(spark, sf)
    seen = sampling.hash_sample(ev, 0.2, "event_id", salt="c")
    return r4(summary.scale(summary.summarise(seen, event_leaves(ev), "value"), ev.count(), seen.count()), "cnt", "sum")


@query(f"SELECT count(*) AS cnt, round({SUM.format('value')}, 2) AS sum, min(value) AS min, max(value) AS max FROM events")
def leaf_totals(spark, sf):
    return summary.totals(leaf_summary_full(spark, sf)).withColumn("sum", F.round("sum", 2))


@query(f"{BASE} SELECT l.leaf_id, lo_x, hi_x, coalesce(cnt, 0) AS cnt, round(coalesce(sum, 0), 4) AS sum, coalesce((SELECT count(*) FROM sample s WHERE s.leaf_id = l.leaf_id), 0) AS sampled FROM leaves l LEFT JOIN summary USING (leaf_id)")
def strata_report(spark, sf):
    ev = events(spark, sf)
    leaves = event_leaves(ev)
    return r4(summary.report(leaves.table(spark), summary.summarise(ev, leaves, "value"), _sample(ev, leaves)), "sum")


def _sample(ev: DataFrame, leaves: Leaves) -> DataFrame:
    return sampling.hash_sample(ev, RATE, "event_id").withColumn("leaf_id", leaves.leaf_id())


EXTREMES = " UNION ALL ".join(
    f"SELECT leaf_id, '{side}' AS side, r AS rank, value, event_id AS key FROM (SELECT leaf_id, value, event_id, row_number() OVER (PARTITION BY leaf_id ORDER BY value{order}, event_id)::INTEGER AS r FROM ev JOIN leaves ON x >= lo_x AND x < hi_x) WHERE r <= 10"
    for side, order in (("min", ""), ("max", " DESC"))
)


@query(f"WITH {EV}, {cuts_sql()} {EXTREMES}")
def topk_extremes(spark, sf):
    ev = events(spark, sf)
    return summary.extremes(ev, event_leaves(ev), "value", "event_id")


@query(f"{BASE} {SUMMARY_OUT}")
def summary_merge(spark, sf):
    ev = events(spark, sf)
    leaves = event_leaves(ev)
    return r4(summary.merge(*(summary.summarise(ev.filter(F.col("event_id") % 2 == i), leaves, "value") for i in (0, 1))), "sum")


@query(f"WITH {EV}, {cuts_sql()} SELECT leaf_id, count(*) FILTER (WHERE event_id % 3 <> 0) AS cnt, round(coalesce(sum(value) FILTER (WHERE event_id % 3 <> 0), 0), 4) AS sum FROM ev JOIN leaves ON x >= lo_x AND x < hi_x GROUP BY leaf_id")
def summary_retract(spark, sf):
    ev = events(spark, sf)
    leaves = event_leaves(ev)
    return r4(summary.retract(summary.summarise(ev, leaves, "value"), summary.summarise(ev.filter("event_id % 3 = 0"), leaves, "value")), "sum")


@query(f"WITH {EV}, {cuts_sql()}, {queries_sql(QUERIES, ('x',))} SELECT qid, leaf_id, (q.lo_x <= l.lo_x AND l.hi_x <= q.hi_x) AS covered FROM q JOIN leaves l ON greatest(q.lo_x, l.lo_x) < least(q.hi_x, l.hi_x)")
def classify_leaves_1d(spark, sf):
    from .plans.query import query_table

    at = event_leaves(events(spark, sf)).table(spark)
    return estimate.classify(query_table(spark, QUERIES, ["x"]), at, ["x"]).select("qid", "leaf_id", "covered")


def _hybrid(spark, sf, **how) -> DataFrame:
    ev = events(spark, sf)
    leaves = event_leaves(ev)
    found = estimate.hybrid(QUERIES, leaves, summary.summarise(ev, leaves, "value"), _sample(ev, leaves), "value", **how)
    return r4(found, "cnt", "sum", "avg")


@query(f"{BASE}, {hybrid_sql(QUERIES, ('x',), 'value', 'leaves')} {ANSWER}")
def hybrid_1d(spark, sf):
    return _hybrid(spark, sf)


@query(f"{BASE}, {hybrid_sql(QUERIES, ('x',), 'value', 'leaves')} SELECT qid, min, max FROM answer")
def hybrid_1d_minmax(spark, sf):
    return _hybrid(spark, sf).select("qid", "min", "max")


@query(f"{BASE}, {hybrid_sql(QUERIES, ('x',), 'value', 'leaves', pooled=True)} {ANSWER}")
def hybrid_1d_pooled(spark, sf):
    return _hybrid(spark, sf, pooled=True)


@query(f"{BASE}, {hybrid_sql(QUERIES, ('x',), 'value', 'leaves', budget=40)} {ANSWER}")
def hybrid_budget_cap(spark, sf):
    return _hybrid(spark, sf, budget=40, key="event_id")


UNIFORM = f"smp AS (SELECT * FROM ev WHERE substr(sha256('s|' || event_id::VARCHAR), 1, 8) < '{scalars.below(RATE)}'), f AS (SELECT (SELECT count(*) FROM ev)::DOUBLE / (SELECT count(*) FROM smp) AS f)"


@query(f"WITH {EV}, {queries_sql(QUERIES, ('x',))}, {UNIFORM}, a AS (SELECT qid, count(x) * any_value(f) AS cnt, coalesce({SUM.format('value')}, 0) * any_value(f) AS sum, min(value) AS min, max(value) AS max FROM q LEFT JOIN smp ON x >= lo_x AND x < hi_x, f GROUP BY qid) SELECT qid, round(cnt, 4) AS cnt, round(sum, 4) AS sum, round(CASE WHEN cnt > 0 THEN sum / cnt END, 8) AS avg, min, max FROM a")
def uniform_estimate(spark, sf):
    ev = events(spark, sf)
    s = sampling.hash_sample(ev, RATE, "event_id")
    return r4(estimate.from_sample(s, QUERIES, "value", ev.count(), s.count()), "cnt", "sum", "avg")


@query(f"WITH {EV}, {queries_sql(QUERIES, ('x',))}, smp AS (SELECT * FROM ev ORDER BY event_id LIMIT 1000), f AS (SELECT (SELECT count(*) FROM ev)::DOUBLE / (SELECT count(*) FROM smp) AS f), a AS (SELECT qid, count(x) * any_value(f) AS cnt, coalesce({SUM.format('value')}, 0) * any_value(f) AS sum, min(value) AS min, max(value) AS max FROM q LEFT JOIN smp ON x >= lo_x AND x < hi_x, f GROUP BY qid) SELECT qid, round(cnt, 4) AS cnt, round(sum, 4) AS sum, round(CASE WHEN cnt > 0 THEN sum / cnt END, 8) AS avg, min, max FROM a")
def first_k_estimate(spark, sf):
    ev = events(spark, sf)
    return r4(estimate.from_sample(sampling.first_rows(ev, 1000, "event_id"), QUERIES, "value", ev.count(), 1000), "cnt", "sum", "avg")


@query(f"WITH {KD} SELECT (SELECT v FROM c1) AS cut")
def median_split(spark, sf):
    leaves = partition.kd(sampling.bottom(lineitem(spark, sf), 1024, *ND_KEY), list(ND), 2)
    return leaves.table(spark).filter("leaf_id = 1").select(F.col("lo_l_quantity").alias("cut"))


SAMP = KD[: KD.index("c1 AS")].rstrip().rstrip(",")
MEDIANS = "c AS (SELECT " + ", ".join(f"(SELECT {a} FROM (SELECT {a}, row_number() OVER (ORDER BY {a}) AS rn, count(*) OVER () AS n FROM samp) WHERE rn = n // 2 + 1) AS {a}" for a in ND) + ")"
SIDES = ", ".join(f"CASE WHEN b{i} = 0 THEN -1e308::DOUBLE ELSE c.{a} END AS lo_{a}, CASE WHEN b{i} = 0 THEN c.{a} ELSE 1e308::DOUBLE END AS hi_{a}" for i, a in enumerate(ND))


@query(f"WITH {SAMP}, {MEDIANS} SELECT (4 * b0 + 2 * b1 + b2)::INTEGER AS leaf_id, {SIDES} FROM c, (VALUES (0), (1)) x(b0), (VALUES (0), (1)) y(b1), (VALUES (0), (1)) z(b2)")
def cross_split(spark, sf):
    return partition.cross(sampling.bottom(lineitem(spark, sf), 1024, *ND_KEY), list(ND)).table(spark)


@query(f"WITH {KD} SELECT * FROM leaves")
def kd_leaves(spark, sf):
    return line_leaves(lineitem(spark, sf)).table(spark)


@query(f"WITH {KD} SELECT leaf_id, count(*) AS cnt FROM lineitem JOIN leaves ON {ND_CONDITION} GROUP BY leaf_id")
def leaf_assign_nd(spark, sf):
    li = lineitem(spark, sf)
    return li.groupBy(line_leaves(li).leaf_id().alias("leaf_id")).agg(F.count("*").alias("cnt"))


@query(f"WITH {KD}, {ND_SUMMARY}, {ND_SAMPLE}, {hybrid_sql(ND_QUERIES, ND, 'l_extendedprice', 'leaves')} {ANSWER.replace('round(sum, 4)', 'round(sum, 2)').replace('END, 8)', 'END, 6)')}")
def hybrid_nd(spark, sf):
    li = lineitem(spark, sf)
    leaves = line_leaves(li)
    sample = sampling.hash_sample(li, RATE, *ND_KEY).withColumn("leaf_id", leaves.leaf_id())
    return r4(r2(estimate.hybrid(ND_QUERIES, leaves, summary.summarise(li, leaves, "l_extendedprice"), sample, "l_extendedprice")), "cnt")


@query(f"WITH {KD}, b AS (SELECT leaf_id, lo_l_quantity AS lo, hi_l_quantity AS hi FROM leaves) SELECT a.leaf_id AS left_id, b.leaf_id AS right_id, greatest(a.lo, b.lo) < least(a.hi, b.hi) AS meets, a.lo <= b.lo AND b.hi <= a.hi AS holds, greatest(a.lo, b.lo) AS ilo, least(a.hi, b.hi) AS ihi, least(a.lo, b.lo) AS ulo, greatest(a.hi, b.hi) AS uhi FROM b a JOIN b b ON a.leaf_id < b.leaf_id")
def box_algebra(spark, sf):
    at = line_leaves(lineitem(spark, sf)).table(spark)
    a = ["l_quantity"]
    (ilo, ihi), (ulo, uhi) = geometry.intersection("a", "b", a[0]), geometry.hull("a", "b", a[0])
    both = at.alias("a").join(at.alias("b"), F.col("a.leaf_id") < F.col("b.leaf_id"))
    return both.select(F.col("a.leaf_id").alias("left_id"), F.col("b.leaf_id").alias("right_id"), geometry.intersects("a", "b", a).alias("meets"), geometry.covers("a", "b", a).alias("holds"), ilo.alias("ilo"), ihi.alias("ihi"), ulo.alias("ulo"), uhi.alias("uhi"))


@query("SELECT event_id, value FROM events WHERE event_id % 7 <> 0")
def delete_antijoin(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("event_id", "value").join(ev.filter("event_id % 7 = 0").select("event_id"), "event_id", "left_anti")


@query(f"SELECT event_id FROM events WHERE event_id % 7 = 0 AND substr(sha256('s|' || event_id::VARCHAR), 1, 8) < '{scalars.below(RATE)}'")
def sample_semijoin(spark, sf):
    ev = table(spark, sf, "events").select("event_id")
    return ev.filter("event_id % 7 = 0").join(sampling.hash_sample(ev, RATE, "event_id"), "event_id", "left_semi")


@query(f"{BASE} SELECT event_id, leaf_id FROM sample WHERE NOT (substr(sha256('e0|' || leaf_id::VARCHAR), 1, 8) < '{scalars.below(0.3)}' AND substr(sha256('h0|' || event_id::VARCHAR), 1, 8) < '{scalars.below(0.5)}')")
def strata_evict(spark, sf):
    ev = events(spark, sf)
    return sampling.evict(_sample(ev, event_leaves(ev)), 0.3, "event_id").select("event_id", "leaf_id")


LOG = "SELECT *, 1 AS s FROM ev UNION ALL SELECT *, -1 AS s FROM ev WHERE event_id % 5 = 0"
LOG_SUM = f"SELECT leaf_id, CAST(sum(s) AS BIGINT) AS cnt, round(sum(value * s), 4) AS sum FROM log JOIN leaves ON x >= lo_x AND x < hi_x GROUP BY leaf_id"


def _log(ev: DataFrame) -> DataFrame:
    return ev.withColumn("op", F.lit("I")).unionByName(ev.filter("event_id % 5 = 0").withColumn("op", F.lit("D")))


@query(f"WITH {EV}, {cuts_sql()}, log AS ({LOG}) {LOG_SUM}")
def changelog_agg(spark, sf):
    ev = events(spark, sf)
    return r4(summary.signed(_log(ev), event_leaves(ev), "value"), "sum")


@query(f"WITH {EV}, {cuts_sql()}, log AS ({LOG}) {LOG_SUM}")
def changelog_stream(spark, sf):
    ev = events(spark, sf)
    base = new_path(spark, "stream")
    log = _log(ev)
    log.write.parquet(f"{base}/log")
    name = f"leaf_changes_{uuid.uuid4().hex}"
    run = changes.leaf_changes(changes.read_changes(spark, f"{base}/log", log.schema, 2), event_leaves(ev), "value", name, f"{base}/state")
    run.awaitTermination()
    return r4(spark.table(name), "sum")


@query("SELECT event_id, round(sum(value) OVER w, 4) AS s1, round(sum(value * value) OVER w, 4) AS s2 FROM (SELECT event_id, value, ts FROM events ORDER BY sha256('p|' || event_id::VARCHAR), event_id LIMIT 500) WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def prefix_sums(spark, sf):
    from pyspark.sql.window import Window

    w = Window.orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    s = sampling.bottom(table(spark, sf, "events"), 500, "event_id")  # a bounded sample: one task suffices
    return s.select("event_id", F.round(F.sum("value").over(w), 4).alias("s1"), F.round(F.sum(F.col("value") * F.col("value")).over(w), 4).alias("s2"))


@query(None)
def variance_partition(spark, sf):
    ev = events(spark, sf)
    return partition.variance(sampling.bottom(ev, PART, "event_id"), "x", "value", ev.count(), K).table(spark)


FRACTIONS = tuple(i / 10 for i in range(1, 10))


@query(f"WITH {EV}, {queries_sql(QUERIES, ('x',))}, r AS (SELECT *, row_number() OVER (ORDER BY event_id) AS rn, count(*) OVER () AS n FROM ev), p AS (SELECT * FROM (VALUES {', '.join(f'({p!r}::DOUBLE)' for p in FRACTIONS)}) AS t(fraction)), a AS (SELECT p.fraction, q.qid, count(x) AS cnt, coalesce({SUM.format('value')}, 0) AS sum FROM p, q LEFT JOIN r ON x >= lo_x AND x < hi_x AND rn <= floor(n * p.fraction) GROUP BY 1, 2) SELECT fraction, qid, cnt, round(sum, 2) AS sum, round(CASE WHEN cnt > 0 THEN sum / cnt END, 6) AS avg FROM a")
def ground_truth_prefixes(spark, sf):
    return r2(workload.prefix_truth(events(spark, sf), QUERIES, "value", "event_id", FRACTIONS))


@query(
    f"WITH {EV}, pool AS (SELECT x, row_number() OVER (ORDER BY sha256('w|' || event_id::VARCHAR), event_id) - 1 AS r FROM ev), pairs AS (SELECT r // 2 AS p, floor(min(x)) AS lo, ceil(max(x)) AS hi FROM pool GROUP BY r // 2 HAVING count(*) = 2), "
    "good AS (SELECT p, lo, hi FROM (SELECT p, lo, hi FROM pairs WHERE lo < hi ORDER BY p LIMIT 200) JOIN ev ON x >= lo AND x < hi GROUP BY p, lo, hi HAVING count(*) >= 20), "
    "texts AS (SELECT (row_number() OVER (ORDER BY p) - 1)::INTEGER AS qid, 'value;x:[' || lo::BIGINT || '.0, ' || hi::BIGINT || '.0]' AS query FROM good) SELECT qid, query, substr(sha256(query), 1, 10) AS qhash FROM texts WHERE qid < 50"
)
def random_ranges(spark, sf):
    found = workload.random_ranges(events(spark, sf), ["x"], "value", 50, "event_id")
    return spark.createDataFrame([(i, str(q), q.hash) for i, q in enumerate(found)], "qid int, query string, qhash string")


ERRORS = f"{BASE}, {hybrid_sql(QUERIES, ('x',), 'value', 'leaves')}, {EXACT}, err AS (SELECT a.qid, " + ", ".join(f"CASE WHEN {t} = 0 THEN abs({e}) ELSE abs({t} - {e}) / abs({t}) END AS err_{n}" for n, t, e in (("cnt", "t.cnt", "a.cnt"), ("sum", "t.sum", "a.sum"), ("avg", "(t.sum / t.cnt)", "(a.sum / a.cnt)"))) + " FROM answer a JOIN exact t ON t.qid = a.qid)"


def _errors(spark, sf) -> DataFrame:
    ev = events(spark, sf)
    leaves = event_leaves(ev)
    found = estimate.hybrid(QUERIES, leaves, summary.summarise(ev, leaves, "value"), _sample(ev, leaves), "value")
    return accuracy.errors(estimate.exact(ev, QUERIES, "value"), found)


@query(f"{ERRORS} SELECT qid, round(err_cnt, 6) AS err_cnt, round(err_sum, 6) AS err_sum, round(err_avg, 6) AS err_avg FROM err")
def relative_error(spark, sf):
    return _errors(spark, sf).withColumns({c: F.round(c, 6) for c in ("err_cnt", "err_sum", "err_avg")})


@query(f"{ERRORS} SELECT round(quantile_cont(err_sum, 0.25), 6) AS p25, round(quantile_cont(err_sum, 0.5), 6) AS p50, round(quantile_cont(err_sum, 0.95), 6) AS p95 FROM err")
def error_percentiles(spark, sf):
    return accuracy.percentiles(_errors(spark, sf), "err_sum").select(*(F.round(c, 6).alias(c) for c in ("p25", "p50", "p95")))


@query(f"{ERRORS} SELECT qid, round(err_cnt, 6) AS err_cnt FROM err ORDER BY err_cnt DESC, qid LIMIT 3")
def worst_queries(spark, sf):
    return accuracy.worst(_errors(spark, sf).withColumn("err_cnt", F.round("err_cnt", 6)), 3).select("qid", "err_cnt")


@query("SELECT l_orderkey, l_quantity, l_discount FROM lineitem WHERE ((l_quantity >= 1 AND l_quantity < 5) OR (l_quantity >= 40 AND l_quantity < 45)) AND ((l_discount >= 0 AND l_discount < 0.02) OR (l_discount >= 0.08 AND l_discount < 0.1))")
def dnf_filter(spark, sf):
    return lineitem(spark, sf).filter(any_of("l_quantity", [(1.0, 5.0), (40.0, 45.0)]) & any_of("l_discount", [(0.0, 0.02), (0.08, 0.1)])).select("l_orderkey", "l_quantity", "l_discount")


@query("SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey END AS cust FROM orders WHERE o_orderkey % 10 <> 0 AND o_totalprice IS NOT NULL AND o_custkey IS NOT NULL")
def project_dropna(spark, sf):
    o = table(spark, sf, "orders").withColumn("cust", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey")))
    return tables.complete_rows(o, "o_orderkey", "o_totalprice", "cust")


@query("SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS day, CAST(strftime(o_orderdate, '%H%M%S') AS INTEGER) AS tod, epoch_us(o_orderdate) / 1e6 AS seconds FROM orders")
def datetime_encode(spark, sf):
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", scalars.day_number(d).alias("day"), scalars.time_number(d).alias("tod"), scalars.seconds(d).alias("seconds"))


@query("SELECT event_id FROM (SELECT event_id FROM events ORDER BY event_id LIMIT 50 OFFSET 150)")
def offset_rewind(spark, sf):
    return sampling.page(table(spark, sf, "events"), -50, 200, "event_id").select("event_id")


@query("SELECT l_orderkey, CAST(trunc(l_discount * 100000) AS INTEGER) AS d FROM lineitem")
def scale_to_int(spark, sf):
    return lineitem(spark, sf).select("l_orderkey", scalars.scaled_int(F.col("l_discount")).alias("d"))


@query("SELECT event_id, value, event_type, '0x' || substr(sha256(event_id || ',' || value || ',' || event_type), 1, 16) AS __tuplehash__ FROM events")
def csv_roundtrip(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value", "event_type")
    return tables.parse_lines(tables.to_lines(ev), ev.schema)


@query("SELECT round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_discount >= 0.02 AND l_discount < 0.07 AND l_quantity >= 10 AND l_quantity < 40")
def query_to_sql(spark, sf):
    q = RangeQuery.parse("l_extendedprice;l_quantity:[10, 40];l_discount:[0.02, 0.07]")
    lineitem(spark, sf).createOrReplaceTempView("leafcast_lineitem")
    return spark.sql(q.sql("leafcast_lineitem")).select(F.round("total", 2).alias("total"))


EARLY = f"early AS (SELECT * FROM ev WHERE x < {DAY0 + 6 * 86400!r})"
ERROR_RATES = ", ".join(f"round(quantile_cont(err_sum, {p}), 6) AS p{round(p * 100)}" for p in (0.25, 0.5, 0.95))


@query(" UNION ALL ".join(f"SELECT * FROM ({ERRORS.replace(BASE, f'WITH {EV}, {EARLY}, {cuts_sql(source)}, {SUMMARY}, {SAMPLE}')} SELECT {ERROR_RATES}, '{name}' AS tree FROM err)" for name, source in (("stale", "early"), ("rebuilt", "ev"))))
def rebuild_vs_stale(spark, sf):
    ev = events(spark, sf)
    early = ev.filter(F.col("x") < DAY0 + 6 * 86400)
    out = None
    for name, leaves in (("stale", event_leaves(early)), ("rebuilt", event_leaves(ev))):
        found = estimate.hybrid(QUERIES, leaves, summary.summarise(ev, leaves, "value"), _sample(ev, leaves), "value")
        part = accuracy.percentiles(accuracy.errors(estimate.exact(ev, QUERIES, "value"), found), "err_sum").withColumn("tree", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select(*(F.round(c, 6).alias(c) for c in ("p25", "p50", "p95")), "tree")


@query(f"WITH {EV}, {cuts_sql()}, placed AS (SELECT * FROM ev JOIN leaves ON x >= lo_x AND x < hi_x) SELECT leaf_id, count(*) AS cnt, round({SUM.format('value')}, 4) AS sum, count(*) FILTER (WHERE event_id % 4 <> 0 AND substr(sha256('s|' || event_id::VARCHAR), 1, 8) < '{scalars.below(RATE)}') AS sampled FROM placed GROUP BY leaf_id")
def stats_only_update(spark, sf):
    ev = events(spark, sf)
    leaves = event_leaves(ev)
    early, late = ev.filter("event_id % 4 <> 0"), ev.filter("event_id % 4 = 0").withColumn("op", F.lit("I"))
    sums = summary.merge(summary.summarise(early, leaves, "value").select("leaf_id", "cnt", "sum"), summary.signed(late, leaves, "value"))
    return r4(sums.join(_sample(early, leaves).groupBy("leaf_id").agg(F.count("*").alias("sampled")), "leaf_id", "left").fillna(0, ["sampled"]), "sum")


INTERVALS = [(0, 499), (0, 63), (10, 10), (100, 300), (436, 499)]


@query(
    "WITH s AS (SELECT event_id, value, ts FROM events ORDER BY sha256('p|' || event_id::VARCHAR), event_id LIMIT 500), r AS (SELECT row_number() OVER w - 1 AS i, sum(value) OVER w AS s1, sum(value * value) OVER w AS s2 FROM s WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), "
    f"q AS (SELECT * FROM (VALUES {', '.join(map(str, INTERVALS))}) AS t(first, last)), f AS (SELECT (SELECT count(*) FROM events)::DOUBLE / (SELECT count(*) FROM s) AS f), "
    "d AS (SELECT q.first, q.last, e.s1 - coalesce(b.s1, 0) AS s1, e.s2 - coalesce(b.s2, 0) AS s2 FROM q JOIN r e ON e.i = q.last LEFT JOIN r b ON b.i = q.first - 1) SELECT first, last, round(f * f * s2 - s1 * s1 / (last - first + 1), 2) AS variance FROM d, f"
)
def interval_variance(spark, sf):
    ev = table(spark, sf, "events")
    found = partition.interval_variance(sampling.bottom(ev, 500, "event_id"), ["ts", "event_id"], "value", ev.count(), INTERVALS)
    return found.withColumn("variance", F.round("variance", 2))


BATCH = [RangeQuery("value", (("x", DAY0 + i * 40000.0, DAY0 + i * 40000.0 + 90000.0 * (1 + i % 7)),)) for i in range(60)]


@query(f"{BASE}, {hybrid_sql(BATCH, ('x',), 'value', 'leaves')} {ANSWER.replace(', 4)', ', 6)')}")
def query_batch(spark, sf):
    ev = events(spark, sf)
    leaves = event_leaves(ev)
    found = estimate.hybrid(BATCH, leaves, summary.summarise(ev, leaves, "value"), _sample(ev, leaves), "value")
    return found.withColumns({"cnt": F.round("cnt", 6), "sum": F.round("sum", 6), "avg": F.round("avg", 8)})


@query("SELECT event_id, value FROM events WHERE event_id % 10 = 0")
def fetch_rows(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value")
    incoming = tables.to_lines(ev.filter("event_id % 10 = 0")).select(scalars.line_hash(F.col("value")).alias(tables.HASH))
    return tables.fetch(tables.parse_lines(tables.to_lines(ev), ev.schema), incoming).select("event_id", "value")


PROFILED = ("l_quantity", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column, count({c}) AS cnt, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, " + ", ".join(f"round(quantile_cont({c}, {p / 100}), 6) AS p{p}" for p in (25, 50, 75)) + f", max({c}) AS max FROM lineitem" for c in PROFILED))
def column_profile(spark, sf):
    found = accuracy.profile(lineitem(spark, sf), *PROFILED)
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "std", "p25", "p50", "p75")})


LEAF_COUNTS, ROW_BYTES = (128, 256, 512, 1024), 65.65


@query(f"SELECT k, round(1.2 * (0.01 * n * {ROW_BYTES} + k * 1024) / 1e6, 6) AS mb FROM (SELECT count(*)::DOUBLE AS n FROM lineitem), (VALUES {', '.join(f'({k})' for k in LEAF_COUNTS)}) t(k)")
def storage_estimate(spark, sf):
    n = lineitem(spark, sf).count()
    return spark.createDataFrame([(k, round(SynopsisConfig(leaves=k).storage_mb(n, ROW_BYTES), 6)) for k in LEAF_COUNTS], "k int, mb double")


@query("SELECT o_orderkey, substr(sha1('k:[' || o_orderkey || ', ' || o_custkey || ']'), 1, 10) AS predicate_id FROM orders")
def predicate_id(spark, sf):
    text = F.concat(F.lit("k:["), F.col("o_orderkey").cast("string"), F.lit(", "), F.col("o_custkey").cast("string"), F.lit("]"))
    return table(spark, sf, "orders").select("o_orderkey", scalars.predicate_id(text).alias("predicate_id"))


FINE = [RangeQuery("fine", (("x", DAY0 + 3 * 86400, DAY0 + 27.5 * 86400),)), RangeQuery("fine", (("x", LOW, HIGH),))]


@query(f"WITH {EV}, {queries_sql(FINE, ('x',))}, f AS (SELECT x, value * 0.000123 AS fine FROM ev) SELECT qid, count(x) AS cnt, round(sum(fine), 6) AS sum, round(avg(fine), 9) AS avg, round(min(fine), 9) AS min, round(max(fine), 9) AS max FROM q LEFT JOIN f ON x >= lo_x AND x < hi_x GROUP BY qid")
def exact_sum_fine(spark, sf):
    """Sums of values far below a cent."""
    found = estimate.exact(events(spark, sf).withColumn("fine", F.col("value") * 0.000123), FINE, "fine")
    return found.withColumns({"sum": F.round("sum", 6), **{c: F.round(c, 9) for c in ("avg", "min", "max")}})


SMALL = SynopsisConfig(leaves=K, sample_rate=RATE, catch_up=1.0)


def _synopsis(df: DataFrame) -> Synopsis:
    return Synopsis.build(df.select("event_id", "x", "value"), ["x"], "value", ("event_id",), SMALL)


def _changes(df: DataFrame, op: str) -> DataFrame:
    return df.select("event_id", "x", "value", F.lit(op).alias("op"))


BEFORE = "base AS (SELECT * FROM ev WHERE event_id % 4 <> 0)"
NOW = "now AS (SELECT * FROM ev WHERE NOT (event_id % 4 <> 0 AND value > 200) AND NOT (event_id % 4 = 0 AND value < 1))"


@query(f"WITH {EV}, {BEFORE}, {cuts_sql('base')}, {NOW} SELECT leaf_id, count(*)::DOUBLE AS cnt, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max FROM now JOIN leaves ON x >= lo_x AND x < hi_x GROUP BY leaf_id")
def synopsis_extremes_after_changes(spark, sf):
    """Inserts beyond the old extremes, deletes of all large old values, and a rescan of the leaves whose kept extremes have all gone."""
    ev = events(spark, sf)
    old, new = ev.filter("event_id % 4 <> 0"), ev.filter("event_id % 4 = 0 AND NOT value < 1")
    syn = _synopsis(old).apply(_changes(new, "I")).apply(_changes(old.filter("value > 200"), "D"))
    now = old.filter("NOT value > 200").unionByName(new)
    return r4(syn.rescan(now.select("event_id", "x", "value")).summary(), "sum").select("leaf_id", "cnt", "sum", "min", "max")


@query(f"{BASE} SELECT event_id, leaf_id FROM sample")
def synopsis_sample_after_reinsert(spark, sf):
    """Rows that go and come back are in the sample as before."""
    ev = events(spark, sf)
    some = ev.filter("event_id % 5 = 0")
    return _synopsis(ev).apply(_changes(some, "D")).apply(_changes(some, "I")).rows_now().select("event_id", "leaf_id")


@query(f"WITH {EV}, {cuts_sql()}, s AS (SELECT leaf_id, event_id, value FROM ev JOIN leaves ON x >= lo_x AND x < hi_x), gone AS (SELECT * FROM s WHERE substr(sha256('s|' || event_id::VARCHAR), 1, 8) < '{scalars.below(RATE)}' AND substr(sha256('e0|' || leaf_id::VARCHAR), 1, 8) < '{scalars.below(0.5)}' AND substr(sha256('h0|' || event_id::VARCHAR), 1, 8) < '{scalars.below(0.5)}') SELECT leaf_id, (count(*) FILTER (WHERE event_id NOT IN (SELECT event_id FROM gone)))::DOUBLE AS cnt, round(sum(value) FILTER (WHERE event_id NOT IN (SELECT event_id FROM gone)), 4) AS sum FROM s GROUP BY leaf_id")
def synopsis_evict(spark, sf):
    """Evicted sample rows take their part of the statistics with them."""
    return r4(_synopsis(events(spark, sf)).evict(0.5).counts().select("leaf_id", "cnt", "sum"), "sum")


@query("SELECT 0 AS qid, count(*)::DOUBLE AS cnt, round(sum(value), 4) AS sum, round(avg(value), 8) AS avg, min(value) AS min, max(value) AS max FROM events WHERE event_id % 10 > 1")
def null_attributes(spark, sf):
    """Rows whose attribute is null or NaN are in no range of it."""
    odd = F.when(F.col("event_id") % 10 == 0, F.lit(None)).when(F.col("event_id") % 10 == 1, F.lit(float("nan"))).otherwise(F.col("x"))
    return r4(_synopsis(events(spark, sf).withColumn("x", odd)).query([RangeQuery("value", (("x", LOW, HIGH),))]), "sum", "avg")


@query(f"{BASE}, n AS (SELECT count(*) AS n FROM leaves), levels AS (SELECT unnest(range(0, (1 + ceil(log2(n)))::BIGINT)) AS level FROM n) SELECT level::INTEGER AS level, (leaf_id // (2 ** level)::BIGINT)::INTEGER AS node, sum(cnt)::BIGINT AS cnt, round(sum(sum), 4) AS sum, min(min) AS min, max(max) AS max FROM summary, levels GROUP BY 1, 2")
def merge_tree(spark, sf):
    """Summaries of all nodes above the leaves, by pairs."""
    ev = events(spark, sf)
    leaves = event_leaves(ev)
    return r4(summary.inner_summaries(summary.summarise(ev, leaves, "value"), leaves.inner(spark)), "sum")


@query(f"WITH {BASE[5:]} SELECT event_id, leaf_id, CASE WHEN x < lo_x THEN -1 WHEN x >= hi_x THEN 1 ELSE 0 END AS side FROM ev, leaves WHERE leaf_id = 3")
def locate_values(spark, sf):
    ev = events(spark, sf)
    leaves = event_leaves(ev)
    lo, hi = leaves.boxes[3][0]
    return ev.select("event_id", F.lit(3).alias("leaf_id"), geometry.locate(F.col("x"), F.lit(lo), F.lit(hi)).alias("side"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(l_discount - l_tax) <= 0.0001 AS near FROM lineitem")
def approx_equal(spark, sf):
    return lineitem(spark, sf).select(*ND_KEY, scalars.close(F.col("l_discount"), F.col("l_tax")).alias("near"))


@query("SELECT count(*) AS rows FROM events")
def topic_size(spark, sf):
    return tables.rows_in(table(spark, sf, "events"))


SENT = [RangeQuery("value", (("x", LOW, HIGH),)), RangeQuery("value", ())]


@query(f"WITH {EV}, {queries_sql(SENT, ('x',))} SELECT qid, count(*)::DOUBLE AS cnt, round(sum(value), 2) AS sum FROM q JOIN ev ON x >= lo_x AND x < hi_x WHERE NOT (event_id % 3 <> 0 AND event_id % 7 = 0) GROUP BY qid")
def solver_stream(spark, sf):
    """A synopsis of two thirds of the rows; the rest comes as a stream of lines, with deletions of a seventh of the old ones and then the queries."""
    ev = events(spark, sf).select("event_id", "x", "value")
    old = ev.filter("event_id % 3 <> 0")
    root = new_path(spark, "topics")
    topics.create(spark, f"{root}/in")
    topics.send(tables.to_lines(ev.filter("event_id % 3 = 0")), f"{root}/in", "data")
    topics.send(tables.to_lines(old.filter("event_id % 7 = 0")), f"{root}/in", "deletion")
    consumer = solver.SynopsisSolver("synopsis", f"{root}/results", synopsis=_synopsis(old))
    for lines in (None, [*map(str, SENT), "exit"]):
        if lines:
            topics.send(spark.createDataFrame([(x,) for x in lines], "value string"), f"{root}/in", "query")
        solver.run(topics.stream(spark, f"{root}/in"), [consumer], ev.schema, f"{root}/state").awaitTermination()
    found = tables.read_results(spark, f"{root}/results/synopsis", RESULT)
    return found.select("qid", "cnt", F.round("sum", 2).alias("sum"))


RESULT = "qid int, query string, qhash string, cnt double, sum double, avg double, min double, max double, time double"


@query(f"SELECT name, file FROM (VALUES {', '.join(f'({k!r}, {w.file_name(2000)!r})' for k, w in sorted(config.WORKLOADS.items()))}) t(name, file)")
def workload_names(spark, sf):
    return spark.createDataFrame([(k, w.file_name(2000)) for k, w in config.WORKLOADS.items()], "name string, file string")


@query(f"{BASE} SELECT leaf_id, cnt::DOUBLE AS cnt, round(sum, 4) AS sum, min, max, (SELECT count(*) FROM sample s WHERE s.leaf_id = u.leaf_id) AS sampled FROM summary u")
def saved_and_loaded(spark, sf):
    """A synopsis that was saved, found whole and loaded again."""
    path = new_path(spark, "saved")
    _synopsis(events(spark, sf)).save(path)
    syn = Synopsis.load(spark, path)
    sizes = syn.rows_now().groupBy("leaf_id").agg(F.count("*").alias("sampled"))
    return r4(syn.summary().join(sizes, "leaf_id", "left").fillna(0, ["sampled"]).select("leaf_id", "cnt", "sum", "min", "max", "sampled"), "sum")


@query(f"WITH {EV}, {queries_sql(QUERIES, ('x',))}, r AS (SELECT *, row_number() OVER (ORDER BY event_id) AS rn, count(*) OVER () AS n FROM ev), p AS (SELECT * FROM (VALUES (0.1::DOUBLE), (0.5::DOUBLE)) AS t(fraction)) SELECT p.fraction, q.qid, round(coalesce(sum(value), 0), 2) AS sum, count(x) AS cnt FROM p, q LEFT JOIN r ON x >= lo_x AND x < hi_x AND rn <= floor(n * p.fraction) GROUP BY 1, 2")
def truth_file(spark, sf):
    """Truths over prefixes, written as a JSON file and read back."""
    path = new_path(spark, "truth")
    found = workload.prefix_truth(events(spark, sf), QUERIES, "value", "event_id", (0.1, 0.5)).collect()  # a row for each query and prefix
    tables.write_truth(spark, [(r["fraction"], str(r["qid"]), round(r["sum"], 2), r["cnt"], r["avg"]) for r in found], path)
    rows = [(p, int(q), float(total), n) for p, q, total, n, _ in tables.read_truth(spark, path)]
    return spark.createDataFrame(rows, "fraction double, qid int, sum double, cnt long")


TEXTS = ["value;x:[1704067200.0, 1704153600.5]", "l_extendedprice;l_discount:[0.02, 0.07];l_quantity:[10.0, 40.0]", "value"]


@query(f"SELECT query, substr(sha256(query), 1, 10) AS qhash FROM (VALUES {', '.join(f'({t!r})' for t in TEXTS)}) t(query)")
def workload_file(spark, sf):
    """A workload's file: written, left alone by a second writer, read and parsed."""
    path = new_path(spark, "workload")
    for some in (TEXTS, TEXTS[:1]):
        tables.write_workload(spark, [RangeQuery.parse(t) for t in some], path)
    return spark.createDataFrame([(str(q), q.hash) for q in tables.read_workload(spark, path)], "query string, qhash string")


@query(f"WITH {EV}, {cuts_sql()}, {queries_sql(QUERIES, ('x',))} SELECT qid, leaf_id, greatest(q.lo_x, l.lo_x) AS lo, least(q.hi_x, l.hi_x) AS hi FROM q JOIN leaves l ON greatest(q.lo_x, l.lo_x) < least(q.hi_x, l.hi_x)")
def sub_queries(spark, sf):
    """The part of each query in each leaf."""
    leaves = event_leaves(events(spark, sf))
    found = [(i, k, q.within({"x": box[0]})) for i, q in enumerate(QUERIES) for k, box in enumerate(leaves.boxes)]
    return spark.createDataFrame([(i, k, *part.edges("x")) for i, k, part in found if part], "qid int, leaf_id int, lo double, hi double")


@query("SELECT * FROM (VALUES ('etf', 'volume', 0.0::DOUBLE, 1.1e9::DOUBLE), ('intelwireless', 'light', 0.0, 2000.0), ('intelwireless', 'voltage', 0.5, 32000.0), ('taxi', 'trip_distance', 0.0, 1000.0), ('taxipdt', 'trip_distance', 0.0, 1000.0)) t(name, attr, lo, hi)")
def dataset_bounds(spark, sf):
    """Data sets by name, whatever its case, with their domain bounds."""
    found = [config.dataset(n) for n in ("ETF", "IntelWireless", " taxi ", "taxiPDT")]
    return spark.createDataFrame([(d.name, a, lo, hi) for d in found for a, (lo, hi) in d.bounds.items()], "name string, attr string, lo double, hi double")


@query(f"WITH {EV}, {cuts_sql()} SELECT leaf_id, CASE WHEN lo_x <= -1e308 THEN 'MIN' ELSE format('{{:,.2f}}', lo_x) END AS lo, CASE WHEN hi_x >= 1e308 THEN 'MAX' ELSE format('{{:,.2f}}', hi_x) END AS hi FROM leaves")
def box_text(spark, sf):
    at = event_leaves(events(spark, sf)).table(spark)
    return at.select("leaf_id", geometry.edge_text(F.col("lo_x")).alias("lo"), geometry.edge_text(F.col("hi_x")).alias("hi"))


SUMS = ["766000", "10 * (2 + 3)", "7 // 2 + 1", "-(4 - 9) % 3", "1 / 8"]


@query("SELECT * FROM (VALUES ('766000', 766000.0::DOUBLE), ('10 * (2 + 3)', 50.0), ('7 // 2 + 1', 4.0), ('-(4 - 9) % 3', 2.0), ('1 / 8', 0.125)) t(text, value)")
def arithmetic_values(spark, sf):
    return spark.createDataFrame([(t, float(scalars.arithmetic(t))) for t in SUMS], "text string, value double")


@query("SELECT * FROM (VALUES ('t_insert: 10 * 4 5', 'insert', 40, 5, true, ''), ('delete: 7', 'delete', 7, NULL, false, ''), ('query: rndelete', 'query', 0, NULL, false, 'rndelete'), ('sleep: 2', 'sleep', 2, NULL, false, ''), ('tock', 'tock', 0, NULL, false, '')) t(line, name, n, \"offset\", timed, word)")
def command_lines(spark, sf):
    lines = ["t_insert: 10 * 4 5", "delete: 7", "query: rndelete", "sleep: 2", "tock"]
    found = [(line, workload.parse_command(line)) for line in lines]
    return spark.createDataFrame([(line, c.name, c.n, c.offset, c.timed, c.word) for line, c in found], "line string, name string, n int, offset int, timed boolean, word string")


@query("SELECT count(*) FILTER (WHERE event_id % 10 <> 3 AND event_id % 10 <> 4) AS rows FROM events")
def command_script(spark, sf):
    """A script of inserts and deletes over a table of ten parts: parts 0 to 4 go in, 3 and 4 come out again, then 5 to 9 go in."""
    ev, held = events(spark, sf), []

    def insert(c: workload.Command) -> None:
        held.extend(range(c.offset or 0, (c.offset or 0) + c.n))

    def delete(c: workload.Command) -> None:
        del held[-c.n :]

    workload.run_commands(["tick", "insert: 5 0", "delete: 2", "t_insert: 10 / 2 5", "tock", "exit", "insert: 1 0"], {"insert": insert, "delete": delete})
    return tables.rows_in(ev.filter((F.col("event_id") % 10).isin(held)))


@query("SELECT event_id, value FROM events ORDER BY sha256('r7|' || event_id::VARCHAR), event_id LIMIT 2")
def random_pair(spark, sf):
    return workload.random_pair(table(spark, sf, "events"), "event_id", 7).select("event_id", "value")


@query(f"{BASE} SELECT event_id, leaf_id FROM (SELECT *, row_number() OVER (ORDER BY leaf_id, event_id) - 1 AS i FROM sample) WHERE i <> 40")
def evict_nth_row(spark, sf):
    ev = events(spark, sf)
    return sampling.evict_nth(_sample(ev, event_leaves(ev)), 40, "event_id").select("event_id", "leaf_id")


@query(f"{BASE} SELECT (SELECT count(*) FROM ev)::DOUBLE AS rows, (SELECT count(*) FROM sample) AS sampled, (SELECT floor(count(*) * {RATE})::BIGINT FROM ev) AS capacity, {int(1.2 * 64 * K)}::BIGINT AS partition_rows")
def sizes_of_synopsis(spark, sf):
    """Rows that the root stands for, sample rows, and what the settings make of the table's size."""
    ev = events(spark, sf)
    syn = _synopsis(ev)
    return spark.createDataFrame([(syn.rows().first()[0], syn.sampled(), SMALL.reservoir(ev.count()), SMALL.partition_sample)], "rows double, sampled long, capacity long, partition_rows long")


@query(f"WITH {EV}, {BEFORE}, {cuts_sql('base')}, placed AS (SELECT * FROM ev JOIN leaves ON x >= lo_x AND x < hi_x) SELECT leaf_id, count(*)::DOUBLE AS cnt, round(sum(value), 4) AS sum, count(*) FILTER (WHERE substr(sha256('s|' || event_id::VARCHAR), 1, 8) < '{scalars.below(RATE)}') AS sampled FROM placed GROUP BY leaf_id")
def catch_up_after_inserts(spark, sf):
    """A synopsis that takes inserts while its catch-up waits: nothing is counted twice, and new rows are in the sample."""
    ev = events(spark, sf).select("event_id", "x", "value")
    old = ev.filter("event_id % 4 <> 0")
    syn = Synopsis.build(old, ["x"], "value", ("event_id",), SMALL, ready=False).apply(_changes(ev.filter("event_id % 4 = 0"), "I"))
    done = syn.catch_up(old).compact()
    sizes = done.rows_now().groupBy("leaf_id").agg(F.count("*").alias("sampled"))
    return r4(done.counts().join(sizes, "leaf_id", "left").fillna(0, ["sampled"]).select("leaf_id", "cnt", "sum", "sampled"), "sum")


@query("SELECT 'data' AS topic, count(*) FILTER (WHERE event_id % 2 = 0) AS messages FROM events UNION ALL SELECT 'deletion', count(*) FILTER (WHERE event_id % 5 = 0) FROM events UNION ALL SELECT 'query', 2 UNION ALL SELECT 'tick', 0")
def topic_messages(spark, sf):
    """Topics that were created, filled and listed."""
    ev, root = events(spark, sf).select("event_id", "x", "value"), new_path(spark, "topics")
    topics.create(spark, root)
    topics.send(tables.to_lines(ev.filter("event_id % 2 = 0")), root, "data")
    topics.send(tables.to_lines(ev.filter("event_id % 5 = 0")), root, "deletion")
    topics.send(spark.createDataFrame([(str(q),) for q in SENT], "value string"), root, "query")
    return topics.describe(spark, root)


@query(f"WITH {EV}, {queries_sql(QUERIES, ('x',))}, {EXACT} SELECT 'groundtruth' AS name, qid, cnt, round(sum, 2) AS sum FROM exact")
def result_files(spark, sf):
    """Answers written as CSV files and read back by name; a second run of the truth is held against the first."""
    ev, root = events(spark, sf), new_path(spark, "results")
    found = estimate.exact(ev, QUERIES, "value")
    tables.write_results(found, f"{root}/groundtruth")
    back = tables.read_results(spark, root, "qid int, cnt long, sum double, avg double, min double, max double").filter("is_truth").drop("is_truth")
    accuracy.assert_close(back, found)
    return back.select(F.lit("groundtruth").alias("name"), "qid", "cnt", F.round("sum", 2).alias("sum"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
