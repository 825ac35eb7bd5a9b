"""Mixing sources to target weights: a min-cost flow from membership patterns to source quotas, then a seeded choice of documents."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, drop, stored

#: Words a document may be taken, as a multiple of its size.
MOST_REPEATS = 2
#: Membership patterns in overlapping parts that the driver plans for; more are refused rather than dropped. Sources that share no document with another, however many, are
#: planned where they are.
MOST_PATTERNS = 200_000
#: Bits of a document's place in the seeded order.
PLACE_BITS = 60


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = MOST_REPEATS) -> dict[str | None, float]:
    """Words wanted from each source: `share` of all sizes by weight, none above `most` times its own, the excess reshared.

    Sources are in code-point order, null last, and take the weights in turn. Sources without words get 0.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, open_ = share * sum(sizes.values()), list(order)
    while open_:
        per = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if per * weight[s] > most * sizes[s]]
        if not full:
            out |= {s: per * weight[s] for s in open_}
            break
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def route(patterns: dict[tuple, int], quotas: dict[str | None, int], repeats: int = MOST_REPEATS) -> dict[tuple, dict[str | None, int]]:
    """Min-cost flow of words from patterns (sets of sources, with their words) to source quotas.

    Sources that no chain of patterns joins share nothing, so each connected part is a flow of its own: without overlaps, the work is in
    proportion to the number of sources.
    """
    parent: dict = {}

    def top(s):
        while parent.setdefault(s, s) != s:
            parent[s] = s = parent[parent[s]]
        return s

    for p in patterns:
        for s in p[1:]:
            parent[top(s)] = top(p[0])
    parts: dict = {}
    for p, n in patterns.items():
        parts.setdefault(top(p[0]) if p else (), {})[p] = n
    out: dict[tuple, dict[str | None, int]] = {}
    for some in parts.values():
        names = dict.fromkeys(s for p in some for s in p if s in quotas)
        out |= _flow(some, {s: quotas[s] for s in names}, repeats)
    return out


def _flow(patterns: dict[tuple, int], quotas: dict[str | None, int], repeats: int) -> dict[tuple, dict[str | None, int]]:
    """The flow of one connected part.

    A pattern's k-th pass over its documents costs k * k per word (convex, so first passes are spent first, wherever that is possible), and each pass holds its words
    once. Successive cheapest paths with potentials; the graph has a node for each pattern and source, whatever the number of documents.
    """
    names = list(quotas)
    pats = list(patterns)
    first_source = 1 + len(pats)
    sink = first_source + len(names)
    graph: list[list[list]] = [[] for _ in range(sink + 1)]  # arcs: to, room, cost, index of the reverse arc

    def arc(a: int, b: int, room: int, cost: int) -> None:
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    total = sum(quotas.values())
    for i, p in enumerate(pats):
        for k in range(repeats):
            arc(0, 1 + i, patterns[p], k * k)
        for s in p:
            if s in quotas:
                arc(1 + i, first_source + names.index(s), total, 0)
    for j, s in enumerate(names):
        arc(first_source + j, sink, quotas[s], 0)
    height = [0] * (sink + 1)
    while True:
        far, via = {0: 0}, {}
        heap, done = [(0, 0)], set()
        while heap:
            d, a = heapq.heappop(heap)
            if a in done:
                continue
            done.add(a)
            for x in graph[a]:
                b, room, cost, _ = x
                nd = d + cost + height[a] - height[b]
                if room > 0 and b not in done and nd < far.get(b, 1 << 62):
                    far[b], via[b] = nd, (a, x)
                    heapq.heappush(heap, (nd, b))
        if sink not in far:
            break
        for a in range(sink + 1):
            height[a] += min(far.get(a, far[sink]), far[sink])
        push, b = 1 << 62, sink
        while b:
            a, x = via[b]
            push, b = min(push, x[1]), a
        b = sink
        while b:
            a, x = via[b]
            x[1] -= push
            graph[b][x[3]][1] += push
            b = a
    out: dict[tuple, dict[str | None, int]] = {}
    for i, p in enumerate(pats):
        out[p] = {names[x[0] - first_source]: graph[x[0]][x[3]][1] for x in graph[1 + i] if x[0] >= first_source and graph[x[0]][x[3]][1]}
    return out


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(seed: int) -> Column:
    """A document's place in the seeded order: the first 15 hexadecimal digits of the MD5 of `seed:doc_id` as a number (no id: `seed:`), which SQL engines agree on."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = MOST_REPEATS) -> DataFrame:
    """`targets` of a written table (source, size), however many sources it has: source, size, target.

    Sources are numbered in order by a range sort, whose partition sizes alone come to the driver. The level that weights are multiplied by rises until all sources together hold the share;
    each step is one aggregate, which tells those that are full at the level, and there are as many steps as times that some source is found full.
    """
    ordered, path = stored(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("__i", F.monotonically_increasing_id()), "sources")
    part, within = F.shiftright("__i", 33), F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))
    before, starts = 0, {}
    for r in ordered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        starts[r["p"]] = before
        before += r["n"]
    if not starts:
        return sizes.select("source", "size", F.lit(0.0).alias("target"))
    offset = F.element_at(F.create_map(*(F.lit(x) for p, n in starts.items() for x in (p, n))), part)
    turn = F.pmod(offset + within, F.lit(len(weights))).cast("int")
    weighed, held = stored(ordered.select("source", "size", F.get(F.array(*(F.lit(float(w)) for w in weights)), turn).alias("weight")), "weighed")
    drop(sizes.sparkSession, path)
    full, level = F.lit(False), None
    total = weighed.agg(F.sum("size")).first()[0]
    while True:
        got = weighed.agg(F.sum(F.when(full, F.col("size"))).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("open"), F.count(F.when(full, 1)).alias("n")).first()
        if got["open"] is None:
            break
        new = (share * total - most * (got["held"] or 0)) / got["open"]
        if level is not None and got["n"] == n:
            break
        level, n = new, got["n"]
        full = F.lit(level) * F.col("weight") > F.lit(float(most)) * F.col("size")
    target = F.when(full, F.lit(float(most)) * F.col("size")).otherwise(F.lit(level or 0.0) * F.col("weight"))
    return weighed.select("source", "size", target.alias("target"))


def _overlapping(patterns: DataFrame) -> tuple[list, set]:
    """Patterns of several sources, and of single ones that such patterns hold, with their words: what the driver has to route. And their sources."""
    several = patterns.filter(F.size("members") > 1).limit(MOST_PATTERNS + 1).collect()
    if len(several) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns of overlapping sources")
    names = {s for r in several for s in r["members"]}
    if not names:
        return [], set()
    table = patterns.sparkSession.createDataFrame([(s,) for s in names], "source string")
    single = patterns.filter(F.size("members") == 1).withColumn("of", F.col("members")[0])
    # a source for each of the patterns above at most
    own = single.join(F.broadcast(table), F.col("of").eqNullSafe(F.col("source")), "left_semi").collect()
    return [*several, *own], names


def mix(docs: DataFrame, sources: Column, wanted=source_targets, seed: int = 17, carry: tuple[str, ...] = ()) -> DataFrame:
    """How many words the mix takes of every document.

    `sources` is an array of the sources that a document counts towards (one or several); `wanted` maps a table of the sources' total sizes (source, size) to one with their targets (target). Documents
    are aggregated by membership pattern. A source that shares no document with another takes its target from its own words, all once before any twice; patterns of sources
    that overlap go to `route`, which fills the targets from the patterns, first passes before second ones. Within a pattern documents are
    taken in the order of a seeded hash of their ids until its words are reached, a second time where it gives more than it has, the last one in part.

    Rows: doc_id, size, members, taken (0 to 2 times size), shares (array of source, words, and the source's size and target, `words` adding up to taken), then `carry`. Null and empty texts have
    size 0 and nothing is taken from them; a null source is a source; repeated rows are documents of their own; an empty table gives no rows.
    Sizes go through a written table, so texts are read once. No pattern is gathered in one task: positions come from sums by hash bucket.
    """
    spark = docs.sparkSession
    sized, _ = stored(docs.select("doc_id", words(F.col("text")).alias("size"), F.array_sort(F.array_distinct(sources)).alias("members"), place(seed).alias("place"), *carry), "sizes")
    patterns, p_patterns = stored(sized.groupBy("members").agg(F.sum("size").alias("words"), F.count("*").alias("n")), "patterns")
    sizes, p_sizes = stored(patterns.select(F.explode("members").alias("source"), "words").groupBy("source").agg(F.sum("words").alias("size")), "source-sizes")
    goals, p_goals = stored(wanted(sizes).select("source", "size", F.col("target").cast("double").alias("target"), F.bround("target").cast("long").alias("quota")), "targets")
    # each pattern's words, pass after pass, are a line; sources get stretches of it
    stretch = "array<struct<source:string,low:bigint,high:bigint,size:bigint,target:double>>"
    single = patterns.filter(F.size("members") == 1).withColumn("of", F.col("members")[0])
    alone = single.join(goals, F.col("of").eqNullSafe(F.col("source"))).select("members", "words", "n", "source", "size", "target", "quota")
    met, names = _overlapping(patterns)
    if names:
        shared = spark.createDataFrame([(s,) for s in names], "name string")
        alone = alone.join(F.broadcast(shared), F.col("source").eqNullSafe(F.col("name")), "left_anti")
    one = F.struct("source", F.lit(0).cast("long").alias("low"), F.least("quota", MOST_REPEATS * F.col("words")).alias("high"), "size", "target")
    plan = alone.select("members", "words", "n", F.array(one).cast(stretch).alias("stretches"))
    if names:
        found = {r["source"]: r for r in goals.join(F.broadcast(shared), F.col("source").eqNullSafe(F.col("name")), "left_semi").collect()}
        flow = route({tuple(r["members"]): r["words"] for r in met}, {s: r["quota"] for s, r in found.items()})
        rows = []
        for r in met:
            at, stretches = 0, []
            for s, n in sorted(flow[tuple(r["members"])].items(), key=lambda x: (x[0] is None, x[0] or "")):
                stretches.append((s, at, at + n, found[s]["size"], found[s]["target"]))
                at += n
            rows.append((r["members"], r["words"], r["n"], stretches))
        plan = plan.unionByName(spark.createDataFrame(rows, f"members array<string>, words long, n long, stretches {stretch}"))
    # a pattern's 64-bit key; nulls are marked, as the hash of an array passes over them: [a] and [a, null] would be one
    key = F.xxhash64(F.transform("members", lambda m: F.struct(m.isNull(), m))).alias("key")
    plan, p_plan = stored(plan.withColumn("key", key).drop("members"), "plan")

    # documents before one in its pattern's order: sums of whole buckets, then a running sum within the bucket
    most = plan.agg(F.max("n")).first()[0] or 1
    bits = min(16, max(1, (most // 64).bit_length()))
    bucket = F.shiftrightunsigned("place", PLACE_BITS - bits).alias("bucket")
    held = sized.withColumns({"bucket": bucket, "key": key})
    sums = held.groupBy("key", "bucket").agg(F.sum("size").alias("within"))
    before = sums.select("key", "bucket", (F.sum("within").over(Window.partitionBy("key").orderBy("bucket")) - F.col("within")).alias("before"))
    inner = Window.partitionBy("key", "bucket").orderBy("place", "doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, 0)
    at = held.join(before, ["key", "bucket"]).withColumn("low", F.col("before") + F.sum("size").over(inner) - F.col("size"))
    at = at.join(plan.drop("n"), "key")

    def overlap(start: Column, s: Column) -> Column:
        return F.greatest(F.lit(0), F.least(start + F.col("size"), s["high"]) - F.greatest(start, s["low"])).cast("long")

    share = F.transform("stretches", lambda s: F.struct(s["source"].alias("source"), (overlap(F.col("low"), s) + overlap(F.col("low") + F.col("words"), s)).alias("words"), s["size"].alias("size"), s["target"].alias("target")))
    out = at.select("doc_id", "size", "members", share.alias("shares"), *carry)
    taken = F.aggregate("shares", F.lit(0).cast("long"), lambda a, s: a + s["words"]).alias("taken")
    drop(spark, p_patterns, p_sizes, p_goals)
    return out.select("doc_id", "size", "members", taken, "shares", *carry)


def mix_sources(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The contract's digest for documents with one source each: doc_id, size, source_size, target, taken, source."""
    out = mix(docs.select("doc_id", "text", F.array(F.col("source").cast("string")).alias("of")), F.col("of"), seed=seed)
    own = F.col("shares")[0]
    return out.select("doc_id", "size", own["size"].alias("source_size"), own["target"].alias("target"), "taken", own["source"].alias("source"))
