"""Near-duplicates by SuperMinHash: signatures, banding, verification on full shingle sets, and union-find over the links.

Steps, and what moves in each:
1. One pass over the texts gives each document its set's size, a 128-bit digest of the set, a signature and a key for each band. Documents with equal
   sets form a class and go on as its smallest doc_id, so copies cost one row each.
2. Band keys shared by two or more classes are buckets. Each member is paired with its bucket's smallest member (a star, not all pairs), and the pairs
   are verified on the full sets; the links are united.
3. Buckets whose members aren't all in one component are opened again: members of different components and like sizes are compared by signature and folded set, in
   blocks of bounded size, and what passes is verified as well. Near copies share most of their buckets, so the opened buckets of one lead meet as one group, each member once,
   unless that makes more pairs. Of a group's largest component only the blocks that meet other members are made. After this every pair of a bucket is linked, in one component by other
   links, or under 0.75 by its sets or by half of its places (see LEAST_AGREEMENT).
4. Union-find runs in rounds of contraction over the links, each round a few aggregates and joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  binds pa.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, drop, map_batches, map_groups, stored

SHINGLE = 5
#: A signature has BANDS * ROWS places. At similarity 0.75 a pair misses every band with probability (1 - 0.75**4)**40 = 2.5e-7.
BANDS, ROWS = 40, 4
#: Signatures of a pair at 0.75 agree in 0.75 of the places on average, with a standard deviation under 0.035: 0.5 is 7 of these below.
LEAST_AGREEMENT = 0.5
#: Members of a bucket that one task compares at a time.
BLOCK = 512
#: Members of a bucket that meet one copy of their lead's set.
PARTNERS = 4096
#: Sets of a pair at 0.75 differ in size by a third at most: with classes of a little more than that, they are in one class or in neighbouring ones.
SIZE_CLASS = 1.34

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WEIGHTS = [np.uint64(w) for w in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
U = np.uint64


def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


class WordHashes(dict):
    def __init__(self, most: int = 1_000_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, known: WordHashes) -> np.ndarray:
    """The text's distinct 5-word shingles as sorted 64-bit hashes; all its words as one if there are fewer than 5."""
    words = (text or "").encode().translate(LOWER).split()
    n = len(words)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    if not n:
        return h
    if n < SHINGLE:
        total = U(n)
        for i in range(n):
            total = total + h[i : i + 1] * WEIGHTS[i]
        return mix(total)
    total = h[: n - 4] * WEIGHTS[0]
    for i in range(1, SHINGLE):
        total += h[i : n - 4 + i] * WEIGHTS[i]
    return np.unique(mix(total))


def super_minhash(sets: list[np.ndarray], m: int = BANDS * ROWS) -> np.ndarray:
    """Signatures of non-empty sets, m places of 32 bits.

    Every element has its own random permutation of the places; the place it visits at its j-th step may hold j plus a random fraction (8 and 24 bits here),
    and the signature keeps the least of each place. All elements of all sets take step j together. Once each place of a set holds a value of
    step j or before, later steps can't lower any, and the set stops.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    element = np.concatenate(sets)
    sig = np.full(len(sets) * m, 0xFFFFFFFF, np.uint32)
    lane = np.empty((0, 0), np.uint8)
    for j in range(m):
        r = mix(element ^ U((0x9E3779B97F4A7C15 * (j + 1)) & 0xFFFFFFFFFFFFFFFF))
        at = j + ((r >> U(40)) * U(m - j) >> U(24)).astype(np.int64)
        if j:
            rows = np.arange(len(element))
            place = lane[rows, at].astype(np.int64)
            lane[rows, at] = lane[:, j]
        else:
            place = at
        value = (U(j) << U(24) | (r & U(0xFFFFFF))).astype(np.uint32)
        np.minimum.at(sig, owner * m + place, value)
        open_ = sig.reshape(len(sets), m).max(axis=1) >= (j + 1) << 24
        keep = open_[owner]
        if not keep.any():
            break
        if j == 0:
            lane = np.tile(np.arange(m, dtype=np.uint8), (int(keep.sum()), 1))
            first = at[keep]
            lane[np.arange(len(first)), first] = 0
        elif not keep.all():
            lane = lane[keep]
        if not keep.all():
            owner, element = owner[keep], element[keep]
    return sig.reshape(len(sets), m)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    rows = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    total = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS)).copy()
    for i in range(ROWS):
        total = mix(total ^ (rows[:, :, i] + WEIGHTS[i]))
    return total.view(np.int64)


def _groups(texts: list[str | None], known: WordHashes, most: int = 200_000) -> Iterator[list[np.ndarray]]:
    held, n = [], 0
    for t in texts:
        s = shingles(t, known)
        held.append(s)
        n += len(s)
        if n > most:
            yield held
            held, n = [], 0
    if held:
        yield held


SIGNED = "doc_id long, n_shingles long, digest binary, bands array<long>, signature binary"


def signed(docs: DataFrame) -> DataFrame:
    """Set size, set digest, band keys and signature (upper and lower parts folded to 16 bits a place) of every whole text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches(parts, "text", 2_000_000):
            at = 0
            for held in _groups(batch.column("text").to_pylist(), known):
                ids = batch.column("doc_id").slice(at, len(held))
                at += len(held)
                full = [i for i, s in enumerate(held) if len(s)]
                bands, signatures = [None] * len(held), [None] * len(held)
                if full:
                    sig = super_minhash([held[i] for i in full])
                    folded = (mix(sig.astype(np.uint64)) & U(0xFFFF)).astype("<u2")
                    keys = band_keys(sig)
                    for k, i in enumerate(full):
                        bands[i], signatures[i] = keys[k], folded[k].tobytes()
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in held]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([len(s) for s in held], pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary())],
                    names=["doc_id", "n_shingles", "digest", "bands", "signature"],
                )

    return map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), run, SIGNED)


def sets_of(docs: DataFrame) -> DataFrame:
    """The full shingle sets (node, shingles array<long>, small: their upper halves, sorted) of rows (node, text)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches(parts, "text", 2_000_000):
            found = [shingles(t, known).view(np.int64) for t in batch.column("text").to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found))), pa.array([(s.view(np.uint64) >> U(32)).astype("<u4").tobytes() for s in found], pa.binary())], names=["node", "shingles", "small"])

    return map_batches(docs, run, "node long, shingles array<long>, small binary")


def verified(pairs: DataFrame, sets: DataFrame, ways: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= 75 * union. `ways` (a, ways): sets that go out in so many copies, as they have many partners; their pairs are then
    dealt to the copies by `way`."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"), F.size("shingles").alias("na"))
    if ways is None:
        met = pairs.join(left.hint("merge"), "a")
    else:
        copies = ways.select("a", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("way"))
        met = pairs.join(left.hint("merge").join(copies, "a").hint("merge"), ["a", "way"])
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"), F.size("shingles").alias("nb"))
    both = met.join(right.hint("merge"), "b").filter((4 * F.col("na") >= 3 * F.col("nb")) & (4 * F.col("nb") >= 3 * F.col("na")))
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(100 * common >= 75 * (F.col("na") + F.col("nb") - common)).select("a", "b")


def components(links: DataFrame) -> tuple[DataFrame, list[str]]:
    """Union-find in rounds: (node, root) of every node of the links (a, b), the root being some node of its component.

    In a round each root points to the least of its own and its neighbours' random ranks, and links are rewritten to these; links within one root vanish. Random ranks
    keep pointer chains short, so the number of rounds grows as the logarithm of the longest path. All rounds are aggregates with map-side
    combining and joins on single nodes; nothing of the links is collected. Also returned: the written tables that the result reads.
    """
    spark = links.sparkSession
    rank = lambda c: F.struct(F.xxhash64(F.lit(5), c).alias("r"), F.col(c).alias("v"))
    edges, path = stored(links.select("a", "b").filter("a <> b").distinct(), "edges")
    labels, held = None, []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy("a").agg(F.min(F.least(rank("a"), rank("b"))).alias("to")).select(F.col("a").alias("node"), F.col("to.v").alias("to"))
        point, p_point = stored(point, "pointers")
        if labels is None:
            new = point.select("node", F.col("to").alias("root"))
        else:
            new = labels.join(point.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        new, p_labels = stored(new, "labels")
        to_a, to_b = (point.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab")
        moved = edges.join(to_a, "a").join(to_b, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).filter("a <> b")
        moved, p_edges = stored(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        drop(spark, path, p_point, *held)
        edges, path, labels, held = moved, p_edges, new, [p_labels]
    drop(spark, path)
    return (labels, held) if labels is not None else (spark.createDataFrame([], "node long, root long"), [])


def _late_links(group: pa.Table) -> pa.Table:
    """Pairs of one block pair whose components differ, whose sizes allow 0.75, whose signatures agree, and whose folded sets overlap enough.

    Where a group is one bucket, a pair that shares several is looked at in its first band alone, found on the keys that make the buckets. A group of all buckets of a lead
    has -1 for its band, and all its pairs are looked at. Folding sets to 32 bits can only add to an
    overlap, so no link is lost here; what is returned is verified on the full sets afterwards. Nothing but such pairs leaves the task, however many members are alike.
    """
    node, root, n, band = (group.column(c).to_numpy() for c in ("node", "root", "n", "band"))
    lower = group.column("lower").to_numpy(zero_copy_only=False).astype(bool)
    keys = np.asarray(pa.compute.list_flatten(group.column("bands"))).reshape(len(node), BANDS) if band[0] >= 0 else None
    first, second = group.column("first").to_numpy(zero_copy_only=False).astype(bool), group.column("second").to_numpy(zero_copy_only=False).astype(bool)
    sig = np.frombuffer(b"".join(group.column("signature").to_pylist()), "<u2").reshape(len(node), -1)
    small = [np.frombuffer(x, "<u4") for x in group.column("small").to_pylist()]
    least = int(np.ceil(LEAST_AGREEMENT * sig.shape[1]))
    out_a, out_b = [], []
    # rows of the component that most rows share need no turn of their own: every pair has a row of another
    _, which, counts = np.unique(root, return_inverse=True, return_counts=True)
    turn = np.flatnonzero(which != counts.argmax())
    late = np.full(len(node), len(node))
    late[turn] = turn
    for i in turn.tolist():
        # pairs of two members of the upper size class are met in that class' own group
        fits = ((first & second[i]) | (second & first[i])) & (lower | lower[i]) & (root != root[i]) & (4 * n >= 3 * n[i]) & (4 * n[i] >= 3 * n) & (late > i)
        at = np.flatnonzero(fits)
        at = at[(sig[at] == sig[i]).sum(axis=1) >= least]
        if keys is not None:
            at = at[(keys[at] == keys[i]).argmax(axis=1) == band[i]]
        own = small[i]
        for k in at.tolist():
            other = small[k]
            place = np.searchsorted(own, other)
            place[place == len(own)] = 0
            common = int((own[place] == other).sum())
            if 100 * common >= 75 * (n[i] + n[k] - common):
                out_a.append(min(node[i], node[k]))
                out_b.append(max(node[i], node[k]))
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def _ways(k) -> Column:
    """Copies of a set that meets k others."""
    return F.ceil((F.col(k) if isinstance(k, str) else k) / PARTNERS)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document (columns doc_id, text).

    Documents are linked at 100 * intersection >= 75 * union of their sets of 5-word shingles (lower-cased A-Z; all words as one shingle if there are fewer than 5);
    component_id is the smallest doc_id that links reach, kept says doc_id = component_id. Null and empty texts have no set and link with nothing. Rows that repeat a
    doc_id are texts of one document, whose links they share. A row without a doc_id is no document: its component is null and it is kept. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    base, p_base = stored(signed(docs), "signed")
    filled = base.filter("n_shingles > 0 and doc_id is not null")
    # a class for each set, named by its smallest doc_id, whose row carries bands and signature on
    first_row = F.min(F.struct("doc_id", "n_shingles", "bands", "signature")).alias("r")
    classes, p_classes = stored(filled.groupBy("digest").agg(first_row).select("digest", F.col("r.doc_id").alias("node"), F.col("r.n_shingles").alias("n"), "r.bands", "r.signature"), "classes")
    repeated, p_repeated = stored(filled.groupBy("doc_id").agg(F.count("*").alias("k"), F.min("digest").alias("low"), F.max("digest").alias("high")).filter("k > 1"), "repeated")
    repeats = not repeated.isEmpty()
    several = filled.join(repeated.filter("low <> high").select("doc_id"), "doc_id").join(classes.select("digest", "node"), "digest")
    own_links = several.select(F.col("node").alias("a"), F.col("doc_id").alias("b")).filter("a <> b").distinct()

    keyed = classes.select("node", "n", F.posexplode("bands").alias("band", "key"))
    buckets = keyed.groupBy("key").agg(F.first("band").alias("band"), F.min("node").alias("lead"), F.count("*").alias("k"), F.bit_xor(F.xxhash64("node")).alias("x")).filter("k > 1")
    # buckets with the same members ask the same question: the one of the first band stays
    buckets = buckets.groupBy("lead", "k", "x").agg(F.min(F.struct("band", "key")).alias("first")).select("lead", "k", "first.key")
    buckets, p_buckets = stored(buckets, "buckets")
    within, p_within = stored(keyed.hint("merge").join(buckets, "key").select("key", "band", "node", "n", "lead", "k"), "within")
    # merge joins wherever texts, sets or band keys meet, so that the plan is the same at every size
    texts = docs.hint("merge").join(within.select(F.col("node").alias("doc_id")).distinct(), "doc_id")
    texts = texts.distinct() if repeats else texts
    sets, p_sets = stored(sets_of(texts.select(F.col("doc_id").alias("node"), "text").filter("text is not null")), "sets")
    # a lead of a large bucket meets its partners in several copies of its set, as many to each
    stars = within.filter("node <> lead").groupBy(F.col("lead").alias("a"), F.col("node").alias("b")).agg(F.max("k").alias("k"))
    stars = stars.select("a", "b", F.pmod(F.xxhash64("b"), _ways("k")).cast("int").alias("way"))
    links = verified(stars, sets, buckets.groupBy(F.col("lead").alias("a")).agg(_ways(F.max("k")).cast("int").alias("ways")))
    links, p_links = stored(links.unionByName(own_links) if repeats else links, "links")
    first, p_first = components(links)

    rooted = within.alias("w").join(first.alias("c"), F.col("w.node") == F.col("c.node"), "left").select("w.*", F.coalesce("c.root", "w.node").alias("root"))
    rooted, p_rooted = stored(rooted, "rooted")
    # the star decided buckets of two members
    undecided = rooted.filter("k > 2").groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    # the opened buckets of a lead are one group (key 0, band -1) if its pairs are no more than theirs: a bucket's k rows of k add up to k * k
    members = rooted.join(undecided, "key").groupBy("lead", "node").agg(F.min("root").alias("root"), F.min("n").alias("n"), F.sum("k").alias("pairs"), F.collect_list(F.struct("key", "band")).alias("met"))
    members, p_members = stored(members, "members")
    leads = members.groupBy("lead").agg((F.count("*") * F.count("*") <= F.sum("pairs")).alias("one"))
    alone = F.array(F.struct(F.lit(0).cast("long").alias("key"), F.lit(-1).alias("band")))
    sized = members.hint("merge").join(leads, "lead").select("lead", F.explode(F.when(F.col("one"), alone).otherwise(F.col("met"))).alias("at"), "node", "root", "n").select("lead", "at.*", "node", "root", "n")
    # a group is split by set sizes: a part holds the members of a size class and of the next one, and those of one component or without the lower class ask nothing
    size_class = F.floor(F.log(F.col("n")) / float(np.log(SIZE_CLASS))).cast("int")
    spread = sized.withColumn("c", size_class).withColumn("g", F.explode(F.array(F.col("c"), F.col("c") - 1))).withColumn("lower", F.col("c") == F.col("g"))
    spread, p_spread = stored(spread, "spread")
    part = ["lead", "key", "g"]
    roots = spread.groupBy(*part, "root").agg(F.count("*").alias("m"), F.max("lower").alias("any"))
    groups = roots.groupBy(*part).agg(F.sum("m").alias("m"), F.max(F.struct("m", "root")).alias("main"), F.max("any").alias("any")).filter("m > main.m and any")
    groups = groups.select(*part, F.col("main.root").alias("main"), F.ceil((F.col("m") - F.col("main.m")) / BLOCK).cast("int").alias("outer"), F.ceil(F.col("main.m") / BLOCK).cast("int").alias("inner"))
    opened = spread.hint("merge").join(groups, part).join(classes.select("node", "signature", "bands"), "node").join(sets.select("node", "small").hint("merge"), "node")
    # the blocks of the largest component come after the others, and meet those alone
    inside, at = F.col("root") == F.col("main"), F.xxhash64("node")
    opened = opened.withColumn("own", F.when(inside, F.col("outer") + F.pmod(at, F.col("inner"))).otherwise(F.pmod(at, F.col("outer"))).cast("int"))
    opened = opened.withColumn("blocks", F.col("outer") + F.when(inside, 0).otherwise(F.col("inner"))).withColumn("bands", F.when(F.col("band") >= 0, F.col("bands")))
    opened = opened.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    opened = opened.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    opened = opened.select(*part, "i", "j", "band", "node", "root", "n", "lower", "signature", "bands", "small", (F.col("own") == F.col("i")).alias("first"), (F.col("own") == F.col("j")).alias("second"))
    more = map_groups(opened, [*part, "i", "j"], _late_links, "a long, b long").distinct()
    late, p_late = stored(verified(more, sets), "links")
    final, p_final = components(links.unionByName(late))

    # classes are named by their smallest doc_id, so a component's smallest node is its smallest doc_id
    rooted_classes = classes.select("digest", "node").alias("c").join(final.alias("f"), F.col("c.node") == F.col("f.node"), "left").select("digest", "c.node", F.coalesce("f.root", "c.node").alias("root"))
    least = rooted_classes.unionByName(final.select(F.lit(None).cast("binary").alias("digest"), "node", "root")).groupBy("root").agg(F.min("node").alias("component"))
    by_class = rooted_classes.join(least, "root").select("digest", "component")
    out = base.select("doc_id", "n_shingles", "digest").join(by_class, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    out, _ = stored(out.select("doc_id", "n_shingles", component).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "near")
    drop(spark, p_base, p_classes, p_repeated, p_buckets, p_within, p_sets, p_links, p_rooted, p_members, p_spread, p_late, *p_first, *p_final)
    return out
