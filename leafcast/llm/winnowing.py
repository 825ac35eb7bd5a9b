"""Document fingerprints by winnowing. DataFrame functions only.

A text is read as units: runs between white space, cut every 8 code points, and single letters of scripts that are written without spaces. Each unit is hashed once, to a number; a run of K units has the rolling hash
u[i] * B**4 + ... + u[i + 4] mod P, which each run could have from the one before by dropping a unit and taking one in. Of every W consecutive hashes the least is kept, the
rightmost of equal ones, with its position. Any passage of K + W - 1 = 20 or more units that two texts share, cut alike, gives them a common fingerprint.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_edges

K = 5
W = 16
#: Thai and Lao, Burmese, Khmer, ideographs with kana and their signs, and their supplements: scripts that don't part words, where a cut every 8 letters would follow
#: what stands before a passage.
UNSPACED = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{2E80}-\x{A4CF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
UNIT = rf"[{UNSPACED}]|[^\x20\x09-\x0D{UNSPACED}]{{1,8}}"
#: Modulus and bases of the rolling hashes: one orders the runs of a window, the other makes a kept hash 62 bits long.
P, B, B2 = 2**31 - 1, 1_000_003, 998_244_353
#: Positions are counted down from here below a hash, so that the least number is that of the least hash, the rightmost of equal ones.
LAST = 2**32 - 1


def unit_numbers(text: Column) -> Column:
    """A number below 2**32 for each unit: the first 8 hexadecimal digits of its MD5. Empty for null and blank texts."""
    units = F.coalesce(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), F.array().cast("array<string>"))
    return F.transform(units, lambda u: F.conv(F.substring(F.md5(u.cast("binary")), 1, 8), 16, 10).cast("long"))


def run_hash(units: Column, at: Column, base: int) -> Column:
    """Rolling hash of the K units from place `at` on; of all units, if there are fewer."""
    first = F.get(units, at) % P
    for j in range(1, K):
        first = (first * base + F.get(units, at + j)) % P
    few = F.aggregate(units, F.lit(0).cast("long"), lambda a, u: (a * base + u) % P)
    return F.when(F.size(units) >= K, first).otherwise(few)


def runs(units: Column) -> Column:
    """Each run's hash and place in one number."""
    n = F.greatest(F.size(units) - (K - 1), F.least(F.size(units), F.lit(1)))
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.shiftleft(run_hash(units, i, B), 32) + (F.lit(LAST) - i))


def _least_of_next(a: Column, step: int) -> Column:
    """Elementwise least of a and a moved by `step`, the last element standing in beyond the end."""
    return F.transform(a, lambda x, i: F.least(x, F.get(a, F.least(i + step, F.size(a) - 1))))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds `name`: the fingerprint of column `text`, an array of (h, pos) in order of position; empty for null and blank texts.

    Window minima come from log2(W) passes that double the span. Each step is a column of its own, so that no array is computed anew for each of its elements.
    """
    others = [c for c in df.columns if c != name]
    t, u = "__step", "__units"
    step = df.select(*others, unit_numbers(F.col(text)).alias(u))
    step = step.select(*others, u, runs(F.col(u)).alias(t))
    span = 1
    while span < W:
        step = step.select(*others, u, _least_of_next(F.col(t), span).alias(t))
        span *= 2
    step = step.select(*others, u, F.slice(t, F.lit(1), F.greatest(F.size(t) - (W - 1), F.lit(1))).alias(t))
    step = step.select(*others, u, F.filter(t, lambda x, i: (i == 0) | (F.get(F.col(t), i - 1) != x)).alias(t))
    step = step.select(*others, u, F.transform(t, lambda x: F.struct(F.shiftright(x, 32).alias("h"), (F.lit(LAST) - x.bitwiseAND(F.lit(LAST))).cast("int").alias("pos"))).alias(t))
    chosen = F.transform(t, lambda x: F.struct((x["h"] * (P + 1) + run_hash(F.col(u), x["pos"], B2)).alias("h"), x["pos"].alias("pos")))
    return step.select(*others, chosen.alias(name))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the distinct hashes of two arrays of hashes; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def digest(fingerprint: Column) -> Column:
    """Number of selected hashes and the MD5 of the list `hash:position,...`."""
    listed = F.array_join(F.transform(fingerprint, lambda x: F.concat(x["h"].cast("string"), F.lit(":"), x["pos"].cast("string"))), ",")
    return F.concat(F.size(fingerprint).cast("string"), F.lit("-"), F.md5(listed.cast("binary")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (array of h, pos) of every whole text; no shuffle."""
    return with_fingerprint(docs.select("doc_id", "text"), "text", "fingerprint").select("doc_id", "fingerprint")


def with_next(df: DataFrame, take: dict[str, str], rows_per_bucket: int = 2000) -> DataFrame:
    """Each row with columns of the row of next higher doc_id (the first's, for the last). `take`: new names and columns.

    Rows are dealt to ranges of doc_id by approximate quantiles, and the first row of each range also goes to the range before it, so that one shuffle and
    a window over each range suffice. Ranges follow the rows up to 65,536 of them; beyond 10**8 rows a range grows and is sorted on disk, as any sort is. Null ids come first, equal ids in the order of their texts.
    """
    df = df.withColumn("doc_id", F.col("doc_id").cast("long"))
    edges = id_edges(df, "doc_id", rows_per_bucket)
    stretch = max(64, math.isqrt(len(edges)))
    below = lambda a: F.size(F.filter(a, lambda e: e <= F.col("doc_id")))
    if edges:
        chunks = [edges[i : i + stretch] for i in range(0, len(edges), stretch)]
        longs = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
        chunk = below(longs([c[0] for c in chunks])).cast("int")
        lists = F.split(F.lit(";".join(",".join(map(str, c)) for c in chunks)), ";")
        own = F.split(F.get(lists, chunk - 1), ",").cast("array<bigint>")
        bucket = F.when(F.col("doc_id").isNull() | (chunk == 0), 0).otherwise((chunk - 1) * stretch + below(own)).cast("int")
    else:
        bucket = F.lit(0)
    dealt = df.withColumn("__bucket", bucket)
    firsts = dealt.groupBy("__bucket").agg(F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("nulls")).orderBy("__bucket").collect()
    used = [r["__bucket"] for r in firsts]
    lows = {r["__bucket"]: None if r["nulls"] else r["low"] for r in firsts}
    size = max(used, default=0) + 1
    text = lambda xs: F.split(F.lit(",".join(xs)), ",")
    low = F.get(text([str(lows[b]) if lows.get(b) is not None else "" for b in range(size)]), F.col("__bucket"))
    before = {b: used[k - 1] for k, b in enumerate(used)}
    target = F.get(text([str(before.get(b, 0)) for b in range(size)]), F.col("__bucket")).cast("int")
    home = F.struct(F.col("__bucket").alias("b"), F.lit(0).alias("ghost"))
    first = F.coalesce(F.col("doc_id").cast("string"), F.lit("")) == low
    places = F.when(first, F.array(home, F.struct(target.alias("b"), F.lit(1).alias("ghost")))).otherwise(F.array(home))
    spread = dealt.withColumn("__place", F.explode(places)).drop("__bucket")
    order = Window.partitionBy("__place.b").orderBy("__place.ghost", F.col("doc_id").asc_nulls_first(), "text")
    ahead = spread.withColumns({new: F.lead(F.struct(old)).over(order) for new, old in take.items()})
    return ahead.filter("__place.ghost = 0").withColumns({new: F.col(f"{new}.{old}") for new, old in take.items()}).drop("__place")


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """The contract's digest: every text against itself with the last floor(n / 2) code points replaced by the next document's first ones, and against the next document.

    Rows: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A null text is empty. Repeated rows are documents of their own; an empty
    table gives no rows.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = with_fingerprint(texts, "text", "fp")
    own = own.select("doc_id", "text", digest(F.col("fp")).alias("fingerprint"), F.array_distinct(F.transform("fp", lambda x: x["h"])).alias("hashes"))
    both = with_next(own, {"next_text": "text", "next_hashes": "hashes"})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    both = both.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "hashes", likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"))
    done = with_fingerprint(both, "edited", "fe")
    return done.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", digest(F.col("fe")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.array_distinct(F.transform("fe", lambda x: x["h"]))).alias("near_edited"), "near_next",
    )
