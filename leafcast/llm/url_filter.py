"""URL filter: host and path rules first, then logistic regression on hashed character n-grams. DataFrame functions only."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, stored

#: Hashed features; n-gram lengths.
FEATURES = 4096
GRAMS = (3, 4)

#: Small labelled word lists, from which the labelled URLs are made by rule.
BLOCKED_WORDS = "casino poker slots lottery gambling bets jackpot pills pharmacy viagra adult porn xxx escort sexcam spam spammer farm ads adserver track tracker click popunder malware phishing cheap free win prize loans payday replica warez".split()
ALLOWED_WORDS = "news blog science museum library garden school weather history music travel recipes docs wiki forum city health sports books art film photo nature street letters kitchen research mountain river theatre poetry engineering chess radio archive harbor bakery bridge planet village".split()


@dataclass(frozen=True)
class Rule:
    """`host/path-prefix` with its verdict; fits the host and its subdomains."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


#: Fixed values of the contract.
RULES = (Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow"))


def host(url: Column) -> Column:
    """After the first `://`, up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or no `://`."""
    found = F.regexp_extract(url, "://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules: tuple[Rule, ...], host: Column, path: Column, value: str) -> Column:
    """`text` or `verdict` of the longest rule that fits, else null. Rules are part of the plan: a list for people, of some thousand at most."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the last one that is put on top is tried first
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        found = F.when(fits, F.lit(getattr(r, value))).otherwise(found)
    return found


def marked(host: Column, path: Column) -> tuple[Column, Column]:
    """The two strings whose n-grams count: host and path between marks, the path with its digit runs made one."""
    return F.concat(F.lit("^"), host, F.lit("$")).alias("hm"), F.concat(F.lit("^"), F.regexp_replace(path, "[0-9]+", "0"), F.lit("$")).alias("pm")


def features(hm: Column, pm: Column) -> Column:
    """Distinct numbers below FEATURES: hashes of the n-grams of two marked strings, which must be columns of the child (they are read for each n-gram)."""
    out = []
    for mark, text in (("h", hm), ("p", pm)):
        for n in GRAMS:
            out.append(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), _hashed(text, f"{mark}{n}", n)))
    return F.array_distinct(F.concat(*out))


def _hashed(text: Column, tag: str, n: int):
    """The feature of the n-gram that starts at a place of the text."""

    def feature(i: Column) -> Column:
        return F.pmod(F.crc32(F.concat(F.lit(tag), F.substring(text, i, F.lit(n))).cast("binary")), F.lit(FEATURES)).cast("int")

    return feature


#: Common letter groups, of which neutral host names are made by rule.
SYLLABLES = "the ther tion ing ble and her est ent on re st an in er or ti ha ou wh sh ea ed es ly nt at en".split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The default small labelled table (url, blocked), made by rule from the word lists. Subdomains, top-level domains, languages and paths
    go round alike under either label, so that only words tell them apart."""
    subs, tlds, langs = ("www.", "blog.", "m.", ""), ("net", "com", "org"), ("en", "de", "fr", "es")
    ends = ("", ".html", "/", "?page=2", "#top")
    neutral = [SYLLABLES[i] + SYLLABLES[(i * k + k) % len(SYLLABLES)] for k in (1, 3, 5, 9) for i in range(len(SYLLABLES))]
    rows = []

    def add(names: list[str], blocked: int) -> None:
        for n in names:
            k = len(rows)
            rows.append((f"http{'s' * (k % 2)}://{subs[k * 7 % 4]}{n}.example.{tlds[k * 5 % 3]}/{langs[k * 3 % 4]}/{k * 37 % 991}{ends[k % 5]}", blocked))

    pairs = lambda words, step: [f"{w}-{words[(i * step + step) % len(words)]}" for i, w in enumerate(words)]
    add(pairs(BLOCKED_WORDS, 1) + pairs(BLOCKED_WORDS, 5) + pairs(BLOCKED_WORDS, 7) + [f"{w}{i}" for i, w in enumerate(BLOCKED_WORDS)], 1)
    add(pairs(ALLOWED_WORDS, 1) + pairs(ALLOWED_WORDS, 5) + pairs(ALLOWED_WORDS, 7) + [f"{w}{i}" for i, w in enumerate(ALLOWED_WORDS)] + list(ALLOWED_WORDS) + neutral, 0)
    table = F.array(*(F.struct(F.lit(u).alias("url"), F.lit(b).cast("double").alias("blocked")) for u, b in rows))
    return spark.range(1).select(F.inline(table))


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    intercept: float

    def score(self, found: Column) -> Column:
        """Probability of `blocked` from an array of features."""
        w = F.split(F.lit(",".join(map(repr, self.weights))), ",").cast("array<double>")
        total = F.aggregate(found, F.lit(float(self.intercept)), lambda a, i: a + F.get(w, i))
        return 1 / (1 + F.exp(-total))


def train(labelled: DataFrame, regularisation: float = 0.001, iterations: int = 80, most: int = 20_000) -> Model:
    """Logistic regression over the hashed n-grams of a small labelled table (url, blocked 0 or 1); rows with a null label are left out. At most `most` rows are
    fitted, the first by hash of the url. Without rows of both labels nothing is learned, and nothing is blocked."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = labelled.filter("blocked is not null").orderBy(F.crc32(F.coalesce("url", F.lit("")).cast("binary")), "url").limit(most)
    kinds = rows.agg(F.min("blocked").alias("low"), F.max("blocked").alias("high")).first()
    if kinds["low"] is None or kinds["low"] == kinds["high"]:
        return Model((0.0,) * FEATURES, -1.0)
    strings = rows.select(F.col("blocked").cast("double").alias("label"), *marked(host(F.col("url")), path(F.col("url"))))
    found, sparse = stored(strings.select("label", features(F.col("hm"), F.col("pm")).alias("on")), "urls")
    dense = F.transform(F.sequence(F.lit(0), F.lit(FEATURES - 1)), lambda i: F.array_contains("on", i).cast("double")).alias("dense")
    rows, full = stored(found.select("label", dense).coalesce(1), "urls")
    fit = LogisticRegression(maxIter=iterations, regParam=regularisation, standardization=False).fit(rows.select("label", array_to_vector("dense").alias("features")))
    drop(found.sparkSession, sparse, full)
    return Model(tuple(float(x) for x in fit.coefficients), float(fit.intercept))


def filter_urls(pages: DataFrame, model: Model, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row (columns page_id, url). A fitting rule decides; else a score of `threshold` or more blocks.

    Null urls and urls without `://` have an empty host and path, which no rule fits; the model judges them as it judges any text. Repeated rows give repeated results.
    One projection over the url column; no shuffle.
    """
    parts = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    h, p = F.col("host"), F.col("path")
    parts = parts.select("page_id", "host", "path", *marked(h, p))
    found = parts.withColumns({"rule": rule_of(rules, h, p, "text"), "ruled": rule_of(rules, h, p, "verdict"), "score": model.score(features(F.col("hm"), F.col("pm")))})
    verdict = F.coalesce("ruled", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
