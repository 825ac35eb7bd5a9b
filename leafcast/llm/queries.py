"""Registered queries of this subpackage: opN_<name> over whole tables, and their SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary, html_text, language, mixing, near_dup, packing, quality, tokencount, tokens, url_filter, winnowing
from .common import read

#: Names of the public tokenizer files; public_tokenizers.path(name) gives their place.
WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
#: Ids that end a document, fixed by the contracts.
END_OF_FILE_DOCUMENT = 2
END_OF_PACKED_DOCUMENT = 0
SEQUENCE = 2048


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_with_edits(read(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read(spark, sf_dir, "pages"), url_filter.train(url_filter.labelled_urls(spark)))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read(spark, sf_dir, "documents"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of op5 that SQL has."""
    return op5_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2 that SQL has: where a rule decides, the verdict too."""
    found = op2_url_filter(spark, sf_dir)
    return found.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(read(spark, sf_dir, "documents"), tokencount.sentencepiece_vocabulary(tokenizer_path(PIECES)))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.round_trip(read(spark, sf_dir, "documents"), tokens.read_tokenizer(tokenizer_path(WORD_BPE)), END_OF_FILE_DOCUMENT)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(read(spark, sf_dir, "documents"), tokens.read_tokenizer(tokenizer_path(WORD_BPE)), END_OF_PACKED_DOCUMENT, SEQUENCE)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.language_id(read(spark, sf_dir, "documents"))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_fingerprints, op2_url_filter, op3_html_text, op4_mix_sources, op5_quality_rules, op6_token_counts, op7_token_files, op8_packing, op9_language_id, op10_near_duplicates, pipeline, quality_base, url_parts)
    return {f.__name__: f for f in found}


OP1_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
nexts AS (
  SELECT doc_id, text, length(text) AS n,
         coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text,
         coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id
  FROM t WINDOW w AS (ORDER BY doc_id, text)),
texts AS (
  SELECT doc_id, 0 AS kind, text FROM t
  UNION ALL
  SELECT doc_id, 1, substring(text, 1, n - n // 2) || substring(next_text, 1, n // 2) FROM nexts),
units AS (
  SELECT doc_id, kind, text, list_transform(regexp_extract_all(text, 'UNIT'), lambda x: ('0x' || substring(md5(x), 1, 8))::BIGINT) AS u FROM texts),
grams AS (SELECT doc_id, kind, u, unnest(range(greatest(len(u) - 4, least(len(u), 1)))) AS pos FROM units),
hashed AS (
  SELECT doc_id, kind, pos,
         list_reduce(list_prepend(0::BIGINT, u[pos + 1 : pos + 5]), lambda a, x: (a * 1000003 + x) % 2147483647) AS h,
         list_reduce(list_prepend(0::BIGINT, u[pos + 1 : pos + 5]), lambda a, x: (a * 998244353 + x) % 2147483647) AS h2 FROM grams),
minima AS (
  SELECT doc_id, kind, pos, count(*) OVER p AS k, row_number() OVER (PARTITION BY doc_id, kind ORDER BY pos) AS r,
         min(h * 4294967296 + (4294967295 - pos)) OVER (PARTITION BY doc_id, kind ORDER BY pos ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS m
  FROM hashed WINDOW p AS (PARTITION BY doc_id, kind)),
picked AS (
  SELECT DISTINCT doc_id, kind, (4294967295 - m % 4294967296)::BIGINT AS pos FROM minima WHERE r <= greatest(k - 15, 1)),
chosen AS (SELECT p.doc_id, p.kind, h * 2147483648 + h2 AS h, p.pos FROM picked p JOIN hashed g ON g.doc_id = p.doc_id AND g.kind = p.kind AND g.pos = p.pos),
lists AS (
  SELECT doc_id, kind, count(*) AS n, string_agg(h || ':' || pos, ',' ORDER BY pos) AS listed, list_distinct(list(h)) AS hs FROM chosen GROUP BY doc_id, kind),
full_lists AS (
  SELECT u.doc_id, u.kind, u.text, coalesce(l.n, 0) || '-' || md5(coalesce(l.listed, '')) AS fingerprint, coalesce(l.hs, []) AS hs
  FROM units u LEFT JOIN lists l ON l.doc_id = u.doc_id AND l.kind = u.kind)
SELECT n.doc_id, n.n AS n_chars, sha256(e.text) AS edited_sha256, o.fingerprint, e.fingerprint AS edited_fingerprint,
       CASE WHEN len(o.hs) + len(e.hs) = 0 THEN 1.0::DOUBLE
            ELSE len(list_intersect(o.hs, e.hs))::DOUBLE / (len(o.hs) + len(e.hs) - len(list_intersect(o.hs, e.hs))) END AS near_edited,
       CASE WHEN len(o.hs) + len(x.hs) = 0 THEN 1.0::DOUBLE
            ELSE len(list_intersect(o.hs, x.hs))::DOUBLE / (len(o.hs) + len(x.hs) - len(list_intersect(o.hs, x.hs))) END AS near_next
FROM nexts n
JOIN full_lists o ON o.doc_id = n.doc_id AND o.kind = 0
JOIN full_lists e ON e.doc_id = n.doc_id AND e.kind = 1
JOIN full_lists x ON x.doc_id = n.next_id AND x.kind = 0
"""
OP1_SQL = OP1_SQL.replace("'UNIT'", f"'{winnowing.UNIT}'")


#: Documents have one source each here, so the flow fills every source from its own words, and a source's target is a level that rises until all sources
#: hold 150% of the words: sources in ascending order of the level that fills them twice, the first that isn't filled sets it.
OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INTEGER + 1]::DOUBLE AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT source, source_size, weight, row_number() OVER o AS r,
         (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - 2 * (sum(source_size) OVER o - source_size)::DOUBLE) / (sum(weight) OVER () - sum(weight) OVER o + weight) AS level
  FROM sources WINDOW o AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
final AS (SELECT level FROM levels WHERE level * weight <= 2 * source_size ORDER BY r LIMIT 1),
targets AS (
  SELECT source, source_size, least(f.level * weight, 2 * source_size::DOUBLE) AS target, round_even(least(f.level * weight, 2 * source_size::DOUBLE), 0)::BIGINT AS quota
  FROM levels, final f),
placed AS (
  SELECT doc_id, source, size,
         (sum(size) OVER (PARTITION BY source ORDER BY substring(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 15), doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS low
  FROM sized)
SELECT p.doc_id, p.size, t.source_size, t.target,
       greatest(0, least(p.size, t.quota - p.low)) + greatest(0, least(p.size, t.quota - t.source_size - p.low)) AS taken, p.source
FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
"""

#: For tables whose doc_ids are all different. Pairs come from an equality join on shingles, which suits tables of some thousand documents.
OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_have FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * both_have >= 75 * (p.n + q.n - both_have)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM sizes
  UNION
  SELECT r.doc_id, w.b FROM reach r JOIN ways w ON w.a = r.other),
least_reached AS (SELECT doc_id, min(other) AS component FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(c.component, d.doc_id) AS component_id, d.doc_id IS NOT DISTINCT FROM coalesce(c.component, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least_reached c ON c.doc_id = d.doc_id
"""


QUALITY_SQL = r"""
WITH words AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) > 4)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS k FROM windows) WHERE k > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, range(0, 5) r(j) GROUP BY doc_id),
measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM words)
SELECT m.doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
       n_words < 10 OR 100 * coalesce(c.n, 0) > 20 * n_words AS base_failed
FROM measured m LEFT JOIN covered c ON c.doc_id = m.doc_id
"""

URL_SQL = r"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(rule, of_host, of_path, ruled) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
fits AS (
  SELECT p.page_id, r.rule, r.ruled, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC) AS k FROM parts p
  JOIN rules r ON (p.host = r.of_host OR ends_with(p.host, '.' || r.of_host)) AND starts_with(p.path, r.of_path))
SELECT p.page_id, host, path, f.rule, f.ruled FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.k = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"quality_base": QUALITY_SQL, "url_parts": URL_SQL, "op1_fingerprints": OP1_SQL, "op4_mix_sources": OP4_SQL, "op10_near_duplicates": OP10_SQL}
