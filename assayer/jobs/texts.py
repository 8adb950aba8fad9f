"""Text scalars over documents, pages, benchmark and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import text as X
from assayer.jobs.base import Tables, query


def _n(c):
    return F.size(c).cast("bigint")


def _joined(c):
    """A short stand-in for a long list: its elements' digest."""
    return F.md5(F.array_join(c, "\x01"))


_CODE = "regexp_extract_all(html, '[A-Za-z_][A-Za-z0-9_]*|[^\\sA-Za-z_]')"


@query(f"SELECT page_id, len({_CODE}) AS n, md5(array_to_string({_CODE}, chr(1))) AS digest FROM pages")
def tokens(spark, sf_dir):
    t = X.code_tokens(F.col("html"))
    return Tables(spark, sf_dir).pages.select("page_id", _n(t).alias("n"), _joined(t).alias("digest"))


@query("""
WITH i AS (SELECT page_id, regexp_extract_all(html, '[A-Za-z_][A-Za-z0-9_]*') AS a FROM pages)
SELECT page_id, len(list_distinct(a)) AS n, len(list_distinct(list_filter(a, lambda t: length(t) >= 4))) AS n_long, md5(array_to_string(list_sort(list_distinct(a)), chr(1))) AS digest FROM i""")
def ident_sets(spark, sf_dir):
    a = X.identifiers(F.col("html"))
    return Tables(spark, sf_dir).pages.select("page_id", _n(a).alias("n"), _n(X.identifiers(F.col("html"), 4)).alias("n_long"), _joined(F.array_sort(a)).alias("digest"))


@query("""
WITH z AS (SELECT item_id, regexp_replace(text, '\\s+', '', 'g') AS z FROM benchmark)
SELECT item_id, len(g) AS n, md5(array_to_string(list_sort(g), chr(1))) AS digest FROM (
  SELECT item_id, CASE WHEN length(z) >= 4 THEN list_distinct([substr(z, i, 4) for i in range(1, length(z) - 2)]) ELSE [] END AS g FROM z)""")
def char4grams(spark, sf_dir):
    g = X.char_grams(F.col("text"))
    return Tables(spark, sf_dir).benchmark.select("item_id", _n(g).alias("n"), _joined(F.array_sort(g)).alias("digest"))


@query("""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z_][A-Za-z_0-9]*|[0-9]+|\\S') AS t FROM documents)
SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(1))) AS digest FROM (
  SELECT doc_id, CASE WHEN len(t) = 0 THEN [] ELSE list_distinct([array_to_string(t[i:i + 4], ' ') for i in range(1, greatest(len(t) - 4, 1) + 1)]) END AS s FROM t)""")
def shingles(spark, sf_dir):
    """Five-token shingles of whole texts."""
    s = X.shingles(F.col("text"))
    return Tables(spark, sf_dir).documents.select("doc_id", _n(s).alias("n"), _joined(F.array_sort(s)).alias("digest"))


@query("""
SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)/\\*.*?\\*/', ' ', 'g'), '//[^\\n]*', ' ', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) AS digest FROM pages""")
def canonicalize(spark, sf_dir):
    return Tables(spark, sf_dir).pages.select("page_id", F.md5(X.canonical_code(F.col("html"))).alias("digest"))


@query("""
SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(html, '[A-Za-z_][A-Za-z0-9_]*', 'X', 'g'), '[0-9]+', '0', 'g'), '\\s+', '', 'g')) AS fp FROM pages""")
def abstract_fp(spark, sf_dir):
    """Fingerprint with identifiers and numbers abstracted: equal for renamed copies."""
    return Tables(spark, sf_dir).pages.select("page_id", F.md5(X.abstract_code(F.col("html"))).alias("fp"))


@query("""
WITH l AS (SELECT page_id, string_split(regexp_replace(regexp_replace(regexp_replace(html, '(?s)/\\*.*?\\*/', ' ', 'g'), '//[^\\n]*', ' ', 'g'), '\\n$', ''), chr(10)) AS ls FROM pages),
s AS (SELECT page_id, list_filter([regexp_replace(x, '\\s+', '', 'g') for x in ls], lambda x: NOT regexp_matches(x, '^[{}]*$')) AS s FROM l)
SELECT page_id, len(s) AS n, md5(array_to_string(s, chr(1))) AS digest FROM s""")
def stmts(spark, sf_dir):
    s = X.statements(F.col("html"))
    return Tables(spark, sf_dir).pages.select("page_id", _n(s).alias("n"), _joined(s).alias("digest"))


@query("""
SELECT cwe, count(*) AS n FROM (SELECT CASE WHEN m <> '' THEN 'CWE-' || m ELSE 'CWE-unknown' END AS cwe FROM (
  SELECT regexp_extract(CASE p_size % 3 WHEN 0 THEN 'cwe_' || p_size WHEN 1 THEN 'CWE ' || p_size || ' x' ELSE p_name END, '(?i)CWE[-_ ]?([0-9]+)', 1) AS m FROM part)) GROUP BY cwe""")
def cwe_norm(spark, sf_dir):
    """Weakness classes in one spelling, from mixed spellings."""
    size = F.col("p_size").cast("string")
    raw = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("cwe_"), size)).when(F.col("p_size") % 3 == 1, F.concat(F.lit("CWE "), size, F.lit(" x"))).otherwise(F.col("p_name"))
    return Tables(spark, sf_dir).part.select(X.class_id(raw).alias("cwe")).groupBy("cwe").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT a.p_name AS a, b.p_name AS b, CAST(levenshtein(a.p_name, b.p_name) AS BIGINT) AS d, round(levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name), 1)::DOUBLE, 6) AS norm
FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b ON a.p_name < b.p_name""")
def lev_norm(spark, sf_dir):
    """Edit distances of the different part names, a small dimension of two-word names."""
    names = Tables(spark, sf_dir).part.select("p_name").distinct()
    a, b = names.withColumnRenamed("p_name", "a"), names.withColumnRenamed("p_name", "b")
    met = a.join(b, F.col("a") < F.col("b"))
    return met.select("a", "b", F.levenshtein("a", "b").cast("bigint").alias("d"), F.round(X.line_distance(F.col("a"), F.col("b")), 6).alias("norm"))


@query("""
SELECT conv_id, turn, md5(coalesce(list_reduce(b, lambda a, x: CASE WHEN length(x) > length(a) THEN x ELSE a END), '')) AS longest, CAST(coalesce(len(b), 0) AS BIGINT) AS n FROM (
  SELECT conv_id, turn, CASE WHEN len(regexp_extract_all(text, '[^.]+')) > 0 THEN regexp_extract_all(text, '[^.]+') END AS b FROM conversations)""")
def longest_block(spark, sf_dir):
    """The longest block of a reply, the first among equals."""
    blocks = F.regexp_extract_all("text", F.lit("[^.]+"), F.lit(0))
    longest = F.aggregate(blocks, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    return Tables(spark, sf_dir).conversations.select("conv_id", "turn", F.md5(longest).alias("longest"), _n(blocks).alias("n"))


@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN upper(event_type) LIKE 'P%' THEN 1 WHEN event_type = 'error' THEN NULL ELSE 0 END AS verdict,
  substr(CAST(ts AS VARCHAR), 1, 10) AS day, year(ts) AS year FROM events""")
def parse_verdict(spark, sf_dir):
    """JSON fields, an answer parsed to 1, 0 or null, and dates as text."""
    e = Tables(spark, sf_dir).events
    verdict = F.when(F.upper("event_type").startswith("P"), 1).when(F.col("event_type") == "error", None).otherwise(0)
    return e.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), verdict.alias("verdict"), F.substring(F.col("ts").cast("string"), 1, 10).alias("day"), F.year("ts").cast("bigint").alias("year"))


@query("""
SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]+)', 1) AS host, coalesce(nullif(regexp_extract(url, '/([0-9]+)', 1), ''), 'none') AS item,
  CASE WHEN regexp_matches(url, '\\.html') THEN 'html' WHEN contains(url, '?') THEN 'query' ELSE 'path' END AS kind, translate(lower(regexp_extract(url, '://([^/?#]+)', 1)), '.-', '__') AS safe FROM pages""")
def url_parts(spark, sf_dir):
    """Scheme, host, item and kind of each address, and a name safe for files."""
    host = F.regexp_extract("url", "://([^/?#]+)", 1)
    item = F.regexp_extract("url", "/([0-9]+)", 1)
    return Tables(spark, sf_dir).pages.select(
        "page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), host.alias("host"), F.when(item != "", item).otherwise("none").alias("item"),
        F.when(F.col("url").rlike(r"\.html"), "html").when(F.contains("url", F.lit("?")), "query").otherwise("path").alias("kind"), F.translate(F.lower(host), ".-", "__").alias("safe"))


@query("""
SELECT doc_id, length(text)::BIGINT AS chars, len(string_split(text, chr(10)))::BIGINT AS newlines_1, len(string_split(regexp_replace(text, '\\n$', ''), chr(10)))::BIGINT AS lines,
 len(regexp_extract_all(text, '\\S+'))::BIGINT AS words, md5(regexp_replace(text, '[0-9\\s+*/<>=!&|-]+', '', 'g')) AS skeleton, format('{:.2f} [{:d}]', 0.25::DOUBLE, length(text)) AS shown FROM documents""")
def text_sizes(spark, sf_dir):
    """Characters, line feeds plus one, lines, words, an edit skeleton and a display form."""
    return Tables(spark, sf_dir).documents.select(
        "doc_id", F.length("text").cast("bigint").alias("chars"), _n(F.split("text", "\n")).alias("newlines_1"), _n(X.lines(F.col("text"))).alias("lines"),
        F.regexp_count("text", F.lit(r"\S+")).cast("bigint").alias("words"), F.md5(X.edit_skeleton(F.col("text"))).alias("skeleton"),
        F.format_string("%.2f [%d]", F.lit(0.25), F.length("text")).alias("shown"))


@query("""
SELECT doc_id, md5(regexp_replace(lower(text), '\\s+', '', 'g')) AS norm_md5, sha256(text) AS sha, ('0x' || substr(sha256(text), 1, 8))::BIGINT AS seed FROM documents""")
def content_keys(spark, sf_dir):
    """Keys of contents: normalised MD5, SHA-256, and a seed from its first eight digits."""
    sha = F.sha2("text", 256)
    return Tables(spark, sf_dir).documents.select("doc_id", F.md5(F.regexp_replace(F.lower("text"), r"\s+", "")).alias("norm_md5"), sha.alias("sha"), F.conv(F.substring(sha, 1, 8), 16, 10).cast("bigint").alias("seed"))
