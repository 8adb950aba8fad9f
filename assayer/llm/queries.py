"""The queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import align, decontaminate, exact_dedup, license_scan, line_dedup, merkle, packing, pii, quality, simhash, topk, toxicity, url_filter
from assayer.llm.shared import ascii_lower
from assayer.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.size(decontaminate.covered(F.col("hits"))).cast("long")
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


_UP, _LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_UP}, {_LOW}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op3_benchmark_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, width, array_to_string(w[i:i + width - 1], ' ') AS k FROM (
    SELECT item, w, least(len(w), 10) AS width, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
wide AS (SELECT DISTINCT width FROM win),
pos AS (
  SELECT doc_id, i, width, array_to_string(w[i:i + width - 1], ' ') AS k FROM (
    SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM d, wide WHERE len(w) >= width)),
hit AS (SELECT doc_id, i, pos.width AS width, item FROM pos JOIN win ON pos.k = win.k AND pos.width = win.width),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query
def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filter.CONTRACT_RULES + url_filter.SPAM_RULES
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)
    named = F.col("rule").isin([r.name for r in url_filter.CONTRACT_RULES])
    return judged.select("page_id", "host", "path", F.when(named, F.col("rule")).alias("rule"), "verdict")


ORACLES["op7_url_filters"] = rf"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {_UP}, {_LOW}) AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT u.*, h || p AS rule, v FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
b AS (SELECT page_id, host, path, max_by(rule, length(rule)) AS rule, max_by(v, length(rule)) AS v FROM m GROUP BY ALL)
SELECT page_id, host, path, rule, CASE WHEN v IS NOT NULL THEN v
  WHEN regexp_matches(host || path, '(?s)^([^/]*[^a-z0-9/])?({"|".join(r.name for r in url_filter.SPAM_RULES)})([^a-z0-9].*)?$') THEN 'block' ELSE 'allow' END AS verdict
FROM b
"""


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


ORACLES["op9_exact_dedup"] = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), {_UP}, {_LOW}) AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def _canonical_sql(text: str) -> str:
    c = rf"trim(regexp_replace(regexp_replace(lower({text}), '(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*$', ' ', 'g'), '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+', ' ', 'g'))"
    c = f"(' ' || {c} || ' ')"
    for other, one in license_scan.SPELLINGS:
        c = f"replace({c}, ' {other} ', ' {one} ')"
    return f"trim({c})"


_KNOWN = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in license_scan.KNOWN)
ORACLES["op10_license_scan"] = rf"""
WITH k AS (SELECT {_canonical_sql("t")} AS c, min(l) AS license FROM (VALUES {_KNOWN}) v(l, t) GROUP BY 1),
d AS (SELECT doc_id, coalesce(text, '') AS raw FROM documents),
lines AS (SELECT doc_id, {_canonical_sql("line")} AS c FROM (SELECT doc_id, unnest(regexp_split_to_array(raw, '\r?\n')) AS line FROM d)),
hits AS (SELECT doc_id, count(*) AS n, list(DISTINCT license) AS ls FROM lines JOIN k USING (c) GROUP BY doc_id)
SELECT d.doc_id, sha256({_canonical_sql("raw")}) AS digest, k.license, CAST(coalesce(n, 0) AS BIGINT) AS n_lines,
  coalesce(array_to_string(list_sort(ls), ','), '') AS line_licenses
FROM d LEFT JOIN k ON k.c = {_canonical_sql("raw")} LEFT JOIN hits USING (doc_id)
"""


@query
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    gone = line_dedup.later_matches(docs)
    lines = docs.select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).alias("n"))
    return lines.join(gone, lines["doc_id"] == gone["id"], "left").select(
        "doc_id", F.coalesce("n", F.lit(1)).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.transform("removed", lambda k: k.cast("string")), ","), F.lit("")).alias("removed_lines"),
    )


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    changed = merkle.leaf(*(ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in fields))
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    proved = merkle.prove(table(spark, sf_dir, "documents"), fields, carry={"tampered": F.when(chosen, F.unhex(changed))})
    folded = merkle.fold(F.coalesce(F.lower(F.hex("tampered")), "leaf"), F.col("proof"))
    out = proved.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.siblings(F.col("proof"))).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field_sql(c: str) -> str:
    return f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"


_LEAF = " || ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars", "text")))
_CHANGED = " || ".join([*map(_field_sql, ("doc_id", "source", "lang", "n_chars")), _field_sql(f"translate(text, {_UP}, {_LOW})")])
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""
ORACLES["op11_merkle_manifest"] = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, sha256({_LEAF}) AS d, CASE WHEN {_CRC} % 3 = 0 THEN sha256({_CHANGED}) END AS other,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g
  FROM documents),
low(g, l, k, n, d) AS (
  SELECT g, 0, k, n, d FROM leaf UNION ALL
  SELECT g, l + 1, k // 8, any_value((n + 7) // 8), sha256(string_agg(d, '' ORDER BY k)) FROM low WHERE n > 1 GROUP BY g, l + 1, k // 8),
sub AS (SELECT g, l, d FROM low WHERE n = 1),
high(g, l, k, n, d) AS (
  SELECT -1, 0, g, (SELECT count(*) FROM sub), d FROM sub UNION ALL
  SELECT -1, l + 1, k // 8, any_value((n + 7) // 8), sha256(string_agg(d, '' ORDER BY k)) FROM high WHERE n > 1 GROUP BY l + 1, k // 8),
node AS (SELECT * FROM low WHERE n > 1 UNION ALL SELECT * FROM high WHERE n > 1),
side AS (
  SELECT g, l, k, coalesce(string_agg(d, '') OVER (PARTITION BY g, l, k // 8 ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lo,
    coalesce(string_agg(d, '') OVER (PARTITION BY g, l, k // 8 ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS hi FROM node),
link AS (
  SELECT g, l, k, lo, hi, g AS g2, l + 1 AS l2, k // 8 AS k2 FROM side WHERE g >= 0 OR l > 0 UNION ALL
  SELECT sub.g, sub.l, 0, lo, hi, -1, 1, side.k // 8 FROM sub JOIN side ON side.g = -1 AND side.l = 0 AND side.k = sub.g),
walk(doc_id, g, l, k, h, proof) AS (
  SELECT doc_id, g, 0, k, coalesce(other, d), '' FROM leaf UNION ALL
  SELECT doc_id, g2, l2, k2, sha256(lo || h || hi), proof || lo || hi FROM walk JOIN link USING (g, l, k)),
done AS (SELECT doc_id, max_by(h, length(proof)) AS h, max_by(proof, length(proof)) AS proof FROM walk GROUP BY doc_id)
SELECT leaf.doc_id, leaf.d AS leaf, sub.d AS subroot, (SELECT d FROM high WHERE n = 1) AS root, sha256(proof) AS proof_sha256,
  h AS folded_root, h = (SELECT d FROM high WHERE n = 1) AS verified
FROM leaf JOIN sub USING (g) JOIN done USING (doc_id)
"""


@query
def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


ORACLES["op12_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_corpus(table(spark, sf_dir, "documents"))
