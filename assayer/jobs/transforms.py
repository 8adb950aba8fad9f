"""Differences, patches, variants, verdicts, bounded loops and graphs over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from assayer.functions import diff as D
from assayer.jobs.base import Tables, query
from assayer.operators import graphs, ladder, sampling
from assayer.operators import windows as W


def _turn_pairs(t):
    """Each turn and the one after it: ``a`` and ``b``."""
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.conversations.select("conv_id", "turn", F.col("text").alias("a"), after.alias("b")).where("b is not null")


@query("""
WITH p AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
x AS (SELECT conv_id, turn, unnest(string_split(a, chr(10))) AS l, 1 AS i, 0 AS j FROM p WHERE b IS NOT NULL UNION ALL SELECT conv_id, turn, unnest(string_split(b, chr(10))), 0, 1 FROM p WHERE b IS NOT NULL),
c AS (SELECT conv_id, turn, l, sum(i) AS x, sum(j) AS y FROM x GROUP BY ALL)
SELECT conv_id, turn, sum(greatest(x - y, 0))::BIGINT AS removed, sum(greatest(y - x, 0))::BIGINT AS added FROM c GROUP BY ALL""")
def line_delta(spark, sf_dir):
    """Multiset difference of lines between a turn and the next, per row."""
    p = _turn_pairs(Tables(spark, sf_dir))
    sides = p.select("conv_id", "turn", F.explode(F.split("a", "\n")).alias("l"), F.lit(1).alias("x"), F.lit(0).alias("y"))
    sides = sides.unionByName(p.select("conv_id", "turn", F.explode(F.split("b", "\n")).alias("l"), F.lit(0).alias("x"), F.lit(1).alias("y")))
    c = sides.groupBy("conv_id", "turn", "l").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    return c.groupBy("conv_id", "turn").agg(F.sum(F.greatest(F.col("x") - F.col("y"), F.lit(0))).alias("removed"), F.sum(F.greatest(F.col("y") - F.col("x"), F.lit(0))).alias("added"))


def _code(t):
    """Source files of three functions, rendered from parts."""
    name = F.concat(F.lit("f_"), F.col("p_partkey").cast("string"))
    one = F.concat(F.lit("int "), name, F.lit("(int n) {\n  if (n > "), F.col("p_size").cast("string"), F.lit(") { return 0; }\n  return n;\n}\n"))
    files = t.part.select(F.floor(F.col("p_partkey") / 3).alias("file"), F.struct("p_partkey", one.alias("code")).alias("f"))
    return files.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list("f"))["code"], "\n").alias("text"))


@query("""
SELECT p_partkey // 3 AS file, 'f_' || p_partkey AS name, md5('f_' || p_partkey || '(int n) {' || chr(10) || '  if (n > ' || p_size || ') { return 0; }' || chr(10) || '  return n;' || chr(10) || '}') AS digest FROM part""")
def func_split(spark, sf_dir):
    """Functions of source files by a table function."""
    files = _code(Tables(spark, sf_dir))
    spark.udtf.register("split_functions", D.SplitFunctions)
    files.createOrReplaceTempView("assayer_files")
    found = spark.sql("SELECT file, name, code FROM assayer_files, LATERAL split_functions(text)")
    return found.select("file", "name", F.md5("code").alias("digest"))


_ATTEMPTS = """a AS (SELECT user_id, event_type AS arm, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS attempt, value,
  CASE WHEN value > 120 THEN 'ok' WHEN value > 60 THEN 'close' ELSE 'far' END AS reason FROM events),
r AS (SELECT user_id, arm, coalesce(min(attempt) FILTER (value > 120), max(attempt)) AS iterations, bool_or(value > 120) AS validated FROM a WHERE attempt <= 5 GROUP BY ALL)"""


def _runs(t):
    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    a = t.events.select("user_id", F.col("event_type").alias("arm"), F.row_number().over(order).cast("bigint").alias("attempt"), "value")
    reason = F.when(F.col("value") > 120, "ok").when(F.col("value") > 60, "close").otherwise("far")
    return ladder.replay(a, ["user_id", "arm"], "attempt", F.col("value") > 120, reason)


@query(f"WITH {_ATTEMPTS} SELECT r.user_id, r.arm, validated, iterations, reason FROM r JOIN a ON a.user_id = r.user_id AND a.arm = r.arm AND attempt = iterations")
def retry_ladder(spark, sf_dir):
    """A bounded retry loop replayed from recorded attempts."""
    return _runs(Tables(spark, sf_dir)).select("user_id", "arm", "validated", "iterations", "reason")


@query(f"""WITH {_ATTEMPTS} SELECT arm, count(*) AS n, count(*) FILTER (validated) AS k, round(avg(validated::INT), 6) AS vpr, round(coalesce(avg(iterations) FILTER (validated), 5), 6) AS iterations FROM r GROUP BY arm""")
def ladder_summary(spark, sf_dir):
    s = ladder.summary(_runs(Tables(spark, sf_dir)), ["arm"])
    return s.select("arm", "n", "k", F.round("vpr", 6).alias("vpr"), F.round("iterations", 6).alias("iterations"))


@query("""
WITH RECURSIVE e AS (SELECT k AS src, k + 1 AS dst, 0 AS cost FROM (SELECT p_partkey AS k, p_size FROM part) WHERE p_size > 35 UNION SELECT p_partkey, p_partkey // 2, 1 FROM part WHERE p_size % 2 = 1 UNION SELECT p_partkey, p_partkey - 1, 0 FROM part WHERE p_size > 45),
r(start, node, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION SELECT start, dst, depth + cost FROM r JOIN e ON node = src WHERE depth + cost <= 3)
SELECT start, node, min(depth) AS depth FROM r GROUP BY ALL""")
def graph_closure(spark, sf_dir):
    """Nodes that each part reaches over links at its depth, back links among them, and links that go one deeper, to depth 3."""
    k, part = F.col("p_partkey"), Tables(spark, sf_dir).part
    links = ((part.where("p_size > 35"), k + 1, 0), (part.where("p_size % 2 = 1"), F.floor(k / 2), 1), (part.where("p_size > 45"), k - 1, 0))
    edges = None
    for rows, dst, cost in links:
        one = rows.select(k.alias("src"), dst.alias("dst"), F.lit(cost).alias("cost"))
        edges = one if edges is None else edges.unionByName(one)
    return graphs.closure(part.select(k.alias("start")), edges.distinct(), 3)


@query("""
WITH f AS (SELECT doc_id, text, md5(regexp_replace(lower(text), '[^a-z]+', '', 'g')) AS fp FROM documents), g AS (SELECT fp, min(doc_id) AS first_id FROM f GROUP BY fp HAVING count(*) > 1)
SELECT f.doc_id, first_id, CASE WHEN f.text = x.text THEN 'identical' WHEN lower(f.text) = lower(x.text) THEN 'renamed' ELSE 'modified' END AS clone_type FROM f JOIN g USING (fp) JOIN documents x ON x.doc_id = first_id WHERE f.doc_id <> first_id""")
def clone_types(spark, sf_dir):
    """How each member of a family differs from its first: not, in case, or in more."""
    f = Tables(spark, sf_dir).documents.select("doc_id", F.md5(F.regexp_replace(F.lower("text"), "[^a-z]+", "")).alias("fp"), F.md5("text").alias("exact"), F.md5(F.lower("text")).alias("folded"))
    first = f.groupBy("fp").agg(F.min(F.struct("doc_id", "exact", "folded")).alias("x"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = f.join(first, "fp").where(F.col("doc_id") != F.col("x.doc_id"))
    kind = F.when(F.col("exact") == F.col("x.exact"), "identical").when(F.col("folded") == F.col("x.folded"), "renamed").otherwise("modified")
    return met.select("doc_id", F.col("x.doc_id").alias("first_id"), kind.alias("clone_type"))


@query("""
SELECT k_side, doc_id, md5(t) AS digest FROM (SELECT doc_id, unnest([1, 0]) AS k_side, unnest([text, lower(text)]) AS t FROM documents) WHERE true""")
def pair_rows(spark, sf_dir):
    """Two labelled rows from each pair."""
    sides = F.array(F.struct(F.lit(1).alias("k_side"), F.col("text").alias("t")), F.struct(F.lit(0).alias("k_side"), F.lower("text").alias("t")))
    return Tables(spark, sf_dir).documents.select("doc_id", F.inline(sides)).select("k_side", "doc_id", F.md5("t").alias("digest"))


@query("""SELECT o_orderkey, o_orderpriority, count(*) AS lines, sum(l_quantity) AS quantity, max(l_linenumber)::BIGINT AS last_line FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""")
def nested_targets(spark, sf_dir):
    """Families nested as arrays of structs and flattened again."""
    t = Tables(spark, sf_dir)
    families = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("targets"))
    nested = t.orders.join(families, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_orderpriority", "targets")
    flat = nested.select("o_orderkey", "o_orderpriority", F.inline("targets"))
    return flat.groupBy("o_orderkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"), F.max("l_linenumber").cast("bigint").alias("last_line"))


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'CWE-119' WHEN 1 THEN 'CWE-416' ELSE 'CWE-190' END AS cwe, CASE WHEN p_partkey % 3 = 0 THEN 'unseen' ELSE 'seen' END AS provenance,
 'buf_' || p_size || '[' || (p_partkey % 256) || ']' AS code, coalesce(nullif(p_brand, 'Brand#1'), 'unknown') AS brand FROM part""")
def template_rows(spark, sf_dir):
    """Rows rendered from cycled templates, with default fills."""
    k = F.col("p_partkey")
    cwe = F.element_at(F.array(*map(F.lit, ("CWE-119", "CWE-416", "CWE-190"))), (k % 3 + 1).cast("int"))
    return Tables(spark, sf_dir).part.select(
        "p_partkey", cwe.alias("cwe"), F.when(k % 3 == 0, "unseen").otherwise("seen").alias("provenance"),
        F.format_string("buf_%d[%d]", "p_size", k % 256).alias("code"), F.coalesce(F.nullif("p_brand", F.lit("Brand#1")), F.lit("unknown")).alias("brand"))


@query("""
WITH k AS (SELECT md5(props) AS k, first(event_id ORDER BY ts, event_id) AS v FROM events WHERE ts < '2024-01-15' GROUP BY 1),
n AS (SELECT md5(props) AS k, first(event_id ORDER BY ts, event_id) AS v FROM events WHERE ts >= '2024-01-15' GROUP BY 1)
SELECT k, v FROM k UNION ALL SELECT k, v FROM n WHERE k NOT IN (SELECT k FROM k)""")
def first_write_wins(spark, sf_dir):
    """An insert into a key-value table that keeps what is there."""
    e = Tables(spark, sf_dir).events.select(F.md5("props").alias("k"), F.col("event_id").alias("v"), "ts")
    old = W.first_wins(e.where("ts < timestamp_ntz '2024-01-15'"), ["k"], ["ts", "v"]).select("k", "v")
    new = W.first_wins(e.where("ts >= timestamp_ntz '2024-01-15'"), ["k"], ["ts", "v"]).select("k", "v")
    return old.unionByName(new.join(old.select("k"), "k", "left_anti"))


@query("""
WITH s AS (SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('e4-' || doc_id), doc_id) <= 20),
r AS (SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS k, avg((quality = 1)::INT) AS rate, avg(((quality = 1) = (toxic = 0))::INT) AS agree FROM s GROUP BY lang),
p AS (SELECT lang, count(*) AS pool FROM documents GROUP BY lang)
SELECT lang, n, k, round(rate, 6) AS rate, round(agree, 6) AS agreement, round(pool * rate / (SELECT count(*) FROM documents), 6) AS share FROM r JOIN p USING (lang)""")
def rater_audit(spark, sf_dir):
    """A stratified sample of labelled rows, its rate and agreement, and the share of the pool it stands for."""
    t = Tables(spark, sf_dir)
    rows = t.documents.select("doc_id", "lang").join(t.labels, "doc_id")
    s = sampling.stratified(rows, ["lang"], "doc_id", 20, "e4")
    good = F.col("quality") == 1
    r = s.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("k"), F.avg(good.cast("int")).alias("rate"), F.avg((good == (F.col("toxic") == 0)).cast("int")).alias("agree"))
    pool = t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("pool"))
    both = r.join(pool, "lang").crossJoin(F.broadcast(pool.agg(F.sum("pool").alias("all"))))
    return both.select("lang", "n", "k", F.round("rate", 6).alias("rate"), F.round("agree", 6).alias("agreement"), F.round(F.col("pool") * F.col("rate") / F.col("all"), 6).alias("share"))


@query("""
WITH f AS (SELECT conv_id, bool_or(contains(text, 'the')) FILTER (role = 'user') AS a, bool_or(contains(text, 'the')) FILTER (role = 'assistant') AS b FROM conversations GROUP BY conv_id)
SELECT count(*) AS n, count(*) FILTER (a AND NOT b) AS correct, count(*) FILTER (a AND b) AS both, count(*) FILTER (NOT a AND NOT b) AS neither, count(*) FILTER (NOT a AND b) AS reversed FROM f WHERE a IS NOT NULL AND b IS NOT NULL""")
def pairwise_t3(spark, sf_dir):
    """Pair outcomes: both sides judged, correct, both, neither or reversed."""
    said = lambda r: F.bool_or(F.when(F.col("role") == r, F.contains("text", F.lit("the"))))
    f = Tables(spark, sf_dir).conversations.groupBy("conv_id").agg(said("user").alias("a"), said("assistant").alias("b")).where("a is not null and b is not null")
    a, b = F.col("a"), F.col("b")
    return f.agg(F.count(F.lit(1)).alias("n"), F.count_if(a & ~b).alias("correct"), F.count_if(a & b).alias("both"), F.count_if(~a & ~b).alias("neither"), F.count_if(~a & b).alias("reversed"))


