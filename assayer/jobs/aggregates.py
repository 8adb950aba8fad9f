"""Aggregates and windows over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from assayer.functions import stats
from assayer.jobs.base import Tables, query
from assayer.operators import aggregates as A
from assayer.operators import windows as W


def _r(c, n=6):
    return F.round(c, n)


_WILSON = """(p + 1.9208 / n - 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)"""
_WILSON_HI = _WILSON.replace("- 1.96 *", "+ 1.96 *")


def _predictions(t):
    """documents with a label, and the prediction that a text longer than the median is good."""
    median = t.documents.agg(F.percentile("n_chars", 0.5).alias("m"))
    rows = t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels, "doc_id").crossJoin(F.broadcast(median))
    return rows.select("doc_id", "lang", "source", "n_chars", "quality", "toxic", (F.col("n_chars") > F.col("m")).alias("predicted"), (F.col("quality") == 1).alias("truth"))


_PRED = """p AS (SELECT doc_id, lang, source, n_chars, quality, toxic, n_chars > (SELECT median(n_chars) FROM documents) AS predicted, quality = 1 AS truth FROM documents JOIN labels USING (doc_id))"""


@query(f"""
WITH {_PRED}, g AS (SELECT lang, count(*) AS n, count(*) FILTER (predicted = truth) AS k FROM p GROUP BY GROUPING SETS ((lang), ())),
d AS (SELECT coalesce(lang, 'all') AS stratum, n, k, k::DOUBLE / n AS p FROM g)
SELECT stratum, n, k, round(p, 6) AS p, round({_WILSON}, 6) AS lo, round({_WILSON_HI}, 6) AS hi FROM d
""")
def pairwise_strata(spark, sf_dir):
    """Accuracy by stratum and overall, with Wilson intervals; one pass by grouping sets."""
    rows = _predictions(Tables(spark, sf_dir))
    g = rows.rollup("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("predicted") == F.col("truth")).alias("k"))
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    return g.select(F.coalesce("lang", F.lit("all")).alias("stratum"), "n", "k", _r(F.col("k") / F.col("n")).alias("p"), _r(lo).alias("lo"), _r(hi).alias("hi"))


@query("""
WITH c AS (SELECT lang, source, count(*) AS k, min(doc_id) AS f FROM documents GROUP BY ALL),
m AS (SELECT lang, first(source ORDER BY k DESC, f) AS top_source FROM c GROUP BY lang)
SELECT lang, count(*) AS n, count(DISTINCT source) AS sources, top_source, min(n_chars) AS least, max(n_chars) AS most,
  quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3 FROM documents JOIN m USING (lang) GROUP BY lang, top_source
""")
def dataset_t1(spark, sf_dir):
    """Composition by language: counts, distinct and most common source, extremes and quartiles."""
    docs = Tables(spark, sf_dir).documents
    top = A.mode(docs, ["lang"], "source", "doc_id").select("lang", F.col("source").alias("top_source"))
    q = F.percentile("n_chars", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    facts = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), q.alias("q"))
    return facts.join(top, "lang").select("lang", "n", "sources", "top_source", "least", "most", F.col("q")[1].alias("median"), F.col("q")[0].alias("q1"), F.col("q")[2].alias("q3"))


@query(f"""
WITH {_PRED}, s AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY source) >= 20 THEN source ELSE 'Other' END AS src FROM p),
g AS (SELECT lang, src, count(*) AS n, count(*) FILTER (predicted = truth) AS k FROM s GROUP BY GROUPING SETS ((lang), (src)))
SELECT CASE WHEN lang IS NULL THEN 'source' ELSE 'lang' END AS dimension, coalesce(lang, src) AS stratum, n, k, round(k::DOUBLE / n, 6) AS p FROM g
""")
def strata_t2(spark, sf_dir):
    """Two dimensions stacked by grouping sets, rare sources folded."""
    rows = A.fold_rare(_predictions(Tables(spark, sf_dir)), "source", 20)
    g = rows.groupingSets([["lang"], ["source"]], "lang", "source").agg(F.grouping("lang").alias("g"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("predicted") == F.col("truth")).alias("k"))
    return g.select(F.when(F.col("g") == 1, "source").otherwise("lang").alias("dimension"), F.coalesce("lang", "source").alias("stratum"), "n", "k", _r(F.col("k") / F.col("n")).alias("p"))


@query("""
SELECT event_type, count(*) AS users, round(avg(m), 6) AS mean_of_means, round(stddev_samp(m) / sqrt(count(*)), 6) AS sem, round(stddev_pop(m), 6) AS sd
FROM (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY ALL) GROUP BY event_type
""")
def two_level_mean(spark, sf_dir):
    inner = Tables(spark, sf_dir).events.groupBy("event_type", "user_id").agg(F.avg("value").alias("m"))
    return inner.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("users"), _r(F.avg("m")).alias("mean_of_means"),
        _r(F.stddev_samp("m") / F.sqrt(F.count(F.lit(1)))).alias("sem"), _r(F.stddev_pop("m")).alias("sd"))


@query("SELECT lang, list_sort(list(n_chars))[count(*) // 2 + 1] AS upper_median FROM documents GROUP BY lang")
def upper_median(spark, sf_dir):
    return A.upper_median(Tables(spark, sf_dir).documents, ["lang"], "n_chars")


_SCORES = """
c AS (SELECT lang, count(*) FILTER (truth AND predicted) AS tp, count(*) FILTER (NOT truth AND predicted) AS fp, count(*) FILTER (NOT truth AND NOT predicted) AS tn,
  count(*) FILTER (truth AND NOT predicted) AS fn FROM p GROUP BY lang),
s AS (SELECT *, tp + fp + tn + fn AS n, (tp + tn)::DOUBLE / (tp + fp + tn + fn) AS acc, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS pr, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS re,
  coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0) AS re0, coalesce(2.0::DOUBLE * tn / nullif(2 * tn + fn + fp, 0), 0) AS f10,
  tp + fn = 0 OR tn + fp = 0 AS one FROM c)"""


@query(f"WITH {_PRED}, {_SCORES} SELECT lang, tp, fp, tn, fn, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1 FROM s")
def confusion_prf(spark, sf_dir):
    s = A.scores(A.confusion(_predictions(Tables(spark, sf_dir)), ["lang"], F.col("truth"), F.col("predicted")))
    return s.select("lang", "tp", "fp", "tn", "fn", *(_r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")))


@query(f"""
WITH {_PRED}, {_SCORES} SELECT lang, n, round(acc, 6) AS accuracy, round(CASE WHEN one THEN acc ELSE (f1 + f10) / 2 END, 6) AS macro_f1,
round(CASE WHEN one THEN acc ELSE (re + re0) / 2 END, 6) AS macro_recall FROM s""")
def macro_f1(spark, sf_dir):
    s = A.scores(A.confusion(_predictions(Tables(spark, sf_dir)), ["lang"], F.col("truth"), F.col("predicted")))
    return s.select("lang", "n", *(_r(F.col(c)).alias(c) for c in ("accuracy", "macro_f1", "macro_recall")))


@query(f"""
WITH {_PRED}, {_SCORES}, e AS (SELECT *, ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp))::DOUBLE / (n * n) AS pe,
  sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) AS den FROM s)
SELECT lang, round(coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(den, 0), 0), 6) AS mcc, round(coalesce((acc - pe) / nullif(1 - pe, 0), 1), 6) AS kappa FROM e""")
def mcc_kappa(spark, sf_dir):
    s = A.scores(A.confusion(_predictions(Tables(spark, sf_dir)), ["lang"], F.col("truth"), F.col("predicted")))
    return s.select("lang", *(_r(F.col(c)).alias(c) for c in ("mcc", "kappa")))


@query("""
WITH r AS (SELECT lang AS a, CASE WHEN contains(text, 'the') THEN 'en' WHEN contains(text, 'der') THEN 'de' WHEN contains(text, 'les') THEN 'fr' ELSE 'es' END AS b FROM documents),
n AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (a = b)::DOUBLE AS same FROM r),
x AS (SELECT sum(ra * rb)::DOUBLE AS x FROM (SELECT a AS l, count(*) AS ra FROM r GROUP BY 1) JOIN (SELECT b AS l, count(*) AS rb FROM r GROUP BY 1) USING (l))
SELECT n::BIGINT AS n, round(same / n, 6) AS agreement, round((same / n - x / (n * n)) / (1 - x / (n * n)), 6) AS kappa FROM n, x""")
def kappa_classes(spark, sf_dir):
    """Agreement of two raters over four classes."""
    guess = F.when(F.contains("text", F.lit("the")), "en").when(F.contains("text", F.lit("der")), "de").when(F.contains("text", F.lit("les")), "fr").otherwise("es")
    k = A.kappa_many(Tables(spark, sf_dir).documents.select("lang", guess.alias("guess")), "lang", "guess")
    return k.select("n", _r(F.col("agreement")).alias("agreement"), _r(F.col("kappa")).alias("kappa"))


@query(f"""
WITH {_PRED}, {_SCORES} SELECT lang, round((tp + 0.5::DOUBLE) * (tn + 0.5::DOUBLE) / ((fp + 0.5::DOUBLE) * (fn + 0.5::DOUBLE)), 6) AS odds FROM s""")
def odds_ratio(spark, sf_dir):
    c = A.confusion(_predictions(Tables(spark, sf_dir)), ["lang"], F.col("truth"), F.col("predicted"))
    return c.select("lang", _r(stats.odds_ratio(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))).alias("odds"))


@query("""
SELECT coalesce(p_type, 'all') AS p_type, count(*) AS total, count(*) FILTER (p_size <= 25) AS accepted, round(count(*) FILTER (p_size <= 25)::DOUBLE / count(*), 6) AS yield FROM part GROUP BY ROLLUP (p_type)""")
def yield_rollup(spark, sf_dir):
    g = Tables(spark, sf_dir).part.rollup("p_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("p_size") <= 25).alias("accepted"))
    return g.select(F.coalesce("p_type", F.lit("all")).alias("p_type"), "total", "accepted", _r(F.col("accepted") / F.col("total")).alias("yield"))


@query("""
WITH r AS (SELECT event_type, value / (value + 50) AS p, (value > 40)::INT AS y FROM events),
b AS (SELECT event_type, greatest(ceil(p * 10), 1) AS bin, count(*) AS n, sum(p) AS p, sum(y) AS h, sum((p - y) * (p - y)) AS sq FROM r GROUP BY ALL)
SELECT event_type, sum(n)::BIGINT AS n, round(sum(abs(h - p)) / sum(n), 6) AS ece, round(sum(sq) / sum(n), 6) AS brier FROM b GROUP BY event_type""")
def ece_brier(spark, sf_dir):
    p = F.col("value") / (F.col("value") + 50)
    c = A.calibration(Tables(spark, sf_dir).events, ["event_type"], p, F.col("value") > 40)
    return c.select("event_type", "n", _r(F.col("ece")).alias("ece"), _r(F.col("brier")).alias("brier"))


@query("SELECT CAST(least(floor(value / 10), 19) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY bin")
def hist_bins(spark, sf_dir):
    return Tables(spark, sf_dir).events.groupBy(F.least(F.floor(F.col("value") / 10), F.lit(19)).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH q AS (SELECT quantile_cont(n_chars, [0, 1.0/3, 2.0/3, 1]) AS e FROM documents), t AS (SELECT k, e[k] AS lo, e[k + 1] AS hi FROM q, range(1, 4) r(k))
SELECT k::BIGINT AS tertile, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most FROM t JOIN documents ON n_chars BETWEEN lo AND hi GROUP BY k""")
def tertile_overlap(spark, sf_dir):
    """Tertiles with inclusive edges on both sides: rows on an edge count twice."""
    docs = Tables(spark, sf_dir).documents.select("n_chars")
    q = docs.agg(F.percentile("n_chars", F.array(F.lit(0.0), F.lit(1.0 / 3), F.lit(2.0 / 3), F.lit(1.0))).alias("e"))
    edges = q.select(F.posexplode(F.slice("e", 1, 3)).alias("k", "lo"), "e").select((F.col("k") + 1).cast("bigint").alias("tertile"), "lo", F.col("e")[F.col("k") + 1].alias("hi"))
    counts = docs.groupBy("n_chars").agg(F.count(F.lit(1)).alias("c"))  # equal values are counted before the range join
    return counts.join(F.broadcast(edges), F.col("n_chars").between(F.col("lo"), F.col("hi"))).groupBy("tertile").agg(F.sum("c").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@query("""
WITH r AS (SELECT conv_id, min(turn) FILTER (role = 'assistant' AND length(text) > 200) + 1 AS rank FROM conversations GROUP BY conv_id)
SELECT k::BIGINT AS k, round(avg((coalesce(rank, 99) <= k)::INT), 6) AS hit_rate FROM r, range(1, 11) t(k) GROUP BY k""")
def hit_at_k(spark, sf_dir):
    """Share of units whose first hit is within the first k, for k to 10, from counts by rank."""
    rows = Tables(spark, sf_dir).conversations
    first = F.min(F.when((F.col("role") == "assistant") & (F.length("text") > 200), F.col("turn"))) + 1
    by_rank = rows.groupBy("conv_id").agg(first.alias("rank")).groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    met = by_rank.crossJoin(F.broadcast(spark.range(1, 11).withColumnRenamed("id", "k")))
    share = F.sum(F.when(F.col("rank") <= F.col("k"), F.col("n")).otherwise(0)) / F.sum("n")
    return met.groupBy("k").agg(_r(share).alias("hit_rate"))


@query("""
SELECT event_type, count(*) AS n, count(*) FILTER (value > 100) AS n_high, round(avg((value > 100)::INT), 6) AS share, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most,
  count(DISTINCT user_id) AS users FROM events GROUP BY event_type""")
def basic_aggregates(spark, sf_dir):
    high = F.col("value") > 100
    return Tables(spark, sf_dir).events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(high).alias("n_high"), _r(F.avg(high.cast("int"))).alias("share"), _r(F.sum("value"), 4).alias("total"),
        F.min("value").alias("least"), F.max("value").alias("most"), F.count_distinct("user_id").alias("users"))


@query("""
SELECT lang, count(*) FILTER (quality = 0 AND toxic = 0) AS q0_t0, count(*) FILTER (quality = 0 AND toxic = 1) AS q0_t1, count(*) FILTER (quality = 1 AND toxic = 0) AS q1_t0,
  count(*) FILTER (quality = 1 AND toxic = 1) AS q1_t1 FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def contingency(spark, sf_dir):
    t = Tables(spark, sf_dir)
    cell = F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("_t"), F.col("toxic").cast("string"))
    rows = t.documents.select("doc_id", "lang").join(t.labels, "doc_id").select("lang", cell.alias("cell"))
    return rows.groupBy("lang").pivot("cell", ["q0_t0", "q0_t1", "q1_t0", "q1_t1"]).count().na.fill(0)


@query("""
SELECT user_id, arg_max(event_id, value) AS best_event, max(value) AS best FROM (SELECT * FROM events ORDER BY event_id) GROUP BY user_id
""".replace("arg_max(event_id, value)", "first(event_id ORDER BY value DESC, event_id)"))
def max_by_first(spark, sf_dir):
    """The row with the largest value of each key, the first among equals."""
    best = F.max(F.struct("value", (-F.col("event_id")).alias("e")))
    return Tables(spark, sf_dir).events.groupBy("user_id").agg(best.alias("b")).select("user_id", (-F.col("b.e")).alias("best_event"), F.col("b.value").alias("best"))


@query("""
WITH s AS (SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS k FROM documents JOIN labels USING (doc_id) GROUP BY source),
t AS (SELECT source, count(*) AS pool FROM documents GROUP BY source), w AS (SELECT sum(pool)::DOUBLE AS a FROM t)
SELECT round(sum(pool / a * k / n), 6) AS adjusted_rate FROM s JOIN t USING (source), w""")
def adjusted_rate(spark, sf_dir):
    """Each pool's share of all rows times its labelled rate."""
    t = Tables(spark, sf_dir)
    rates = t.documents.select("doc_id", "source").join(t.labels, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("k"))
    pools = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("pool"))
    both = rates.join(pools, "source").crossJoin(F.broadcast(pools.agg(F.sum("pool").alias("a"))))
    return both.agg(_r(F.sum(F.col("pool") / F.col("a") * F.col("k") / F.col("n"))).alias("adjusted_rate"))


@query("""
WITH u AS (SELECT l_orderkey AS unit, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS o, least(3, count(*)) AS k FROM lineitem GROUP BY 1)
SELECT round(avg(1 - CASE WHEN n - o < k THEN 0 ELSE list_product([(n - o - i)::DOUBLE / (n - i) for i in range(0, k)]) END), 6) AS chance FROM u""")
def chance_rate(spark, sf_dir):
    """Mean chance that k random lines of n touch one of o: 1 - C(n - o, k) / C(n, k), as a product."""
    u = Tables(spark, sf_dir).lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("o"))
    shape = u.groupBy("n", "o").agg(F.count(F.lit(1)).alias("units")).withColumn("k", F.least(F.lit(3), F.col("n")))
    miss = F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1), F.lit(1.0), lambda acc, i: acc * F.greatest(F.col("n") - F.col("o") - i, F.lit(0)) / (F.col("n") - i))
    return shape.agg(_r(F.sum(F.col("units") * (1 - miss)) / F.sum("units")).alias("chance"))


@query("""
SELECT doc_id, round(list_avg(list_sort(v)[1:greatest(1, floor(0.2 * len(v))::INT)]), 6) AS min_k FROM (SELECT vec_id AS doc_id, [x::DOUBLE for x in embedding] AS v FROM embeddings)
""".replace("doc_id", "vec_id", 1).replace("vec_id AS doc_id", "vec_id"))
def min_k_mean(spark, sf_dir):
    """Mean of the smallest fifth of each sequence of scores."""
    v = F.array_sort(F.transform("embedding", lambda x: x.cast("double")))
    low = F.slice(v, F.lit(1), F.greatest(F.lit(1), F.floor(F.size("embedding") * 0.2).cast("int")))
    mean = F.aggregate(low, F.lit(0.0), lambda a, x: a + x) / F.size(low)
    return Tables(spark, sf_dir).embeddings.select("vec_id", _r(mean).alias("min_k"))


# Windows.

_PVALS = "v AS (SELECT c_nationkey AS family, c_custkey AS test, least(abs(c_acctbal) / 10000, 1.0::DOUBLE) AS p FROM customer)"


def _pvalues(t):
    return t.customer.select(F.col("c_nationkey").alias("family"), F.col("c_custkey").alias("test"), F.least(F.abs("c_acctbal") / 10000, F.lit(1.0)).alias("p"))


@query(f"""
WITH {_PVALS}, r AS (SELECT *, least(1.0::DOUBLE, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, test) + 1) * p) AS s FROM v)
SELECT family, test, round(p, 8) AS p, round(max(s) OVER (PARTITION BY family ORDER BY p, test ROWS UNBOUNDED PRECEDING), 8) AS p_holm FROM r""")
def holm(spark, sf_dir):
    h = W.holm(_pvalues(Tables(spark, sf_dir)), ["family"], "p", ["test"])
    return h.select("family", "test", _r(F.col("p"), 8).alias("p"), _r(F.col("p_holm"), 8).alias("p_holm"))


@query(f"WITH {_PVALS} SELECT family, first(test ORDER BY p, test) AS test, round(min(p), 8) AS p, count(*) AS m FROM v GROUP BY family")
def min_test_per_family(spark, sf_dir):
    best = _pvalues(Tables(spark, sf_dir)).groupBy("family").agg(F.min(F.struct("p", "test")).alias("b"), F.count(F.lit(1)).alias("m"))
    return best.select("family", F.col("b.test").alias("test"), _r(F.col("b.p"), 8).alias("p"), "m")


@query("""
SELECT l_suppkey, l_quantity, count(*) AS n, min(r) AS rank FROM (
SELECT l_suppkey, l_quantity, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0::DOUBLE AS r FROM lineitem) GROUP BY ALL""")
def midrank(spark, sf_dir):
    """Average ranks, one row for each different value."""
    return W.mid_ranks_by_count(Tables(spark, sf_dir).lineitem, ["l_suppkey"], "l_quantity").select("l_suppkey", "l_quantity", "n", F.col("rank").cast("double").alias("rank"))


@query("""
SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rank, count(*) OVER (PARTITION BY p_brand, p_size) - 1 AS ties FROM part""")
def rank_ties(spark, sf_dir):
    by = Window.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey")
    ties = F.count(F.lit(1)).over(Window.partitionBy("p_brand", "p_size")) - 1
    return Tables(spark, sf_dir).part.select("p_brand", "p_partkey", F.row_number().over(by).cast("bigint").alias("rank"), ties.alias("ties"))


@query("""
WITH l AS (SELECT doc_id, i, contains(line, 'the') AS hit FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
h AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER w <= 2 THEN 0 ELSE 1 END AS new FROM l WHERE hit WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS hunk FROM h)
SELECT doc_id, hunk::BIGINT AS hunk, min(i)::BIGINT AS first_line, max(i)::BIGINT AS last_line, count(*) AS n FROM g GROUP BY ALL""")
def hunks(spark, sf_dir):
    """Contiguous runs of matching lines, with gaps of at most one line between."""
    rows = Tables(spark, sf_dir).documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    hit = rows.where(F.contains("line", F.lit("the"))).select("doc_id", (F.col("i") + 1).cast("bigint").alias("i"))
    return W.islands(hit, ["doc_id"], "i", 2, "hunk").groupBy("doc_id", "hunk").agg(F.min("i").alias("first_line"), F.max("i").alias("last_line"), F.count(F.lit(1)).alias("n"))


@query("""
WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, '[(){}]')) AS c, generate_subscripts(regexp_extract_all(html, '[(){}]'), 1) AS i FROM pages),
s AS (SELECT page_id, i, sum(CASE WHEN c IN ('(', '{') THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS d FROM c)
SELECT page_id, count(i) AS n, coalesce(first(d ORDER BY i DESC), 0)::BIGINT AS depth, least(coalesce(min(d), 0), 0)::BIGINT AS low FROM pages LEFT JOIN s USING (page_id) GROUP BY page_id""")
def brace_depth(spark, sf_dir):
    """Depth of the brackets at the end and at its lowest, folded along each text."""
    chars = F.regexp_extract_all("html", F.lit(r"[(){}]"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low"))

    def step(acc, c):
        d = acc["depth"] + F.when(c.isin("(", "{"), 1).otherwise(-1)
        return F.struct(d.alias("depth"), F.least(acc["low"], d).alias("low"))

    folded = Tables(spark, sf_dir).pages.select("page_id", F.size(chars).cast("bigint").alias("n"), F.aggregate(chars, start, step).alias("b"))
    return folded.select("page_id", "n", F.col("b.depth").cast("bigint").alias("depth"), F.col("b.low").cast("bigint").alias("low"))


@query("SELECT conv_id, last(role ORDER BY turn) AS last_role, string_agg(role, '>' ORDER BY turn) AS history FROM conversations GROUP BY conv_id")
def last_of_history(spark, sf_dir):
    """The last element of each unit's history; a unit has few turns."""
    h = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return Tables(spark, sf_dir).conversations.groupBy("conv_id").agg(h.alias("h")).select("conv_id", F.element_at("h.role", -1).alias("last_role"), F.array_join("h.role", ">").alias("history"))
