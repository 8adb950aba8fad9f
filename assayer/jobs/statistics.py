"""Statistical tests and intervals over the tables."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F

from assayer.functions import stats
from assayer.jobs.base import Tables, query
from assayer.operators import sampling
from assayer.operators import ranks as R
from assayer.operators import tests as T
from assayer.operators.windows import holm


def _r(c, n=6):
    return F.round(c, n)


@query("""
WITH c AS (SELECT lang, count(*) AS n, count(*) FILTER (toxic = 1) AS k FROM documents JOIN labels USING (doc_id) GROUP BY lang), d AS (SELECT *, k::DOUBLE / n AS p FROM c)
SELECT lang, n, k, round(greatest((p + 1.9208 / n - 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 0), 6) AS lo,
 round(least((p + 1.9208 / n + 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 1), 6) AS hi FROM d""")
def wilson(spark, sf_dir):
    t = Tables(spark, sf_dir)
    c = t.documents.select("doc_id", "lang").join(t.labels, "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 1).alias("k"))
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    return c.select("lang", "n", "k", _r(lo).alias("lo"), _r(hi).alias("hi"))


_MCNEMAR = """
WITH u AS (SELECT user_id, max(value) FILTER (event_type = 'click') > 100 AS a, max(value) FILTER (event_type = 'view') > 100 AS b, user_id % 5 AS g FROM events GROUP BY user_id),
c AS (SELECT g, count(*) FILTER (a AND NOT b) AS b, count(*) FILTER (NOT a AND b) AS c FROM u GROUP BY g)"""


def _paired(t):
    def top(kind):
        return F.coalesce(F.max(F.when(F.col("event_type") == kind, F.col("value"))) > 100, F.lit(False))

    u = t.events.groupBy("user_id").agg(top("click").alias("a"), top("view").alias("b"))
    return u.withColumn("g", F.col("user_id") % 5)


@query(_MCNEMAR + """
SELECT g, b, c, round(CASE WHEN b = c THEN 1 ELSE least(1, 2 * list_sum([exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2)) for k in range(0, least(b, c) + 1)])) END, 8) AS p FROM c""")
def mcnemar_exact(spark, sf_dir):
    m = T.mcnemar(_paired(Tables(spark, sf_dir)), ["g"], F.col("a"), F.col("b"))
    return m.select("g", "b", "c", _r(F.col("p"), 8).alias("p"))


@query(_MCNEMAR + """
SELECT g, b, c, round(CASE WHEN b + c = 0 THEN 0 ELSE greatest(abs(b - c) - 1, 0)::DOUBLE ** 2 / (b + c) END, 6) AS chi2, b + c < 25 AS exact, round((b + 0.5::DOUBLE) / (c + 0.5::DOUBLE), 6) AS odds FROM c""")
def mcnemar_hybrid(spark, sf_dir):
    """The statistic of the continuity-corrected test, whether the exact one applies, and the odds ratio."""
    m = T.mcnemar(_paired(Tables(spark, sf_dir)), ["g"], F.col("a"), F.col("b"))
    return m.select("g", "b", "c", _r(F.col("chi2")).alias("chi2"), (F.col("b") + F.col("c") < 25).alias("exact"), _r((F.col("b") + 0.5) / (F.col("c") + 0.5)).alias("odds"))


_MWU = """
WITH v AS (SELECT lang, n_chars, quality FROM documents JOIN labels USING (doc_id)),
r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0::DOUBLE AS rk FROM v),
s AS (SELECT lang, count(*) FILTER (quality = 1) AS n1, count(*) FILTER (quality <> 1) AS n2, sum(rk) FILTER (quality = 1) AS r1 FROM r GROUP BY lang),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0::DOUBLE AS u FROM s)"""


def _lengths(t):
    return t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id")


@query(_MWU + " SELECT lang, n1, n2, round(u, 4) AS u, round(2 * u / (n1 * n2) - 1, 6) AS effect FROM u")
def mwu_u(spark, sf_dir):
    m = T.mann_whitney(_lengths(Tables(spark, sf_dir)), ["lang"], "n_chars", F.col("quality") == 1)
    return m.select("lang", "n1", "n2", _r(F.col("u"), 4).alias("u"), _r(F.col("effect")).alias("effect"))


@query(_MWU + " SELECT lang, round(u / (n1 * n2), 6) AS auc FROM u")
def auc(spark, sf_dir):
    m = T.mann_whitney(_lengths(Tables(spark, sf_dir)), ["lang"], "n_chars", F.col("quality") == 1)
    return m.select("lang", _r(F.col("auc")).alias("auc"))


@query()
def mwu_p(spark, sf_dir):
    """Two-sided p values with tie and continuity correction."""
    m = T.mann_whitney_test(_lengths(Tables(spark, sf_dir)), ["lang"], "n_chars", F.col("quality") == 1)
    return m.select("lang", "n1", "n2", "u", "p")


@query(_MWU + """, d AS (SELECT a.lang, sum(CASE WHEN a.n_chars > b.n_chars THEN 1 WHEN a.n_chars < b.n_chars THEN -1 ELSE 0 END)::DOUBLE / count(*) AS d
FROM v a JOIN v b ON a.lang = b.lang AND a.quality = 1 AND b.quality <> 1 GROUP BY a.lang) SELECT lang, round(d, 6) AS delta FROM d""")
def cliffs_delta(spark, sf_dir):
    """Cliff's delta by its rank form instead of all pairs."""
    m = T.mann_whitney(_lengths(Tables(spark, sf_dir)), ["lang"], "n_chars", F.col("quality") == 1)
    return m.where("n1 > 0 and n2 > 0").select("lang", _r(F.col("effect")).alias("delta"))


_DIFFS = """
WITH d AS (SELECT user_id % 5 AS g, user_id, round(avg(value) FILTER (event_type = 'click') - avg(value) FILTER (event_type = 'view'), 1) AS d FROM events GROUP BY user_id),
z AS (SELECT g, abs(d) AS a, d > 0 AS up FROM d WHERE d <> 0), r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY a) + (count(*) OVER (PARTITION BY g, a) - 1) / 2.0::DOUBLE AS rk FROM z),
w AS (SELECT g, count(*) AS n, sum(CASE WHEN up THEN rk ELSE 0 END) AS w_plus, sum(CASE WHEN up THEN 0 ELSE rk END) AS w_minus, count(*) FILTER (up) AS k FROM r GROUP BY g)"""


def _differences(t):
    def mean(kind):
        return F.avg(F.when(F.col("event_type") == kind, F.col("value")))

    d = t.events.groupBy("user_id").agg(F.round(mean("click") - mean("view"), 1).alias("d"))
    return d.where("d is not null").withColumn("g", F.col("user_id") % 5)


@query(_DIFFS + " SELECT g, n, w_plus, w_minus, round((w_plus - w_minus) / (w_plus + w_minus), 6) AS r, round((2 * k - n)::DOUBLE / n, 6) AS sign_r FROM w")
def wilcoxon_wplus(spark, sf_dir):
    w = T.signed_ranks(_differences(Tables(spark, sf_dir)), ["g"], "d")
    return w.select("g", "n", F.col("w_plus").cast("double").alias("w_plus"), F.col("w_minus").cast("double").alias("w_minus"), _r(F.col("r")).alias("r"), _r(F.col("sign_r")).alias("sign_r"))


@query()
def wilcoxon_exact_p(spark, sf_dir):
    """Signed-rank p values, exact up to 50 differences."""
    return T.wilcoxon(_differences(Tables(spark, sf_dir)), ["g"], "d").select("g", "n", "w_plus", "p")


@query("""
WITH c AS (SELECT lang, quality, count(*) AS o FROM documents JOIN labels USING (doc_id) GROUP BY ALL), a AS (SELECT lang, sum(o) AS ra FROM c GROUP BY 1), b AS (SELECT quality, sum(o) AS rb FROM c GROUP BY 1), n AS (SELECT sum(o)::DOUBLE AS n FROM c)
SELECT round(sum((coalesce(o, 0) - ra * rb / n) ** 2 / (ra * rb / n)), 6) AS chi2, (count(DISTINCT lang) - 1) * (count(DISTINCT quality) - 1) AS df, max(n)::BIGINT AS n FROM a CROSS JOIN b CROSS JOIN n LEFT JOIN c USING (lang, quality)""")
def chi2_stat(spark, sf_dir):
    c = T.chi_square(_lengths(Tables(spark, sf_dir)), "lang", "quality")
    return c.select(_r(F.col("chi2")).alias("chi2"), "df", "n")


@query("""
WITH c AS (SELECT lang, count(*) FILTER (quality = 1 AND toxic = 1) AS a, count(*) FILTER (quality = 1 AND toxic = 0) AS b, count(*) FILTER (quality = 0 AND toxic = 1) AS c, count(*) FILTER (quality = 0 AND toxic = 0) AS d
  FROM documents JOIN labels USING (doc_id) GROUP BY lang),
x AS (SELECT *, unnest(range(greatest(0, a + b + a + c - (a + b + c + d)), least(a + b, a + c) + 1)) AS k FROM c),
l AS (SELECT *, lgamma(a + c + 1) - lgamma(k + 1) - lgamma(a + c - k + 1) + lgamma(b + d + 1) - lgamma(a + b - k + 1) - lgamma(b + d - a - b + k + 1) - lgamma(a + b + c + d + 1) + lgamma(a + b + 1) + lgamma(c + d + 1) AS lp FROM x),
m AS (SELECT *, max(CASE WHEN k = a THEN lp END) OVER (PARTITION BY lang) AS seen FROM l)
SELECT lang, a, b, c, d, round(least(1, sum(exp(lp)) FILTER (lp <= seen + 1e-7)), 6) AS p FROM m GROUP BY ALL""")
def fisher_p(spark, sf_dir):
    """Fisher's exact test of each stratum's 2x2 table."""
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    cells = _lengths(Tables(spark, sf_dir)).groupBy("lang").agg(F.count_if(q & t).alias("a"), F.count_if(q & ~t).alias("b"), F.count_if(~q & t).alias("c"), F.count_if(~q & ~t).alias("d"))

    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([stats.fisher_exact(*map(int, x)) for x in zip(a, b, c, d)])

    return cells.select("lang", "a", "b", "c", "d", _r(p("a", "b", "c", "d")).alias("p"))


@query("""
WITH r AS (SELECT lang, avg((toxic = 1)::INT) AS p, avg((quality = 1)::INT) AS q FROM documents JOIN labels USING (doc_id) GROUP BY lang)
SELECT lang, round(2 * asin(sqrt(q)) - 2 * asin(sqrt(p)), 6) AS h FROM r""")
def cohens_h(spark, sf_dir):
    r = _lengths(Tables(spark, sf_dir)).groupBy("lang").agg(F.avg((F.col("toxic") == 1).cast("int")).alias("p"), F.avg((F.col("quality") == 1).cast("int")).alias("q"))
    return r.select("lang", _r(stats.cohens_h(F.col("q"), F.col("p"))).alias("h"))


_WEIGHT = "(" + " + ".join(f"(u >= {t})::BIGINT" for t in T.POISSON) + ")"
#: Draws over units ``u`` (g, id, v) with Poisson weights from the same counters.
_WEIGHTED = f"""
x AS (SELECT g, v, b, ('0x' || substr(md5('{{seed}}-' || b || '-' || g || '-' || id), 1, 8))::BIGINT AS u FROM u, range(0, {{draws}}) r(b)),
w AS (SELECT g, v, b, {_WEIGHT} AS w FROM x), s AS (SELECT g, b, sum(v * w) / nullif(sum(w), 0) AS mean FROM w GROUP BY ALL)"""
_MEDIANS = f"""
x AS (SELECT g, v, b, ('0x' || substr(md5('{{seed}}-' || b || '-' || g || '-' || id), 1, 8))::BIGINT AS u FROM u, range(0, {{draws}}) r(b)),
w AS (SELECT g, v, b, unnest(range(0, {_WEIGHT})) AS j FROM x), s AS (SELECT g, b, median(v) AS mean FROM w GROUP BY ALL)"""
_DRAWS = """
n AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY g) AS m FROM u),
p AS (SELECT g, b, ('0x' || substr(md5('{seed}-' || b || '-' || i), 1, 8))::BIGINT % m AS i FROM n, range(0, {draws}) r(b)),
s AS (SELECT p.g, b, avg(v) AS mean FROM p JOIN n ON p.g = n.g AND p.i = n.i GROUP BY ALL)"""


@query("WITH u AS (SELECT event_type AS g, user_id AS id, avg(value) AS v FROM events GROUP BY event_type, user_id)," + _WEIGHTED.format(seed="b1", draws=200) + """
SELECT g AS event_type, round(quantile_cont(mean, 0.025), 6) AS lo, round(quantile_cont(mean, 0.975), 6) AS hi FROM s GROUP BY g""")
def boot_ci(spark, sf_dir):
    """Percentile bootstrap of the mean over units, by a counter hash."""
    units = Tables(spark, sf_dir).events.groupBy("event_type", "user_id").agg(F.avg("value").alias("v"))
    ci = T.interval(T.weighted_draws(units, ["event_type"], ["user_id"], "v", 200, "b1"), ["event_type"])
    return ci.select("event_type", _r(F.col("lo")).alias("lo"), _r(F.col("hi")).alias("hi"))


@query("WITH u AS (SELECT user_id % 5 AS g, user_id AS id, round(avg(value) FILTER (event_type = 'click') - avg(value) FILTER (event_type = 'view'), 1) AS v FROM events GROUP BY user_id HAVING v IS NOT NULL)," + _WEIGHTED.format(seed="b2", draws=200) + """,
e AS (SELECT g, count(*) AS n, avg(v) AS estimate FROM u GROUP BY g)
SELECT e.g, n, round(estimate, 6) AS estimate, CASE WHEN n >= 10 THEN round(quantile_cont(mean, 0.025), 6) END AS lo, CASE WHEN n >= 10 THEN round(quantile_cont(mean, 0.975), 6) END AS hi FROM e JOIN s ON e.g = s.g GROUP BY e.g, n, estimate""")
def paired_boot(spark, sf_dir):
    """Paired bootstrap difference; fewer than ten pairs have no interval."""
    d = _differences(Tables(spark, sf_dir))
    ci = T.interval(T.weighted_draws(d, ["g"], ["user_id"], "d", 200, "b2"), ["g"])
    e = d.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("estimate")).join(ci, "g")
    enough = F.col("n") >= 10
    return e.select("g", "n", _r(F.col("estimate")).alias("estimate"), F.when(enough, _r(F.col("lo"))).alias("lo"), F.when(enough, _r(F.col("hi"))).alias("hi"))


@query("WITH u AS (SELECT source AS g, avg((quality = 1)::INT) AS v FROM documents JOIN labels USING (doc_id) GROUP BY source), w AS (SELECT 0 AS g, v FROM u)," + _DRAWS.format(seed="b3", draws=200).replace("FROM u)", "FROM w)", 1) + """
SELECT round(list_sort(list(mean))[5], 6) AS lo, round(list_sort(list(mean))[195], 6) AS hi FROM s""")
def cluster_boot(spark, sf_dir):
    """Cluster bootstrap over the sources' rates, with order statistics as bounds."""
    u = Tables(spark, sf_dir).documents.select("doc_id", "source").join(Tables(spark, sf_dir).labels, "doc_id").groupBy("source").agg(F.avg((F.col("quality") == 1).cast("int")).alias("v"))
    ci = T.order_interval(T.bootstrap_means(u.select(F.lit(0).alias("g"), "v"), ["g"], "v", 200, "b3"), ["g"], 4, 194)
    return ci.select(_r(F.col("lo")).alias("lo"), _r(F.col("hi")).alias("hi"))


_DID = """
WITH a AS (SELECT user_id, user_id % 3 = 0 AS unseen, avg(value) FILTER (event_type = 'click') AS pre, avg(value) FILTER (event_type = 'purchase') AS post FROM events GROUP BY user_id)"""


def _pre_post(t):
    def mean(kind):
        return F.avg(F.when(F.col("event_type") == kind, F.col("value")))

    return t.events.groupBy("user_id").agg(mean("click").alias("pre"), mean("purchase").alias("post")).withColumn("unseen", F.col("user_id") % 3 == 0)


@query(_DID + """ SELECT round(avg(post - pre) FILTER (NOT unseen) - avg(post - pre) FILTER (unseen), 6) AS did, count(*) FILTER (NOT unseen) AS n_seen, count(*) FILTER (unseen) AS n_unseen FROM a WHERE pre IS NOT NULL AND post IS NOT NULL""")
def did(spark, sf_dir):
    """Difference in differences between seen and unseen units."""
    a = _pre_post(Tables(spark, sf_dir)).where("pre is not null and post is not null").withColumn("d", F.col("post") - F.col("pre"))
    return a.agg(
        _r(F.avg(F.when(~F.col("unseen"), F.col("d"))) - F.avg(F.when(F.col("unseen"), F.col("d")))).alias("did"),
        F.count_if(~F.col("unseen")).alias("n_seen"), F.count_if(F.col("unseen")).alias("n_unseen"))


@query(_DID + """ SELECT round(avg(pre) FILTER (NOT unseen) - avg(post) FILTER (NOT unseen), 6) AS gap_seen, round(avg(pre) FILTER (unseen) - avg(post) FILTER (unseen), 6) AS gap_unseen,
round((avg(pre) FILTER (NOT unseen) - avg(post) FILTER (NOT unseen)) - (avg(pre) FILTER (unseen) - avg(post) FILTER (unseen)), 6) AS excess FROM a""")
def gap_decomp(spark, sf_dir):
    """The gap on seen units less the gap on unseen ones."""

    def gap(where):
        return F.avg(F.when(where, F.col("pre"))) - F.avg(F.when(where, F.col("post")))

    seen, unseen = gap(~F.col("unseen")), gap(F.col("unseen"))
    return _pre_post(Tables(spark, sf_dir)).agg(_r(seen).alias("gap_seen"), _r(unseen).alias("gap_unseen"), _r(seen - unseen).alias("excess"))


@query("""
WITH v AS (SELECT doc_id, n_chars, quality, ('0x' || substr(md5('4-' || source), 1, 8))::BIGINT % 5 AS fold FROM documents JOIN labels USING (doc_id)),
t AS (SELECT k, 100 * k * k AS cut FROM range(1, 16) r(k)), f AS (SELECT DISTINCT fold FROM v),
s AS (SELECT f.fold, cut, avg(((n_chars > cut) = (quality = 1))::INT) AS acc FROM f JOIN v ON v.fold <> f.fold, t GROUP BY ALL),
b AS (SELECT fold, first(cut ORDER BY round(acc, 9) DESC, cut) AS cut FROM s GROUP BY fold)
SELECT b.fold, cut, count(*) AS n, count(*) FILTER ((n_chars > cut) = (quality = 1)) AS correct FROM b JOIN v ON v.fold = b.fold GROUP BY ALL""")
def cv_threshold(spark, sf_dir):
    """A threshold tuned on four folds and scored on the fifth; rows are first reduced to counts by fold and threshold."""
    t = Tables(spark, sf_dir)
    v = t.documents.select("doc_id", "source", "n_chars").join(t.labels, "doc_id")
    v = v.withColumn("fold", sampling.counter(F.concat(F.lit("4-"), "source"), 5))
    cuts = spark.range(1, 16).select((F.col("id") * F.col("id") * 100).alias("cut"))
    hit = (F.col("n_chars") > F.col("cut")) == (F.col("quality") == 1)
    c = v.crossJoin(F.broadcast(cuts)).groupBy("fold", "cut").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("k"))
    other = c.select(F.col("fold").alias("o"), "cut", F.col("n").alias("on"), F.col("k").alias("ok"))
    tuned = c.select("fold", "cut").join(other, "cut").where("o <> fold").groupBy("fold", "cut").agg(F.round(F.sum("ok") / F.sum("on"), 9).alias("acc"))
    best = tuned.groupBy("fold").agg((-F.max(F.struct("acc", (-F.col("cut")).alias("m")))["m"]).alias("cut"))
    return best.join(c, ["fold", "cut"]).select("fold", "cut", "n", F.col("k").alias("correct"))


@query()
def temp_scale(spark, sf_dir):
    """Temperature by language that minimises the log loss of a length score, by golden section over binned counts."""
    t = Tables(spark, sf_dir)
    z = F.log(F.col("n_chars") + 1) - 7
    binned = _lengths(t).groupBy("lang", F.round(z, 1).alias("z")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("k"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        def loss(temp: float) -> float:
            return sum(-k * math.log(p) - (n - k) * math.log(1 - p) for n, k, p in ((n, k, min(max(1 / (1 + math.exp(-x / temp)), 1e-9), 1 - 1e-9)) for x, n, k in zip(pdf["z"], pdf["n"], pdf["k"])))

        low, high, g = 0.05, 20.0, (math.sqrt(5) - 1) / 2
        while high - low > 1e-4:
            a, b = high - g * (high - low), low + g * (high - low)
            low, high = (low, b) if loss(a) < loss(b) else (a, high)
        return pd.DataFrame({"lang": pdf["lang"].iloc[:1], "temperature": [round((low + high) / 2, 3)], "loss": [round(loss((low + high) / 2) / pdf["n"].sum(), 6)]})

    return binned.groupBy("lang").applyInPandas(fit, "lang string, temperature double, loss double")


@query("""
WITH c AS (SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS k FROM documents JOIN labels USING (doc_id) GROUP BY source), d AS (SELECT *, k::DOUBLE / n AS p FROM c),
w AS (SELECT *, (p + 1.9208 / n - 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n) AS lo FROM d)
SELECT source, CASE WHEN n < 10 THEN 'too few' WHEN lo > 0.75 THEN 'holds' WHEN p > 0.75 THEN 'unclear' ELSE 'fails' END AS verdict FROM w""")
def verdicts(spark, sf_dir):
    """Decision rules over estimates and their bounds."""
    t = Tables(spark, sf_dir)
    c = t.documents.select("doc_id", "source").join(t.labels, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("k"))
    lo, _ = stats.wilson(F.col("k"), F.col("n"))
    return c.select("source", F.when(F.col("n") < 10, "too few").when(lo > 0.75, "holds").when(F.col("k") / F.col("n") > 0.75, "unclear").otherwise("fails").alias("verdict"))


@query()
def report_table(spark, sf_dir):
    """All tests of two questions in one table of fixed columns, corrected within each question."""
    t = Tables(spark, sf_dir)
    w = T.wilcoxon(_differences(t), ["g"], "d").select(F.col("g").cast("string").alias("comparison"), "n", F.col("r").alias("effect_size_value"), F.col("w_plus").alias("statistic"), F.col("p").alias("p_raw"))
    m = T.mcnemar(_paired(t), ["g"], F.col("a"), F.col("b")).select(F.col("g").cast("string").alias("comparison"), (F.col("b") + F.col("c")).alias("n"), F.col("p").alias("p_raw"))
    out = T.Results().add(w, rq="RQ1", metric="value", test="wilcoxon", effect_size_name="rank_biserial").add(m, rq="RQ2", metric="high", test="mcnemar_exact")
    return out.finite()


@query("""
SELECT round(2 * 2.801585218::DOUBLE * sqrt(0.25 / count(*)), 6) AS mde, count(*) AS n FROM labels""".replace("2 * 2.801585218", "2.801585218 * sqrt(2::DOUBLE)"))
def min_detectable(spark, sf_dir):
    """Smallest difference of two rates near one half that n units each show with power 0.8 at 0.05."""
    n = Tables(spark, sf_dir).labels.agg(F.count(F.lit(1)).alias("n"))
    return n.select(_r(2.801585218 * math.sqrt(2) * F.sqrt(F.lit(0.25) / F.col("n"))).alias("mde"), "n")


_T95 = {n: round(stats.t_quantile(0.95, n - 1), 9) for n in range(2, 30)}


@query(f"""
WITH t(n, q) AS (VALUES {", ".join(f"({n}, {q}::DOUBLE)" for n, q in _T95.items())}), g AS (SELECT p_brand, p_size, count(*) AS n, avg(p_retailprice) AS m, stddev_samp(p_retailprice) AS s FROM part GROUP BY ALL)
SELECT p_brand, p_size, g.n, round(m, 6) AS mean, round(m - CASE WHEN g.n < 30 THEN q ELSE 1.959963985::DOUBLE END * s / sqrt(g.n), 6) AS lo, round(m + CASE WHEN g.n < 30 THEN q ELSE 1.959963985::DOUBLE END * s / sqrt(g.n), 6) AS hi FROM g LEFT JOIN t ON t.n = g.n""")
def t_interval(spark, sf_dir):
    """Intervals of a mean: Student's quantile under 30 rows, the normal one from there, none for a single row."""
    g = Tables(spark, sf_dir).part.groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"), F.avg("p_retailprice").alias("m"), F.stddev_samp("p_retailprice").alias("s"))
    small = F.element_at(F.array(*(F.lit(q) for q in (None, *_T95.values()))).cast("array<double>"), F.least(F.col("n"), F.lit(29)).cast("int"))
    half = F.when(F.col("n") < 30, small).otherwise(1.959963985) * F.col("s") / F.sqrt("n")
    return g.select("p_brand", "p_size", "n", _r(F.col("m")).alias("mean"), _r(F.col("m") - half).alias("lo"), _r(F.col("m") + half).alias("hi"))


@query("""
SELECT event_type, quantile_cont(value, 0.5) FILTER (user_id % 2 = 0) - quantile_cont(value, 0.5) FILTER (user_id % 2 = 1) AS d FROM events GROUP BY event_type""".replace("SELECT event_type, quantile", "SELECT event_type, round(quantile", 1).replace(" AS d FROM", ", 6) AS d FROM"))
def median_difference(spark, sf_dir):
    """Difference of the medians of two independent samples."""
    e = Tables(spark, sf_dir).events.select("event_type", (F.col("user_id") % 2 == 0).alias("even"), "value")
    q = R.quantiles(e, ["event_type", "even"], "value", {"median": 0.5})
    return q.groupBy("event_type").agg(_r(F.max(F.when(F.col("even"), F.col("median"))) - F.max(F.when(~F.col("even"), F.col("median")))).alias("d"))


@query("WITH u AS (SELECT event_type || '-' || (user_id % 2) AS g, user_id AS id, round(avg(value), 2) AS v FROM events GROUP BY event_type, user_id)," + _MEDIANS.format(seed="b5", draws=100) + """,
d AS (SELECT split_part(g, '-', 1) AS event_type, b, max(mean) FILTER (g LIKE '%-0') - max(mean) FILTER (g LIKE '%-1') AS d FROM s GROUP BY ALL),
pt AS (SELECT split_part(g, '-', 1) AS event_type, median(v) FILTER (g LIKE '%-0') - median(v) FILTER (g LIKE '%-1') AS estimate FROM u GROUP BY 1)
SELECT event_type, round(estimate, 6) AS estimate, round(quantile_cont(d, 0.025), 6) AS lo, round(quantile_cont(d, 0.975), 6) AS hi FROM d JOIN pt USING (event_type) GROUP BY event_type, estimate""")
def median_boot(spark, sf_dir):
    """Bootstrap interval of the difference of two independent samples' medians, each resampled by itself."""
    u = Tables(spark, sf_dir).events.groupBy("event_type", "user_id").agg(F.round(F.avg("value"), 2).alias("v"))
    u = u.select(F.concat("event_type", F.lit("-"), (F.col("user_id") % 2).cast("string")).alias("g"), "user_id", "v")
    kind, even, odd = F.substring_index("g", "-", 1).alias("event_type"), F.col("g").endswith("-0"), F.col("g").endswith("-1")
    draws = T.weighted_draws(u, ["g"], ["user_id"], "v", 100, "b5", T.weighted_median)
    d = draws.groupBy(kind, "draw").agg((F.max(F.when(even, F.col("mean"))) - F.max(F.when(odd, F.col("mean")))).alias("mean"))
    p = u.groupBy(kind).agg((F.percentile(F.when(even, F.col("v")), 0.5) - F.percentile(F.when(odd, F.col("v")), 0.5)).alias("estimate"))
    return p.join(T.interval(d, ["event_type"]), "event_type").select("event_type", _r(F.col("estimate")).alias("estimate"), _r(F.col("lo")).alias("lo"), _r(F.col("hi")).alias("hi"))


_DID_UNITS = """u AS (SELECT (user_id % 5) || '-' || (user_id % 3 = 0)::INT AS g, user_id AS id, round(avg(value) FILTER (event_type = 'purchase') - avg(value) FILTER (event_type = 'click'), 2) AS v FROM events GROUP BY user_id HAVING v IS NOT NULL)"""


def _did_units(t):
    """Each unit's change, by detector and whether it was unseen, as ``g``."""
    a = _pre_post(t).where("pre is not null and post is not null")
    return a.select(F.concat((F.col("user_id") % 5).cast("string"), F.lit("-"), F.col("unseen").cast("int").cast("string")).alias("g"), "user_id", F.round(F.col("post") - F.col("pre"), 2).alias("v"))


@query(f"WITH {_DID_UNITS}," + _WEIGHTED.format(seed="b6", draws=100) + """,
d AS (SELECT split_part(g, '-', 1) AS detector, b, max(mean) FILTER (g LIKE '%-0') - max(mean) FILTER (g LIKE '%-1') AS d FROM s GROUP BY ALL),
pt AS (SELECT split_part(g, '-', 1) AS detector, avg(v) FILTER (g LIKE '%-0') - avg(v) FILTER (g LIKE '%-1') AS did, count(*) AS n FROM u GROUP BY 1)
SELECT detector, n, round(did, 6) AS did, round(quantile_cont(d, 0.025), 6) AS lo, round(quantile_cont(d, 0.975), 6) AS hi, quantile_cont(d, 0.025) > 0 OR quantile_cont(d, 0.975) < 0 AS clear FROM d JOIN pt USING (detector) GROUP BY detector, n, did""")
def did_report(spark, sf_dir):
    """Difference in differences of each detector with its bootstrap interval."""
    u = _did_units(Tables(spark, sf_dir))
    name, seen, unseen = F.substring_index("g", "-", 1).alias("detector"), F.col("g").endswith("-0"), F.col("g").endswith("-1")
    d = T.weighted_draws(u, ["g"], ["user_id"], "v", 100, "b6").groupBy(name, "draw").agg((F.max(F.when(seen, F.col("mean"))) - F.max(F.when(unseen, F.col("mean")))).alias("mean"))
    p = u.groupBy(name).agg(F.count(F.lit(1)).alias("n"), (F.avg(F.when(seen, F.col("v"))) - F.avg(F.when(unseen, F.col("v")))).alias("did"))
    lo, hi = F.col("lo"), F.col("hi")
    return p.join(T.interval(d, ["detector"]), "detector").select("detector", "n", _r(F.col("did")).alias("did"), _r(lo).alias("lo"), _r(hi).alias("hi"), ((lo > 0) | (hi < 0)).alias("clear"))


@query()
def did_tests(spark, sf_dir):
    """Rank test of each detector's changes on seen against unseen units, corrected over the detectors."""
    u = _did_units(Tables(spark, sf_dir)).select(F.substring_index("g", "-", 1).alias("detector"), F.col("g").endswith("-0").alias("seen"), "v")
    m = T.mann_whitney_test(u, ["detector"], "v", F.col("seen")).withColumn("family", F.lit("did"))
    return holm(m, ["family"], "p", ["detector"], "p_holm").select("detector", "n1", "n2", "effect", "p", "p_holm")


@query(_DIFFS.replace("WHERE d <> 0)", "WHERE d IS NOT NULL)").replace("d > 0 AS up", "d > 0 AS up, d < 0 AS down").replace("CASE WHEN up THEN 0 ELSE rk END", "CASE WHEN down THEN rk ELSE 0 END")
       .replace("count(*) FILTER (up) AS k", "count(*) FILTER (up) AS k, count(*) FILTER (down) AS j")
       + " SELECT g, n, w_plus::DOUBLE AS w_plus, w_minus::DOUBLE AS w_minus, round((k - j)::DOUBLE / n, 6) AS sign_r FROM w")
def wilcoxon_zeros_kept(spark, sf_dir):
    """Signed-rank sums where zeros take part in the ranking, and the difference of the signs' shares."""
    w = T.signed_ranks(_differences(Tables(spark, sf_dir)), ["g"], "d", zeros="keep")
    return w.select("g", "n", F.col("w_plus").cast("double").alias("w_plus"), F.col("w_minus").cast("double").alias("w_minus"), _r((F.col("better") - F.col("worse")) / F.col("n")).alias("sign_r"))


@query()
def one_sided_p(spark, sf_dir):
    """One-sided p values, that the first is greater, of the signed-rank and the rank-sum test."""
    t = Tables(spark, sf_dir)
    w = T.wilcoxon(_differences(t), ["g"], "d", alternative="greater").select(F.lit("signed_rank").alias("test"), F.col("g").cast("string").alias("unit"), "p")
    m = T.mann_whitney_test(_lengths(t), ["lang"], "n_chars", F.col("quality") == 1, alternative="greater").select(F.lit("rank_sum").alias("test"), F.col("lang").alias("unit"), "p")
    return w.unionByName(m)
