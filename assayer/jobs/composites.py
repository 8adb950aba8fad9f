"""Composite reports and the remaining scalar operators over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import stats
from assayer.functions import text as X
from assayer.jobs.base import Tables, query
from assayer.operators import setsim as S
from assayer.operators import tests as T


def _r(c, n=6):
    return F.round(c, n)


@query("""
SELECT conv_id, md5('System: answer in one word.' || chr(10) || string_agg(format('[{}] {}: {}', turn, upper(role), text), chr(10) ORDER BY turn)) AS prompt, count(*) AS turns FROM conversations GROUP BY conv_id""")
def render_prompt(spark, sf_dir):
    """Templated prompts, one for each conversation of a few turns."""
    line = F.format_string("[%d] %s: %s", "turn", F.upper("role"), "text")
    g = Tables(spark, sf_dir).conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"), F.count(F.lit(1)).alias("turns"))
    return g.select("conv_id", F.md5(F.concat(F.lit("System: answer in one word.\n"), F.array_join("l.line", "\n"))).alias("prompt"), "turns")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, line, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM l WHERE contains(line, 'the'))
SELECT doc_id, md5(string_agg(CASE WHEN before IS NOT NULL AND i - before > 1 THEN '...' || chr(10) || line ELSE line END, chr(10) ORDER BY i)) AS digest, count(*) AS n FROM k GROUP BY doc_id""")
def slice_render(spark, sf_dir):
    """Kept lines of each text with three dots for the gaps, folded along the text's own lines."""
    rows = F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("i"), line.alias("line")))
    kept = F.filter(rows, lambda r: F.contains(r["line"], F.lit("the")))
    start = F.struct(F.lit(None).cast("int").alias("before"), F.array().cast("array<string>").alias("out"))

    def step(acc, r):
        gap = acc["before"].isNotNull() & (r["i"] - acc["before"] > 1)
        line = F.when(gap, F.concat(F.lit("...\n"), r["line"])).otherwise(r["line"])
        return F.struct(r["i"].alias("before"), F.concat(acc["out"], F.array(line)).alias("out"))

    out = F.aggregate(kept, start, step)
    folded = Tables(spark, sf_dir).documents.select("doc_id", out["out"].alias("out")).where(F.size("out") > 0)
    return folded.select("doc_id", F.md5(F.array_join("out", "\n")).alias("digest"), F.size("out").cast("bigint").alias("n"))


@query("""
WITH m AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL), i AS (SELECT conv_id, n, max(role) AS role FROM m GROUP BY ALL)
SELECT conv_id, string_agg(n || ':' || role, ',' ORDER BY n) AS inverted, count(*) AS keys FROM i GROUP BY conv_id""")
def map_invert(spark, sf_dir):
    """A map of counts by role, inverted; of equal counts the last role in order wins."""
    m = Tables(spark, sf_dir).conversations.groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n"))
    i = m.groupBy("conv_id", "n").agg(F.max("role").alias("role"))
    g = i.groupBy("conv_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("n", "role")))).alias("m"))
    pairs = F.transform(F.map_entries("m"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"]))
    return g.select("conv_id", F.array_join(pairs, ",").alias("inverted"), F.size("m").cast("bigint").alias("keys"))


@query("""
WITH e AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id % 2 = 0) GROUP BY ALL),
f AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id % 2 = 1) GROUP BY ALL),
s AS (SELECT e.label AS a, f.label AS b, round(sum(e.m * f.m) / sqrt(sum(e.m * e.m) * sum(f.m * f.m)), 9) AS sim FROM e JOIN f USING (i) GROUP BY ALL)
SELECT a, first(b ORDER BY sim DESC, (a = b)::INT DESC, b) AS mapped, round(max(sim), 6) AS similarity FROM s GROUP BY a""")
def variable_mapping(spark, sf_dir):
    """Maps each entry to the most similar one of the other half, the same name among equals."""
    rows = Tables(spark, sf_dir).embeddings.select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))
    mean = lambda odd: rows.where(F.col("vec_id") % 2 == odd).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    a, b = mean(0).select(F.col("label").alias("a"), "i", F.col("m").alias("x")), mean(1).select(F.col("label").alias("b"), "i", F.col("m").alias("y"))
    dot = F.sum(F.col("x") * F.col("y")) / F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y")))
    s = a.join(b, "i").groupBy("a", "b").agg(F.round(dot, 9).alias("sim"))
    best = F.max(F.struct("sim", (F.col("a") == F.col("b")).cast("int").alias("same"), (-F.col("b")).alias("minus"))).alias("m")
    return s.groupBy("a").agg(best).select("a", (-F.col("m.minus")).alias("mapped"), _r(F.col("m.sim")).alias("similarity"))


@query("""
WITH v AS (SELECT quality = 1 AS certified, n_chars, lang FROM documents JOIN labels USING (doc_id)), r AS (SELECT *, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0::DOUBLE AS rk FROM v),
c AS (SELECT certified, lang, count(*) AS k FROM v GROUP BY ALL)
SELECT count(*) AS n, count(*) FILTER (certified) AS certified, list_sort(list(n_chars) FILTER (certified))[(count(*) FILTER (certified)) // 2 + 1] AS median_yes, list_sort(list(n_chars) FILTER (NOT certified))[(count(*) FILTER (NOT certified)) // 2 + 1] AS median_no,
 round(sum(rk) FILTER (certified) - (count(*) FILTER (certified))::DOUBLE * (count(*) FILTER (certified) + 1) / 2, 4) AS u, (SELECT first(lang ORDER BY k DESC, lang) FROM c WHERE certified) AS top_lang FROM r""")
def selection_bias(spark, sf_dir):
    """Whether the certified differ in length from the rest: medians, U and the commonest class.

    All values are ranked by counts of equal ones, so no sort holds more than the different lengths.
    """
    from assayer.operators.aggregates import upper_median

    t = Tables(spark, sf_dir)
    v = t.documents.select("doc_id", "n_chars", "lang").join(t.labels, "doc_id").select("n_chars", "lang", (F.col("quality") == 1).alias("certified"))
    m = upper_median(v, ["certified"], "n_chars")
    medians = m.agg(F.max(F.when(F.col("certified"), F.col("upper_median"))).alias("median_yes"), F.max(F.when(~F.col("certified"), F.col("upper_median"))).alias("median_no"))
    u = T.mann_whitney(v.withColumn("g", F.lit(0)), ["g"], "n_chars", F.col("certified")).select((F.col("n1") + F.col("n2")).alias("n"), F.col("n1").alias("certified"), _r(F.col("u"), 4).alias("u"))
    top = v.where("certified").groupBy("lang").agg(F.count(F.lit(1)).alias("k")).agg(F.min(F.struct((-F.col("k")).alias("k"), "lang"))["lang"].alias("top_lang"))
    return u.crossJoin(medians).crossJoin(top).select("n", "certified", "median_yes", "median_no", "u", "top_lang")


@query("""
WITH r AS (SELECT event_type AS arm, user_id, max(value) > 150 AS ok FROM events GROUP BY ALL), p AS (SELECT a.arm AS a, b.arm AS b, count(*) FILTER (a.ok AND NOT b.ok) AS better, count(*) FILTER (NOT a.ok AND b.ok) AS worse, count(*) AS n
 FROM r a JOIN r b ON a.user_id = b.user_id AND a.arm < b.arm GROUP BY ALL)
SELECT a, b, n, better, worse, CASE WHEN better + worse < 6 THEN 'underpowered' WHEN better > 2 * worse THEN 'a wins' WHEN worse > 2 * better THEN 'b wins' ELSE 'no difference' END AS gate FROM p""")
def cross_model(spark, sf_dir):
    """All pairs of arms compared on the same units, and a gate; arms are a small dimension."""
    runs = Tables(spark, sf_dir).events.groupBy(F.col("event_type").alias("arm"), "user_id").agg((F.max("value") > 150).alias("ok"))
    a, b = runs.select(F.col("arm").alias("a"), "user_id", F.col("ok").alias("x")), runs.select(F.col("arm").alias("b"), "user_id", F.col("ok").alias("y"))
    x, y = F.col("x"), F.col("y")
    p = a.join(b, "user_id").where("a < b").groupBy("a", "b").agg(F.count_if(x & ~y).alias("better"), F.count_if(~x & y).alias("worse"), F.count(F.lit(1)).alias("n"))
    gate = F.when(F.col("better") + F.col("worse") < 6, "underpowered").when(F.col("better") > 2 * F.col("worse"), "a wins").when(F.col("worse") > 2 * F.col("better"), "b wins").otherwise("no difference")
    return p.select("a", "b", "n", "better", "worse", gate.alias("gate"))


@query("""
WITH j AS (SELECT conv_id, o.k AS flip, CASE WHEN o.k = 0 THEN length(max(text) FILTER (role = 'user')) ELSE length(max(text) FILTER (role = 'assistant')) END AS first_len, CASE WHEN o.k = 0 THEN length(max(text) FILTER (role = 'assistant')) ELSE length(max(text) FILTER (role = 'user')) END AS second_len
 FROM conversations, (VALUES (0), (1)) o(k) GROUP BY conv_id, o.k),
d AS (SELECT conv_id, bool_and((second_len > first_len) = (flip = 0)) AS both_right, bool_or(second_len > first_len) AND bool_or(second_len <= first_len) AS consistent FROM j WHERE first_len IS NOT NULL AND second_len IS NOT NULL GROUP BY conv_id),
c AS (SELECT count(*) AS n, count(*) FILTER (both_right) AS k, count(*) FILTER (consistent) AS steady FROM d), p AS (SELECT *, k::DOUBLE / n AS p FROM c)
SELECT n, k, steady, round((p + 1.9208 / n - 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 6) AS lo FROM p""")
def contrastive_orders(spark, sf_dir):
    """Each pair judged in both orders; right only if right in both."""
    g = Tables(spark, sf_dir).conversations.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "user", F.col("text"))).alias("u"), F.max(F.when(F.col("role") == "assistant", F.col("text"))).alias("a"))
    jobs = g.where("u is not null and a is not null").select("conv_id", F.length("u").alias("lu"), F.length("a").alias("la"), F.explode(F.array(F.lit(0), F.lit(1))).alias("flip"))
    later = F.when(F.col("flip") == 0, F.col("la") > F.col("lu")).otherwise(F.col("lu") > F.col("la"))
    d = jobs.groupBy("conv_id").agg(F.bool_and(later == (F.col("flip") == 0)).alias("right"), (F.bool_or(later) & F.bool_or(~later)).alias("steady"))
    c = d.agg(F.count(F.lit(1)).alias("n"), F.count_if("right").alias("k"), F.count_if("steady").alias("steady"))
    lo, _ = stats.wilson(F.col("k"), F.col("n"))
    return c.select("n", "k", "steady", _r(lo).alias("lo"))


@query("""
WITH k AS (SELECT DISTINCT t FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark)),
s AS (SELECT doc_id, avg((k.t IS NOT NULL)::INT) AS s FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS t FROM documents) d LEFT JOIN k USING (t) GROUP BY doc_id),
v AS (SELECT round(s, 9) AS s, quality = 1 AS one FROM s JOIN labels USING (doc_id)), r AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS rk FROM v)
SELECT count(*) AS n, round((sum(rk) FILTER (one) - (count(*) FILTER (one))::DOUBLE * (count(*) FILTER (one) + 1) / 2) / ((count(*) FILTER (one))::DOUBLE * (count(*) FILTER (NOT one))), 6) AS auc FROM r""")
def membership_auc(spark, sf_dir):
    """How well the share of known words tells one class from the other."""
    t = Tables(spark, sf_dir)
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))).alias("t")
    known = t.benchmark.select(words).distinct().withColumn("hit", F.lit(1))
    s = t.documents.select("doc_id", words).join(known, "t", "left").groupBy("doc_id").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 9).alias("s"))
    m = T.mann_whitney(s.join(t.labels, "doc_id").withColumn("g", F.lit(0)), ["g"], "s", F.col("quality") == 1)
    return m.select((F.col("n1") + F.col("n2")).alias("n"), _r(F.col("auc")).alias("auc"))


@query("""
WITH x AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(array_to_string(list_filter(string_split(text, '.'), lambda l: contains(l, 'th')), ' '), '[A-Za-z_][A-Za-z0-9_]*')) AS s FROM conversations),
p AS (SELECT conv_id, turn, s, lag(s) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM x)
SELECT conv_id, turn, round(len(list_intersect(s, q)) / sqrt(len(s)::DOUBLE * len(q)), 6) AS cosine, len(list_intersect(s, q)) / sqrt(len(s)::DOUBLE * len(q)) >= 0.6 AS matched FROM p WHERE len(s) > 0 AND len(q) > 0""")
def slice_cosine(spark, sf_dir):
    """Cosine of the identifier sets of two slices, and the matcher's threshold."""
    from pyspark.sql import Window

    kept = F.array_join(F.filter(F.split("text", r"\."), lambda s: F.contains(s, F.lit("th"))), " ")
    x = Tables(spark, sf_dir).conversations.select("conv_id", "turn", X.identifiers(kept).alias("s"))
    p = x.withColumn("q", F.lag("s").over(Window.partitionBy("conv_id").orderBy("turn"))).where("size(s) > 0 and size(q) > 0")
    cosine = F.size(F.array_intersect("s", "q")) / F.sqrt(F.size("s").cast("double") * F.size("q"))
    return p.select("conv_id", "turn", _r(cosine).alias("cosine"), (cosine >= 0.6).alias("matched"))


@query("""
SELECT count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 0) AS agree, round(count(*) FILTER (quality = 0 AND toxic = 1)::DOUBLE / count(*) FILTER (quality = 0), 6) AS looseness, round(avg(quality)::DOUBLE * 1.0, 6) AS rate FROM labels""")
def text_counts(spark, sf_dir):
    """Counts that a report quotes, from one pass."""
    q, t = F.col("quality"), F.col("toxic")
    return Tables(spark, sf_dir).labels.agg(
        F.count(F.lit(1)).alias("n"), F.count_if((q == 1) & (t == 0)).alias("agree"), _r(F.count_if((q == 0) & (t == 1)) / F.count_if(q == 0)).alias("looseness"), _r(F.avg(q)).alias("rate"))


@query("""
WITH u AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS s FROM documents), d AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS s FROM benchmark),
c AS (SELECT doc_id, max(len(list_intersect(u.s, d.s))::DOUBLE / len(d.s)) AS cover FROM u, d WHERE len(d.s) > 0 GROUP BY doc_id)
SELECT CAST(least(floor(cover * 10), 9) AS BIGINT) AS bin, count(*) AS n FROM c WHERE cover > 0 GROUP BY bin""")
def coverage_histogram(spark, sf_dir):
    """How much of the best-covered item each document has, in tenths."""
    t = Tables(spark, sf_dir)
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))
    met = S.overlaps(S.features(t.documents, "doc_id", words), S.features(t.benchmark, "item_id", words), "doc_id", "item_id")
    cover = met.groupBy("doc_id").agg(F.max(F.col("common") / F.col("k_size")).alias("cover"))
    return cover.groupBy(F.least(F.floor(F.col("cover") * 10), F.lit(9)).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
