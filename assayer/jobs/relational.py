"""Joins, set operations, samples and limits over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from assayer.jobs.base import Tables, query
from assayer.operators import joins, sampling, sets, windows


@query("""
SELECT a.o_custkey, a.o_orderkey AS o_key, b.o_orderkey AS f_key, round(a.o_totalprice - b.o_totalprice, 4) AS diff FROM
(SELECT * FROM orders WHERE o_orderstatus = 'O' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) a
JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) b USING (o_custkey)
""")
def pair_pivot(spark, sf_dir):
    """Both sides of a pair by key, the last of each winning: one conditional aggregate instead of a self-join."""
    orders = Tables(spark, sf_dir).orders

    def last(status):
        return F.max(F.when(F.col("o_orderstatus") == status, F.struct("o_orderkey", "o_totalprice")))

    both = orders.where(F.col("o_orderstatus").isin("O", "F")).groupBy("o_custkey").agg(last("O").alias("o"), last("F").alias("f"))
    both = both.where(F.col("o").isNotNull() & F.col("f").isNotNull())
    return both.select("o_custkey", F.col("o.o_orderkey").alias("o_key"), F.col("f.o_orderkey").alias("f_key"), F.round(F.col("o.o_totalprice") - F.col("f.o_totalprice"), 4).alias("diff"))


@query("""
WITH x AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS k
  FROM lineitem WHERE l_returnflag IN ('R', 'A'))
SELECT a.l_partkey, a.k, a.l_orderkey AS r_order, b.l_orderkey AS a_order
FROM x a JOIN x b ON a.l_partkey = b.l_partkey AND a.k = b.k AND a.l_returnflag = 'R' AND b.l_returnflag = 'A'
""")
def kth_match(spark, sf_dir):
    lines = Tables(spark, sf_dir).lineitem
    order = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"]
    r = lines.where("l_returnflag = 'R'").select("l_partkey", F.col("l_orderkey").alias("r_order"), *order[1:], "l_orderkey")
    a = lines.where("l_returnflag = 'A'").select("l_partkey", F.col("l_orderkey").alias("a_order"), *order[1:], "l_orderkey")
    met = joins.kth_match(r, a, ["l_partkey"], order, order)
    return met.select("l_partkey", F.col("k").cast("bigint").alias("k"), "r_order", "a_order")


@query("""
SELECT c_custkey, coalesce(o_orderpriority, '') AS first_priority, coalesce(o_totalprice, 0.0) AS first_price FROM customer
LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) ON c_custkey = o_custkey
""")
def lookup_first_wins(spark, sf_dir):
    t = Tables(spark, sf_dir)
    dim = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_orderpriority").alias("first_priority"), F.col("o_totalprice").alias("first_price"))
    return joins.lookup(t.customer.select("c_custkey"), dim, ["c_custkey"], ["o_orderkey"], {"first_priority": "", "first_price": 0.0})


@query("""
WITH n AS (SELECT doc_id, length(regexp_replace(lower(text), '\\s+', '', 'g')) AS len, md5(regexp_replace(lower(text), '\\s+', '', 'g')) AS h FROM documents)
SELECT doc_id, CAST(len AS BIGINT) AS len, h FROM n WHERE (len, h) IN (SELECT len, h FROM n JOIN labels USING (doc_id))
""")
def semi_known_hash(spark, sf_dir):
    """Texts whose normalised hash is known for their length."""
    t = Tables(spark, sf_dir)
    norm = F.translate(F.lower("text"), " \t\n\r\f\x0b", "")
    hashed = t.documents.select("doc_id", norm.alias("z")).select("doc_id", F.length("z").cast("bigint").alias("len"), F.md5("z").alias("h"))
    known = hashed.join(t.labels.select("doc_id"), "doc_id", "left_semi").select("len", "h").distinct()
    return hashed.join(known, ["len", "h"], "left_semi").select("doc_id", "len", "h")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def anti_unseen(spark, sf_dir):
    t = Tables(spark, sf_dir)
    seen = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(seen, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


_BRANCHES = ["3-MEDIUM", "1-URGENT", "5-LOW", "2-HIGH", "4-NOT SPECIFIED"]


@query(f"""
SELECT o_custkey, first(o_orderpriority ORDER BY list_position({_BRANCHES!r}, o_orderpriority), o_orderkey) AS source,
  first(o_orderkey ORDER BY list_position({_BRANCHES!r}, o_orderpriority), o_orderkey) AS source_key, count(*) - 1 AS targets
FROM orders GROUP BY o_custkey HAVING count(*) >= 2
""")
def branch_order(spark, sf_dir):
    """The first member of each family in a declared order is its source, the others are targets."""
    rank = F.array_position(F.array(*map(F.lit, _BRANCHES)), F.col("o_orderpriority"))
    best = F.min(F.struct(rank.alias("rank"), "o_orderkey", "o_orderpriority"))
    found = Tables(spark, sf_dir).orders.groupBy("o_custkey").agg(best.alias("best"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return found.select("o_custkey", F.col("best.o_orderpriority").alias("source"), F.col("best.o_orderkey").alias("source_key"), (F.col("n") - 1).alias("targets"))


@query("""
WITH s AS (SELECT DISTINCT c_mktsegment FROM customer), o AS (SELECT DISTINCT o_orderstatus FROM orders),
f AS (SELECT c_nationkey, c_mktsegment, o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT n_name, s.c_mktsegment, o.o_orderstatus, coalesce(f.n, 0) AS n FROM nation CROSS JOIN s CROSS JOIN o
LEFT JOIN f ON f.c_nationkey = n_nationkey AND f.c_mktsegment = s.c_mktsegment AND f.o_orderstatus = o.o_orderstatus
""")
def grid_cross(spark, sf_dir):
    """A grid of jobs from small dimensions, filled from pre-aggregated facts."""
    t = Tables(spark, sf_dir)
    grid = t.nation.select("n_nationkey", "n_name").crossJoin(t.customer.select("c_mktsegment").distinct()).crossJoin(t.orders.select("o_orderstatus").distinct())
    by_customer = t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("k"))
    facts = by_customer.join(t.customer, by_customer["o_custkey"] == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment", "o_orderstatus").agg(F.sum("k").alias("n"))
    return grid.join(facts, ["n_nationkey", "c_mktsegment", "o_orderstatus"], "left").select("n_name", "c_mktsegment", "o_orderstatus", F.coalesce("n", F.lit(0)).alias("n"))


@query("""
WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL)
SELECT a.p_brand, a.p_size AS size_a, b.p_size AS size_b, a.n * b.n AS pairs FROM c a JOIN c b ON a.p_brand = b.p_brand AND abs(a.p_size - b.p_size) <= 2
""")
def band_join(spark, sf_dir):
    c = Tables(spark, sf_dir).part.groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))
    a, b = c.select("p_brand", F.col("p_size").alias("size_a"), F.col("n").alias("na")), c.select("p_brand", F.col("p_size").alias("size_b"), F.col("n").alias("nb"))
    return joins.band_join(a, b, ["p_brand"], "size_a", "size_b", 2).select("p_brand", "size_a", "size_b", (F.col("na") * F.col("nb")).alias("pairs"))


@query("""
SELECT page_id, n_name FROM pages LEFT JOIN (SELECT DISTINCT lang FROM documents) ON contains(url, '/' || lang || '/')
LEFT JOIN nation ON n_nationkey = page_id % 25 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY lang NULLS LAST) = 1
""".replace("page_id, n_name", "page_id, lang, n_name"))
def substr_join(spark, sf_dir):
    """The first language whose path segment a url contains."""
    t = Tables(spark, sf_dir)
    langs = t.documents.select("lang").distinct()
    met = joins.contains_first(t.pages.select("page_id", "url"), langs, "url", F.concat(F.lit("/"), "lang", F.lit("/")), [F.coalesce("lang", F.lit("~"))])
    nation = t.nation.select("n_nationkey", "n_name")
    return met.join(nation, F.col("page_id") % 25 == F.col("n_nationkey"), "left").select("page_id", "lang", "n_name")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
WHERE l_linestatus = 'O' AND (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')
""")
def composite_semi(spark, sf_dir):
    lines = Tables(spark, sf_dir).lineitem
    seen = lines.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey").distinct()
    return lines.where("l_linestatus = 'O'").join(seen, ["l_partkey", "l_suppkey"], "left_semi").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""
SELECT lang, sha256(text) AS digest, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY lang, text HAVING count(*) > 1
""")
def equal_value_groups(spark, sf_dir):
    """Rows with the same key and identical text, as groups."""
    docs = Tables(spark, sf_dir).documents
    return docs.groupBy("lang", "text").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("lang", F.sha2("text", 256).alias("digest"), "first_id", "n")


@query("""
SELECT event_id, user_id, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events
""".replace("max(CASE WHEN event_type = 'purchase' THEN event_id END)", "last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS)"))
def rightmost_start(spark, sf_dir):
    """The last purchase at or before each event of a user."""
    events = Tables(spark, sf_dir).events
    value = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return windows.as_of_last(events, ["user_id"], ["ts", "event_id"], value, "last_purchase").select("event_id", "user_id", "last_purchase")


@query("""
WITH a AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role = 'user'),
b AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role = 'assistant')
SELECT conv_id, i, a.turn AS asked, b.turn AS answered FROM a JOIN b USING (conv_id, i)
""")
def zip_join(spark, sf_dir):
    """Aligned lists zipped by an explicit position."""
    turns = Tables(spark, sf_dir).conversations.select("conv_id", "turn", "role")
    turns = turns.withColumn("i", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")).cast("bigint"))
    a = turns.where("role = 'user'").select("conv_id", "i", F.col("turn").alias("asked"))
    return a.join(turns.where("role = 'assistant'").select("conv_id", "i", F.col("turn").alias("answered")), ["conv_id", "i"])


@query("""
SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'F') AS n_f FROM orders
GROUP BY o_custkey HAVING n_o > 0 AND n_f > 0
""")
def key_intersection(spark, sf_dir):
    both = Tables(spark, sf_dir).orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("n_o"), F.count_if(F.col("o_orderstatus") == "F").alias("n_f"))
    return both.where("n_o > 0 and n_f > 0")


@query("""
SELECT l_partkey, l_quantity, count(*) AS n FROM (
  SELECT l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'N' EXCEPT ALL SELECT l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R') GROUP BY ALL
""")
def multiset_delta(spark, sf_dir):
    lines = Tables(spark, sf_dir).lineitem.select("l_partkey", "l_quantity", "l_returnflag")
    return sets.multiset_difference(lines.where("l_returnflag = 'N'"), lines.where("l_returnflag = 'R'"), ["l_partkey", "l_quantity"])


@query("""
SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'
""")
def group_overlap(spark, sf_dir):
    orders = Tables(spark, sf_dir).orders
    return orders.where("o_orderstatus = 'P'").select("o_custkey").intersect(orders.where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("""
SELECT pool, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT 'documents' AS pool, text FROM documents UNION ALL
SELECT 'benchmark', text FROM benchmark UNION ALL SELECT 'conversations', text FROM conversations) GROUP BY pool
""")
def union_pools(spark, sf_dir):
    t = Tables(spark, sf_dir)
    pools = None
    for name in ("documents", "benchmark", "conversations"):
        one = getattr(t, name).select(F.lit(name).alias("pool"), "text")
        pools = one if pools is None else pools.unionByName(one)
    return pools.groupBy("pool").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("""
SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer QUALIFY rank <= 5
""")
def topk_per_group(spark, sf_dir):
    top = windows.top_k(Tables(spark, sf_dir).customer, ["c_nationkey"], [F.desc("c_acctbal"), "c_custkey"], 5)
    return top.select("c_nationkey", "c_custkey", "c_acctbal", F.col("rank").cast("bigint").alias("rank"))


@query("""
SELECT o_orderstatus, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('11-' || o_orderkey), o_orderkey) <= 20
""")
def stratified_sample(spark, sf_dir):
    return sampling.stratified(Tables(spark, sf_dir).orders, ["o_orderstatus"], "o_orderkey", 20, "11").select("o_orderstatus", "o_orderkey")


@query("""
WITH g AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS unseen, md5('5-' || l_orderkey || '-' || l_linenumber) AS h FROM lineitem),
q AS (SELECT least(count(*) FILTER (unseen), greatest(200 - count(*) FILTER (NOT unseen), 100)) AS u FROM g)
SELECT l_orderkey, l_linenumber, unseen FROM g, q QUALIFY row_number() OVER (PARTITION BY unseen ORDER BY h, l_orderkey, l_linenumber) <= CASE WHEN unseen THEN u ELSE 200 - u END
""")
def quota_sample(spark, sf_dir):
    """Half the sample from the unseen rows, more where the seen ones are too few."""
    rows = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("unseen"))
    return sampling.quota(rows, "unseen", ["l_orderkey", "l_linenumber"], 200, "5").select("l_orderkey", "l_linenumber", "unseen")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('3-' || o_orderkey), o_orderkey LIMIT 50")
def simple_sample(spark, sf_dir):
    """A sample of fixed size without replacement."""
    return sampling.simple(Tables(spark, sf_dir).orders, "o_orderkey", 50, "3").select("o_orderkey", "o_custkey")


@query("""
SELECT fold, count(*) AS n, count(DISTINCT o_custkey) AS groups FROM (SELECT o_custkey, ('0x' || substr(md5('9-' || o_custkey), 1, 8))::BIGINT % 5 AS fold FROM orders) GROUP BY fold
""")
def grouped_folds(spark, sf_dir):
    """Five folds that keep each group whole."""
    rows = sampling.folds(Tables(spark, sf_dir).orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k")), "o_custkey", 5, "9")
    return rows.groupBy("fold").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("groups"))


@query("""
SELECT o_custkey, n, coalesce(n >= 12, false) AS common FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1998-01-01' GROUP BY 1) WHERE n BETWEEN 2 AND 12
""")
def having_range(spark, sf_dir):
    """Date range pushed into the scan, then a range on the group's size."""
    rows = Tables(spark, sf_dir).orders.where("o_orderdate >= timestamp_ntz '1996-01-01' and o_orderdate < timestamp_ntz '1998-01-01'")
    return rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n between 2 and 12").select("o_custkey", "n", (F.col("n") >= 12).alias("common"))


@query("""
SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = 1 AND count(DISTINCT o_orderpriority) = 1
""")
def singleton_groups(spark, sf_dir):
    """Keys with exactly one status and one priority."""
    rows = Tables(spark, sf_dir).orders.groupBy("o_custkey").agg(
        F.min("o_orderkey").alias("o_orderkey"), F.min("o_orderstatus").alias("a"), F.max("o_orderstatus").alias("b"),
        F.min("o_orderpriority").alias("c"), F.max("o_orderpriority").alias("d"))
    return rows.where("a = b and c = d").select("o_custkey", "o_orderkey")
