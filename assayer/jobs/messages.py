"""Messages, descriptions and links: what they say beside the code they belong to; slices, sets and embeddings of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.functions import code as C
from assayer.functions import text as X
from assayer.jobs.base import Tables, query
from assayer.jobs.repair import _ITEMS, _KNOWN, _filled, _filled_sql, _tokens, items
from assayer.operators import edits as E

#: What stands below each message; the fix adds the line with the limit.
BELOW = "\r\nSigned-off-by: A B <a@b.c>\nNote: https://example.org/1\n- gone\n  return -1;\n\n\n\n  if (len > limit) goto out\nshort\n(cherry picked from 1)\nMerge branch x\nbug 7: kept\n[1.2]\n"
ADDED = "if(len>limit)gotoout"


@query(rf"""WITH m AS (SELECT conv_id, turn, string_split(replace(text || '{BELOW}', chr(13), ''), chr(10)) AS ls FROM conversations),
k AS (SELECT conv_id, turn, list_transform(list_transform(ls, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda s: {{'s': s, 'kind': CASE WHEN s = '' THEN '' WHEN regexp_matches(s, '{X.TRAILER}') OR regexp_matches(s, '{X.REFERENCE}') THEN 'trailer'
 WHEN regexp_matches(s, '{X.DIFF_LINE}') THEN 'code' WHEN length(regexp_replace(s, '\s+', '', 'g')) >= 8 AND regexp_replace(s, '\s+', '', 'g') = '{ADDED}' THEN 'leak' ELSE '' END}}) AS r FROM m),
w AS (SELECT *, regexp_replace(regexp_replace(array_to_string(list_transform(list_filter(r, lambda x: x.kind = ''), lambda x: x.s), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM k)
SELECT conv_id, turn, md5(CASE WHEN length(t) > 1500 THEN regexp_replace(substr(t, 1, 1500), '(?s) [^ ]*$', '') || ' [...]' ELSE t END) AS digest, len(list_filter(r, lambda x: x.kind = 'code'))::INT AS code, len(list_filter(r, lambda x: x.kind = 'leak'))::INT AS leak,
 len(list_filter(r, lambda x: x.kind = 'trailer'))::INT AS trailer, length(t) > 1500 AS truncated FROM w""")
def clean_lines(spark, sf_dir):
    """Messages without trailers, code and lines that give the fix away, cut at a blank."""
    m = X.clean_message(F.concat("text", F.lit(BELOW)), F.array(F.lit(ADDED)))
    c = Tables(spark, sf_dir).conversations.select("conv_id", "turn", m.alias("m"))
    return c.select("conv_id", "turn", F.md5("m.cleaned").alias("digest"), "m.code", "m.leak", "m.trailer", "m.truncated")


DESCRIPTIONS = (
    "The copy_{k} function does not check used before memcpy, which allows attackers to crash.", "Off-by-one in fill_{k} when trace_it is called",
    "A long name overflows tmp via strncpy", "NULL dereference of a size in parse, return ignored",
)
STOP = ("which", "allows", "attackers", "crash", "function", "size", "return", "name")


@query(rf"""WITH {_ITEMS}, {_KNOWN}, d AS (SELECT i.*, {_filled_sql(DESCRIPTIONS).replace("t + 1", "i.t + 1")} AS de, off, string_split(v, chr(10)) AS vl, string_split(f, chr(10)) AS fl FROM i JOIN kn ON kn.t = i.t AND kn.kind = 'exact'),
x AS (SELECT k, de, v, array_to_string(list_concat(list_transform(off, lambda z: vl[z + 1]), list_filter(fl, lambda s: NOT list_contains(list_transform(vl, lambda z: regexp_replace(z, '\s+', '', 'g')), regexp_replace(s, '\s+', '', 'g')))), chr(10)) AS fix FROM d),
n AS (SELECT *, list_distinct(list_transform(list_filter(regexp_extract_all(de, '[A-Za-z_][A-Za-z0-9_]*'), lambda z: length(z) >= 4), lambda z: lower(z))) AS said, list_transform(list_filter(regexp_extract_all(fix, '[A-Za-z_][A-Za-z0-9_]*'), lambda z: length(z) >= 4), lambda z: lower(z)) AS names FROM x)
SELECT k, array_to_string(list_sort(list_filter(said, lambda z: list_contains(names, z) AND z NOT IN ({", ".join(f"'{x}'" for x in STOP)}))), ',') AS hits, list_contains(said, lower(regexp_extract(v, '(?s)([A-Za-z_]\w*)\s*\([^;{{]*\)\s*\{{', 1))) AS names_function,
 regexp_extract(de, '{X.REMEDY.replace("'", "''")}') AS remedy, len(regexp_extract_all(de, '\S+'))::INT AS words FROM n""")
def cues(spark, sf_dir):
    """What the description of each item gives away of the place and kind of its fix."""
    rows = E.with_script(items(Tables(spark, sf_dir)), "v", "f", "fix").withColumns({"de": _filled(DESCRIPTIONS), "off": E.changed_lines(F.col("fix")), "vl": C.code_lines(F.col("v")), "fl": C.code_lines(F.col("f"))})
    bare = lambda s: F.regexp_replace(s, r"\s+", "")
    new = F.filter("fl", lambda s: ~F.array_contains(F.transform("vl", bare), bare(s)))
    fix = F.array_join(F.concat(F.transform("off", lambda i: F.get("vl", i)), new), "\n")
    c = rows.select("k", X.cues(F.col("de"), fix, C.function_name(F.col("v")), STOP).alias("c"))
    return c.select("k", F.array_join("c.location_hits", ",").alias("hits"), "c.names_function", F.col("c.remedy_phrase").alias("remedy"), "c.words")


#: Links by kind; {k} is the page.
LINKS = (
    "https://github.com/ann/lib/commit/0123abc{k}", "http://github.com/ann/lib/pull/{k}/commits/0123456789abcdef", "https://android.googlesource.com/platform/x/+/0123456789abcdef0123456789abcdef01234567",
    "https://cgit.freedesktop.org/one/two/commit/?h=m&id=0123456789abcdef0123456789abcdef01234567", "https://cgit.freedesktop.org/other/commit/?id=0123456789abcdef0123456789abcdef01234567",
    "https://git.example.org/gitweb/?p=tool.git;a=commit;h=0123456789abcdef0123456789abcdef01234567", "https://git.example.org/gitweb/?p=tool.git;h=12", "ftp://none/{k}",
)
FORGES, MIRRORS = {"one/two": "two/two"}, {"tool.git": "mirror/tool"}
_SHA = "[0-9a-f]{40}"


@query(rf"""WITH l AS (SELECT page_id, replace(([{", ".join(f"'{x}'" for x in LINKS)}])[page_id % 8 + 1], '{{k}}', page_id::VARCHAR) AS l FROM pages),
x AS (SELECT page_id, l, regexp_extract(l, '^https?://github\.com/([^/]+/[^/]+)/(?:commit|pull/[0-9]+/commits)/([0-9a-f]{{7,40}})', ['r', 's']) AS a, regexp_extract(l, '^https?://android\.googlesource\.com/(.+?)/\+/({_SHA})', ['r', 's']) AS b,
 regexp_extract(l, '^https?://cgit\.freedesktop\.org/(.+?)/commit/.*?id=({_SHA})', ['r', 's']) AS c, regexp_extract(l, '(?:[?;&]h=|[?&]id=)({_SHA})', 1) AS h FROM l)
SELECT page_id, CASE WHEN a.s <> '' THEN 'github' WHEN b.s <> '' THEN 'gsource' WHEN c.r = 'one/two' THEN 'gitlab' WHEN contains(l, 'tool.git') AND h <> '' THEN 'github' END AS kind,
 CASE WHEN a.s <> '' THEN a.r WHEN b.s <> '' THEN b.r WHEN c.r = 'one/two' THEN 'two/two' WHEN contains(l, 'tool.git') AND h <> '' THEN 'mirror/tool' END AS repo,
 CASE WHEN a.s <> '' THEN a.s WHEN b.s <> '' THEN b.s WHEN c.r = 'one/two' THEN c.s WHEN contains(l, 'tool.git') AND h <> '' THEN h END AS sha FROM x""")
def url_resolver(spark, sf_dir):
    """Host kind, repository and revision of links to changes."""
    link = F.replace(F.element_at(F.array(*map(F.lit, LINKS)), (F.col("page_id") % 8 + 1).cast("int")), F.lit("{k}"), F.col("page_id").cast("string"))
    return Tables(spark, sf_dir).pages.select("page_id", X.resolve_link(link, FORGES, MIRRORS).alias("r")).select("page_id", "r.kind", "r.repo", "r.sha")


@query(f"WITH {_tokens('pages', 'page_id', 'html', 'x')} SELECT page_id, len(sl)::BIGINT AS n, md5(array_to_string(sl, chr(1))) AS digest FROM x")
def slice_lines(spark, sf_dir):
    """Lines with a sink and lines that share an identifier with them, else with assignments and calls."""
    k = C.slice_rows(F.col("html"))
    return Tables(spark, sf_dir).pages.select("page_id", F.size(k).cast("bigint").alias("n"), F.md5(F.array_join(k, "\x01")).alias("digest"))


@query("""WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(substr(text, 1, 80)), '[a-z]+')) AS a, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS b FROM conversations)
SELECT conv_id, turn, len(list_intersect(a, b)) = len(a) AND len(a) < len(b) AS inside, len(a)::INT AS n FROM w""")
def proper_subsets(spark, sf_dir):
    """Whether the words of a turn's start are some, but not all, of its words."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)))
    w = Tables(spark, sf_dir).conversations.select("conv_id", "turn", words(F.substring("text", 1, 80)).alias("a"), words(F.col("text")).alias("b"))
    return w.select("conv_id", "turn", C.proper_subset(F.col("a"), F.col("b")).alias("inside"), F.size("a").alias("n"))


SEED, SLOTS = "42", 256


def embedding_grams(text: Column) -> Column:
    """Runs of letters, digits and underscores, pairs of neighbours, and runs of four characters of all of them together."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))

    def grams(t: Column) -> Column:
        pairs = F.transform(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), lambda a, i: F.concat(a, F.lit("~"), F.get(t, i + 1)))
        joined = F.array_join(t, "")
        parts = F.transform(F.sequence(F.lit(1), F.greatest(F.length(joined) - 3, F.lit(1))), lambda i: F.substring(joined, i, F.lit(4)))
        return F.concat(t, pairs, F.when(F.length(joined) >= 4, parts).otherwise(F.array().cast("array<string>")))

    return X.let(tokens, grams)


_EMBED = rf"""t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS t FROM conversations), j AS (SELECT *, array_to_string(t, '') AS c FROM t),
g AS (SELECT conv_id, turn, unnest(list_concat(t, list_concat([t[i] || '~' || t[i + 1] for i in range(1, len(t))], [substr(c, i, 4) for i in range(1, length(c) - 2)]))) AS g FROM j),
h AS (SELECT conv_id, turn, md5('{SEED}' || g) AS m FROM g), s AS (SELECT conv_id, turn, ('0x' || substr(m, 31, 2))::BIGINT AS slot, sum(CASE WHEN ('0x' || substr(m, 29, 2))::BIGINT % 2 = 1 THEN 1 ELSE -1 END)::DOUBLE AS x FROM h GROUP BY ALL),
e AS (SELECT conv_id, turn, slot, x / sqrt(sum(x * x) OVER (PARTITION BY conv_id, turn)) AS w FROM s WHERE x <> 0)"""


def embeddings(t: Tables):
    """Signed feature hashing of a turn's grams to slots, at unit length and sparse."""
    g = t.conversations.select("conv_id", "turn", F.explode(embedding_grams(F.col("text"))).alias("g")).withColumn("m", F.md5(F.concat(F.lit(SEED), "g")))
    byte = lambda at: F.conv(F.substring("m", at, 2), 16, 10).cast("bigint")
    s = g.groupBy("conv_id", "turn", byte(31).alias("slot")).agg(F.sum(F.when(byte(29) % 2 == 1, 1).otherwise(-1)).cast("double").alias("x")).where("x <> 0")
    norm = s.groupBy("conv_id", "turn").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len"))
    return s.join(norm, ["conv_id", "turn"]).select("conv_id", "turn", "slot", (F.col("x") / F.col("len")).alias("w"))


@query(f"WITH {_EMBED} SELECT conv_id, turn, slot, round(w, 6) AS w FROM e")
def hashed_embed(spark, sf_dir):
    """The hashed embedding of each turn."""
    return embeddings(Tables(spark, sf_dir)).select("conv_id", "turn", "slot", F.round("w", 6).alias("w"))


@query(f"WITH {_EMBED} SELECT a.conv_id, a.turn, round(sum(a.w * b.w), 6) AS similarity FROM e a JOIN e b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.slot = b.slot GROUP BY ALL")
def embed_similarity(spark, sf_dir):
    """Cosine of each turn's embedding to that of the next turn."""
    e = embeddings(Tables(spark, sf_dir))
    after = e.select("conv_id", (F.col("turn") - 1).alias("turn"), "slot", F.col("w").alias("y"))
    return e.join(after, ["conv_id", "turn", "slot"]).groupBy("conv_id", "turn").agg(F.round(F.sum(F.col("w") * F.col("y")), 6).alias("similarity"))


@query("""WITH r AS (SELECT l_orderkey, ln(1 + l_discount + l_tax) AS lp, (l_discount - 0.05) / 0.03 AS z, l_returnflag = 'R' AS added FROM lineitem),
k AS (SELECT l_orderkey, lp, z, count(*) OVER w AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY lp) AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY z) AS b FROM r WINDOW w AS (PARTITION BY l_orderkey)),
m AS (SELECT l_orderkey, max(n) AS n, avg(lp) AS mean_lp, avg(lp) FILTER (a <= greatest(1, ceil(0.2 * n))) AS mink, avg(z) FILTER (b <= greatest(1, ceil(0.2 * n))) AS minkpp FROM k GROUP BY l_orderkey),
s AS (SELECT l_orderkey, count(*) FILTER (added) AS n_added, avg(lp) FILTER (added) AS lp_added, avg(lp) FILTER (NOT added) AS lp_unchanged, avg(z) FILTER (added) AS z_added, avg(z) FILTER (NOT added) AS z_unchanged FROM r GROUP BY l_orderkey)
SELECT l_orderkey, n, n_added, round(mean_lp, 6) AS mean_lp, round(mink, 6) AS mink, round(minkpp, 6) AS minkpp, round(lp_added, 6) AS lp_added, round(lp_unchanged, 6) AS lp_unchanged, round(z_added, 6) AS z_added, round(z_unchanged, 6) AS z_unchanged FROM m JOIN s USING (l_orderkey)""")
def token_scores(spark, sf_dir):
    """Means of a text's least likely fifth of token scores, rounded up, raw and standardised, and of added and unchanged tokens."""
    added = F.col("l_returnflag") == "R"
    rows = Tables(spark, sf_dir).lineitem.select("l_orderkey", F.log(1 + F.col("l_discount") + F.col("l_tax")).alias("lp"), ((F.col("l_discount") - 0.05) / 0.03).alias("z"), added.alias("added"))

    def least(c: str) -> Column:
        kept = F.slice(F.array_sort(F.collect_list(c)), 1, F.greatest(F.ceil(F.count(F.lit(1)) * 0.2), F.lit(1)).cast("int"))
        return F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x) / F.size(kept)

    mean = lambda c, w: F.round(F.avg(F.when(w, F.col(c))), 6)
    yes = F.col("added")
    return rows.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("added").alias("n_added"), F.round(F.avg("lp"), 6).alias("mean_lp"), F.round(least("lp"), 6).alias("mink"), F.round(least("z"), 6).alias("minkpp"),
        mean("lp", yes).alias("lp_added"), mean("lp", ~yes).alias("lp_unchanged"), mean("z", yes).alias("z_added"), mean("z", ~yes).alias("z_unchanged"))
