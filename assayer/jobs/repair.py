"""Patches and their judge: items rendered from parts, candidate patches of known kinds, runs of three arms from order lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import code as C
from assayer.functions import diff as D
from assayer.functions import stats
from assayer.jobs.base import Tables, query
from assayer.operators import edits as E
from assayer.operators import judge as J
from assayer.operators import ladder
from assayer.operators import tests as T
from assayer.operators import windows as W
from assayer.operators.joins import large, spread
from assayer.sources.shared import Scratch

#: Four functions before and after their fix; {k} is the part, {n} its size.
FUNCTIONS = (
    ("int copy_{k}(char *dst, const char *src, int len) {\n    char buf[{n}];\n    int used = len;\n    memcpy(buf, src, len);\n    used = used + 1;\n    return used;\n}\n",
     "int copy_{k}(char *dst, const char *src, int len) {\n    char buf[{n}];\n    int used = len;\n    if (len > {n}) return -1;\n    memcpy(buf, src, len);\n    used = used + 1;\n    return used;\n}\n"),
    ("void fill_{k}(int *a, int n) {\n    int b[{n}];\n    trace_it();\n    for (i = 0; i <= n; i++) {\n        b[i] = a[i];\n    }\n    b[i] = a[i];\n}\n",
     "void fill_{k}(int *a, int n) {\n    int b[{n}];\n    trace_it();\n    for (i = 0; i < n; i++) {\n        b[i] = a[i];\n    }\n    b[i] = a[i];\n}\n"),
    ("int join_{k}(char *out, char *name) {\n    char tmp[{n}];\n    strcpy(tmp, name);\n    strcat(out, tmp);\n    strcpy(tmp, name);\n    return 0;\n}\n",
     "int join_{k}(char *out, char *name) {\n    char tmp[{n}];\n    strcpy(tmp, name);\n    strcat(out, tmp);\n    strncpy(tmp, name, {n});\n    return 0;\n}\n"),
    ("int load_{k}(char *p, int size) {\n    char *q = malloc(size);\n    int rc = 0;\n    rc = parse(q, size);\n    log_rc(rc);\n    rc = rc + {n};\n    free(q);\n    return rc;\n}\n",
     "int load_{k}(char *p, int size) {\n    char *q = malloc(size);\n    if (!q) return -1;\n    int rc = 0;\n    rc = parse(q, size);\n    log_rc(rc);\n    rc = rc + {n};\n    free(q);\n    q = 0;\n    return rc;\n}\n"),
)
_PARTIAL = (("    memcpy", "    if (len < 0) return -1;\n    memcpy"), ("i <= n", "i <= n - 1"), ("    strcpy(tmp, name);\n    strcat", "    strncpy(tmp, name, {n});\n    strcat"), ("size);\n    int rc", "size);\n    if (!q) return -1;\n    int rc"))
_OTHER = (("used + 1", "used + 2"), ("trace_it();", "trace_all(n);"), ("return 0", "return 1"), ("int rc = 0", "int rc = 1"))
#: Candidates by kind, one text for each function.
CANDIDATES = {
    "exact": tuple(f.replace("    ", "\t") for _, f in FUNCTIONS),
    "extra": tuple(f.replace(") {\n", ") {\n    int extra = 0;\n", 1) for _, f in FUNCTIONS),
    "partial": tuple(v.replace(*r) for (v, _), r in zip(FUNCTIONS, _PARTIAL)),
    "noop": tuple(v.replace(";\n", "; // reviewed\n", 1) for v, _ in FUNCTIONS),
    "unbalanced": tuple(f[:-2] for _, f in FUNCTIONS),
    "other": tuple(v.replace(*r) for (v, _), r in zip(FUNCTIONS, _OTHER)),
}
KINDS = tuple(CANDIDATES)
# Fixed values, read off the texts above: for each function the lines (from 0) that its fix and each kind of candidate
# change, an insertion counting as the line before it, and the number of lines that they remove and add.
FIX_LINES = ([2], [3], [4], [1, 6])
FIX_SIZE = (1, 2, 2, 2)
CHANGED = {
    "exact": ([2], [3], [4], [1, 6]), "extra": ([0, 2], [0, 3], [0, 4], [0, 1, 6]), "partial": ([2], [3], [2], [1]),
    "noop": ([1], [1], [1], [1]), "unbalanced": ([2, 6], [3, 7], [4, 6], [1, 6, 8]), "other": ([4], [2], [5], [2]),
}
SIZES = {"exact": (1, 2, 2, 2), "extra": (2, 3, 3, 3), "partial": (1, 2, 2, 1), "noop": (2, 2, 2, 2), "unbalanced": (2, 3, 3, 3), "other": (2, 2, 2, 2)}
BASE_ARM = "A"


def _filled(texts: tuple[str, ...]) -> Column:
    one = F.element_at(F.array(*map(F.lit, texts)), F.col("t") + 1)
    return F.replace(F.replace(one, F.lit("{k}"), F.col("k").cast("string")), F.lit("{n}"), F.col("n").cast("string"))


def _filled_sql(texts: tuple[str, ...]) -> str:
    return "replace(replace(([{}])[t + 1], '{{k}}', k::VARCHAR), '{{n}}', n::VARCHAR)".format(", ".join(f"'{x}'" for x in texts))


def items(t: Tables) -> DataFrame:
    """``k``, ``n``, ``t``, the weakness class and the function before (``v``) and after (``f``) its fix."""
    rows = t.part.select(F.col("p_partkey").alias("k"), F.col("p_size").alias("n"), (F.col("p_partkey") % 4).cast("int").alias("t"), F.concat(F.lit("CWE-"), (F.col("p_size") % 5).cast("string")).alias("cwe"))
    return spread(rows, "k").withColumns({"v": _filled(tuple(v for v, _ in FUNCTIONS)), "f": _filled(tuple(f for _, f in FUNCTIONS))})


def candidates(t: Tables, of: DataFrame | None = None) -> DataFrame:
    """Each item, or of items with what is known of them, with each kind of candidate ``p``."""
    made = F.array(*(F.struct(F.lit(kind).alias("kind"), _filled(texts).alias("p")) for kind, texts in CANDIDATES.items()))
    return (items(t) if of is None else of).select("*", F.inline(made))


def judged(t: Tables) -> DataFrame:
    """Each candidate with its verdict; a function and its fix are read once."""
    return J.judge(candidates(t, J.with_sides(items(t))))


def runs(t: Tables) -> DataFrame:
    """A run for each order line: item, arm, the kind of candidate it ended with, and its order within item and arm."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), ((F.col("l_suppkey") + F.col("l_linenumber") * 5 + F.col("l_orderkey")) % 6 + 1).cast("int"))
    at = F.row_number().over(Window.partitionBy("l_partkey", "l_returnflag").orderBy("l_orderkey", "l_linenumber"))
    return t.lineitem.select(F.col("l_partkey").alias("k"), F.col("l_returnflag").alias("arm"), kind.alias("kind"), at.alias("rep"))


_ITEMS = f"""i0 AS (SELECT p_partkey AS k, p_size AS n, (p_partkey % 4)::INT AS t, 'CWE-' || (p_size % 5) AS cwe FROM part),
i AS (SELECT *, {_filled_sql(tuple(v for v, _ in FUNCTIONS))} AS v, {_filled_sql(tuple(f for _, f in FUNCTIONS))} AS f FROM i0)"""
_CANDIDATES = f"""{_ITEMS},
c AS ({" UNION ALL ".join(f"SELECT k, n, t, cwe, v, f, '{kind}' AS kind, {_filled_sql(texts)} AS p FROM i" for kind, texts in CANDIDATES.items())})"""
_RUNS = f"""r AS (SELECT l_partkey AS k, l_returnflag AS arm, ([{", ".join(f"'{x}'" for x in KINDS)}])[(l_suppkey + l_linenumber * 5 + l_orderkey) % 6 + 1] AS kind,
  row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_orderkey, l_linenumber) AS rep FROM lineitem)"""
_KNOWN = "kn(t, kind, mine, size, off, off_size) AS (VALUES {})".format(
    ", ".join(f"({k}, '{kind}', {CHANGED[kind][k]}::BIGINT[], {SIZES[kind][k]}, {FIX_LINES[k]}::BIGINT[], {FIX_SIZE[k]})" for kind in KINDS for k in range(4))
)


def _stm(x: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({x}, '(?s)/\*.*?\*/', ' ', 'g'), chr(10)), lambda s: regexp_replace(regexp_replace(s, '//.*', ''), '\s+', '', 'g')), lambda s: s NOT IN ('', '{{', '}}', '}};'))"


def _minus(a: str, b: str) -> str:
    return f"flatten(list_transform(list_distinct({a}), lambda s: list_transform(range(0, greatest(len(list_filter({a}, lambda z: z = s)) - len(list_filter({b}, lambda z: z = s)), 0)), lambda j: s)))"


def _slice_rows(x: str) -> tuple[str, str]:
    """SQL of the stripped lines, and of the slice over columns ``ls`` (them) and ``st`` (where it starts)."""
    ids = "regexp_extract_all(s, '[A-Za-z_][A-Za-z0-9_]*')"
    lines = rf"list_filter(list_transform(string_split({x}, chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"
    return lines, f"list_filter(ls, lambda s: list_contains(st, s) OR list_has_any({ids}, list_distinct(flatten(list_transform(st, lambda s: {ids})))))"


def _start(ls: str) -> str:
    sinks = f"list_filter({ls}, lambda s: regexp_matches(s, '{C.SINK}'))"
    return f"CASE WHEN len({sinks}) > 0 THEN {sinks} ELSE list_filter({ls}, lambda s: contains(s, '=') OR contains(s, '(')) END"


def _tokens(table: str, key: str, x: str, name: str) -> str:
    """CTEs that end in ``name``: ``key`` and the distinct tokens ``tk`` of the slice of ``x``."""
    lines, kept = _slice_rows(x)
    bare = rf"regexp_replace(regexp_replace(array_to_string(sl, chr(10)), '(?s)/\*.*?\*/', ' ', 'g'), '//[^\n]*', ' ', 'g')"
    return f"""{name}1 AS (SELECT {key}, {lines} AS ls FROM {table}), {name}2 AS (SELECT *, {_start("ls")} AS st FROM {name}1), {name}3 AS (SELECT *, {kept} AS sl FROM {name}2),
{name} AS (SELECT {key}, CASE WHEN len(tk) > 0 THEN tk ELSE ['_empty_'] END AS tk, sl FROM (SELECT *, list_distinct(regexp_extract_all({bare}, '[A-Za-z_][A-Za-z0-9_]*|[^\\sA-Za-z_]')) AS tk FROM {name}3))"""


def _judged(source: str) -> str:
    """CTEs that end in ``j``: the rows of ``source`` (k, kind, v, f, p) with the judge's columns."""
    depth = "list_transform(range(1, len(br) + 1), lambda x: list_sum(list_transform(br[1:x], lambda b: CASE WHEN b = '{' THEN 1 ELSE -1 END)))"
    return f"""{_tokens(source, "k, kind", "p", "tp")}, {_tokens(source, "k, kind", "v", "tv")},
s0 AS (SELECT *, {_stm("v")} AS sv, {_stm("f")} AS sf, {_stm("p")} AS sp, regexp_extract_all(p, '[{{}}]') AS br FROM {source}),
s1 AS (SELECT *, {_minus("sv", "sf")} AS lost, {_minus("sf", "sv")} AS new, {_minus("sv", "sp")} AS lost_p, {_minus("sp", "sv")} AS new_p, {depth} AS dp FROM s0),
s2 AS (SELECT *, CASE WHEN len(lost_p) + len(new_p) = 0 THEN 'unchanged' WHEN len(br) = 0 OR list_min(dp) < 0 OR dp[-1] <> 0 THEN 'unbalanced_braces' WHEN sp = sf THEN 'equivalent_to_official_fix'
  WHEN len({_minus("lost", "lost_p")}) + len({_minus("new", "new_p")}) = 0 THEN 'covers_official_fix_changes' ELSE 'missing_official_fix_changes' END AS reason FROM s1),
j AS (SELECT s2.*, reason IN ('equivalent_to_official_fix', 'covers_official_fix_changes') AS validated, len(list_intersect(tp.tk, tv.tk))::DOUBLE / (len(tp.tk) + len(tv.tk) - len(list_intersect(tp.tk, tv.tk))) AS similarity
  FROM s2 JOIN tp USING (k, kind) JOIN tv USING (k, kind))"""


def _r(c, n=6):
    return F.round(c, n)


@query(f"WITH {_CANDIDATES}, {_judged('c')} SELECT k, kind, validated, reason, round(similarity, 6) AS similarity, similarity < 0.9 AS severed FROM j")
def oracle_verdict(spark, sf_dir):
    """The judge's verdict on each candidate of each item."""
    return judged(Tables(spark, sf_dir)).select("k", "kind", "validated", "reason", _r(F.col("similarity")).alias("similarity"), "severed")


def _kept_rows() -> Column:
    """The lines whose stripped form is no slice line."""
    gone = C.slice_rows(F.col("v"))
    stripped = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    return F.array_join(F.filter(C.code_lines(F.col("v")), lambda s: ~F.array_contains(gone, stripped(s))), "\n")


def bad_candidates(t: Tables) -> DataFrame:
    """The official fix and three patches known to be bad: the slice deleted, comments only, a broken return."""
    commented = F.array_join(F.transform(C.code_lines(F.col("v")), lambda s: F.when(F.rtrim(s).endswith(";"), F.concat(s, F.lit("\n    /* reviewed: no change */"))).otherwise(s)), "\n")
    once = F.regexp_replace("v", r"(?s)\A(.*?)return\s+[^;]+;", "$1return -999;")
    broken = F.when(once.contains("return -999;"), once).otherwise(F.concat(once, F.lit("\n    return -999;")))
    made = (("official", F.col("f")), ("whole_slice_deletion", _kept_rows()), ("noop", commented), ("semantics_break", broken))
    return J.with_sides(items(t)).select("k", "v", "f", *J.SIDES, F.inline(F.array(*(F.struct(F.lit(n).alias("kind"), p.alias("p")) for n, p in made))))


_BAD = rf"""{_ITEMS}, {_tokens("i", "k", "v", "g")},
b0 AS (SELECT k, v, f, sl, string_split(regexp_replace(v, '\n$', ''), chr(10)) AS ls, regexp_replace(v, 'return\s+[^;]+;', 'return -999;') AS once FROM i JOIN g USING (k)),
b AS (SELECT k, v, f, 'official' AS kind, f AS p FROM b0 UNION ALL SELECT k, v, f, 'whole_slice_deletion', array_to_string(list_filter(ls, lambda s: NOT list_contains(sl, regexp_replace(s, '^\s+|\s+$', '', 'g'))), chr(10)) FROM b0
  UNION ALL SELECT k, v, f, 'noop', array_to_string(list_transform(ls, lambda s: CASE WHEN ends_with(rtrim(s), ';') THEN s || chr(10) || '    /* reviewed: no change */' ELSE s END), chr(10)) FROM b0
  UNION ALL SELECT k, v, f, 'semantics_break', CASE WHEN contains(once, 'return -999;') THEN once ELSE once || chr(10) || '    return -999;' END FROM b0)"""


@query(f"WITH {_BAD} SELECT k, kind, md5(p) AS digest FROM b")
def bad_patches(spark, sf_dir):
    """Known bad patches of each item, beside its fix."""
    return bad_candidates(Tables(spark, sf_dir)).select("k", "kind", F.md5("p").alias("digest"))


@query(f"""WITH {_BAD}, {_judged("b")},
x AS (SELECT *, kind = 'official' AS gold, similarity < 0.9 AS severed FROM j),
n AS (SELECT count(*) FILTER (gold AND validated) AS tp, count(*) FILTER (NOT gold AND validated) AS fp, count(*) FILTER (NOT gold AND NOT validated) AS tn, count(*) FILTER (gold AND NOT validated) AS fn,
 count(*) FILTER (validated AND NOT severed) AS a, count(*) FILTER (validated AND severed) AS b, count(*) FILTER (NOT validated AND NOT severed) AS c, count(*) FILTER (NOT validated AND severed) AS d,
 count(*) FILTER (kind = 'whole_slice_deletion' AND severed AND NOT validated) AS hits, count(*) FILTER (kind = 'whole_slice_deletion') AS deletions FROM x)
SELECT tp, fp, tn, fn, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall, round(fp::DOUBLE / (fp + tn), 6) AS false_accept_rate,
 round(coalesce((a::DOUBLE * d - b * c) / nullif(sqrt((a + b)::DOUBLE * (a + c) * (d + b) * (d + c)), 0), 0), 6) AS severance_mcc, round(c::DOUBLE / greatest(c + d, 1), 6) AS severance_false_accept_rate,
 fn = 0 AS negative_control, round(hits::DOUBLE / deletions, 6) AS positive_control FROM n""")
def oracle_calibration(spark, sf_dir):
    """The judge against four sets of known truth, and how far severance of the slice agrees with it."""
    x = J.judge(bad_candidates(Tables(spark, sf_dir)))
    gold, ok, cut, deletion = F.col("kind") == "official", F.col("validated"), F.col("severed"), F.col("kind") == "whole_slice_deletion"
    n = x.agg(
        F.count_if(gold & ok).alias("tp"), F.count_if(~gold & ok).alias("fp"), F.count_if(~gold & ~ok).alias("tn"), F.count_if(gold & ~ok).alias("fn"),
        F.count_if(ok & ~cut).alias("a"), F.count_if(ok & cut).alias("b"), F.count_if(~ok & ~cut).alias("c"), F.count_if(~ok & cut).alias("d"),
        F.count_if(deletion & cut & ~ok).alias("hits"), F.count_if(deletion).alias("deletions"))
    precision, recall, _ = stats.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return n.select(
        "tp", "fp", "tn", "fn", _r(precision).alias("precision"), _r(recall).alias("recall"), _r(F.col("fp") / (F.col("fp") + F.col("tn"))).alias("false_accept_rate"),
        _r(stats.mcc(F.col("a"), F.col("c"), F.col("d"), F.col("b"))).alias("severance_mcc"), _r(F.col("c") / F.greatest(F.col("c") + F.col("d"), F.lit(1))).alias("severance_false_accept_rate"),
        (F.col("fn") == 0).alias("negative_control"), _r(F.col("hits") / F.col("deletions")).alias("positive_control"))


def _judged_runs(t: Tables) -> DataFrame:
    """Runs with the reason of their last candidate; each different candidate is judged once."""
    verdicts = judged(t).select("k", "kind", "validated", "reason", "severed")
    return runs(t).join(large(verdicts), ["k", "kind"])


@query(f"""WITH {_CANDIDATES}, {_judged("c")}, {_RUNS}, o AS (SELECT arm, count(*) AS n, count(*) FILTER (validated) AS validated, count(*) FILTER (reason = 'equivalent_to_official_fix') AS exact_fix,
 count(*) FILTER (reason = 'missing_official_fix_changes') AS misses_fix, count(*) FILTER (reason IN ('unchanged', 'unbalanced_braces')) AS unchanged, count(*) FILTER (similarity < 0.9) AS severed FROM r JOIN j USING (k, kind) GROUP BY arm),
p AS (SELECT *, validated::DOUBLE / n AS p FROM o)
SELECT arm, n, validated, exact_fix, misses_fix, unchanged, severed, round(p, 6) AS vpr, round((p + 1.9208 / n - 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n::DOUBLE * n))) / (1 + 3.8416 / n), 6) AS lo,
 round((p + 1.9208 / n + 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n::DOUBLE * n))) / (1 + 3.8416 / n), 6) AS hi FROM p""")
def outcome_shares(spark, sf_dir):
    """Outcomes of each arm's runs, and the validated rate with its interval."""
    why = F.col("reason")
    o = _judged_runs(Tables(spark, sf_dir)).groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("validated").alias("validated"), F.count_if(why == J.EXACT).alias("exact_fix"), F.count_if(why == J.MISSING).alias("misses_fix"),
        F.count_if(why.isin(J.UNCHANGED, J.UNBALANCED)).alias("unchanged"), F.count_if("severed").alias("severed"))
    lo, hi = stats.wilson(F.col("validated"), F.col("n"))
    return o.select("arm", "n", "validated", "exact_fix", "misses_fix", "unchanged", "severed", _r(F.col("validated") / F.col("n")).alias("vpr"), _r(lo).alias("lo"), _r(hi).alias("hi"))


def _lines_of(t: Tables) -> DataFrame:
    """Changed lines and sizes of each candidate and of the fix, the number of lines, and ``same`` where no statement changed; a function and its fix are compared once."""
    made = E.with_script(items(t), "v", "f", "fix").withColumns({"off": E.changed_lines(F.col("fix")), "lines": F.size(C.code_lines(F.col("v"))), "sv": C.tagged(C.statements(F.col("v")))})
    each = candidates(t, made.select("k", "t", "n", "v", "off", F.col("fix.size").alias("off_size"), "lines", "sv"))
    return E.with_script(each, "v", "p", "own").select(
        "k", "t", "kind", E.changed_lines(F.col("own")).alias("mine"), "off", F.col("own.size").alias("size"), "off_size", "lines", (F.col("sv") == C.tagged(C.statements(F.col("p")))).alias("same"))


@query(f"WITH {_KNOWN}, i AS (SELECT p_partkey AS k, p_partkey % 4 AS t FROM part) SELECT k, kind, array_to_string(mine, ',') AS mine, array_to_string(off, ',') AS off, size::BIGINT AS size, off_size::BIGINT AS off_size FROM i JOIN kn USING (t)")
def diff_lines(spark, sf_dir):
    """Lines that a candidate and the fix change, and the sizes of both edits."""
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return _lines_of(Tables(spark, sf_dir)).select("k", "kind", text("mine"), text("off"), F.col("size").cast("bigint").alias("size"), F.col("off_size").cast("bigint").alias("off_size"))


_MEASURED = f"""{_KNOWN}, {_RUNS}, m AS (SELECT r.*, mine, off, size, off_size, r.kind = 'noop' AS same, len(list_intersect(mine, off)) AS common, (CASE k % 4 WHEN 0 THEN 7 WHEN 1 THEN 8 WHEN 2 THEN 7 ELSE 9 END) AS lines FROM r JOIN kn ON kn.t = k % 4 AND kn.kind = r.kind)"""


def _measured(t: Tables) -> DataFrame:
    """Runs with the changed lines of their candidate and of the fix; ``same`` where no statement changed."""
    known = Scratch(t.part.sparkSession).write(_lines_of(t).drop("t").withColumn("common", F.size(F.array_intersect("mine", "off"))))
    return runs(t).join(large(known), ["k", "kind"])


@query(f"""WITH {_MEASURED}, s AS (SELECT arm, count(*) AS n, count(*) FILTER (common > 0) AS touched, median(size) AS size, median(off_size) AS off_size FROM m WHERE NOT same GROUP BY arm), p AS (SELECT *, touched::DOUBLE / n AS p FROM s)
SELECT arm, n AS changed, touched, round((p + 1.9208 / n - 1.96 * sqrt(p * (1 - p) / n + 0.9604 / (n::DOUBLE * n))) / (1 + 3.8416 / n), 6) AS lo, floor(size)::BIGINT AS size_median, floor(off_size)::BIGINT AS fix_size_median FROM p""")
def localisation_t5(spark, sf_dir):
    """Share of changed patches that touch the fix's lines, and median edit sizes."""
    m = _measured(Tables(spark, sf_dir)).where("not same")
    s = m.groupBy("arm").agg(F.count(F.lit(1)).alias("changed"), F.count_if(F.col("common") > 0).alias("touched"), F.percentile("size", 0.5).alias("size"), F.percentile("off_size", 0.5).alias("off_size"))
    lo, _ = stats.wilson(F.col("touched"), F.col("changed"))
    return s.select("arm", "changed", "touched", _r(lo).alias("lo"), F.floor("size").alias("size_median"), F.floor("off_size").alias("fix_size_median"))


_PAIRED = """h AS (SELECT k, arm, count(*) AS reps, count(*) FILTER (common > 0 AND NOT same) AS hits, bool_or(common > 0 AND NOT same AND rep = 1) AS first_hit FROM m GROUP BY k, arm),
d AS (SELECT a.arm, a.k, a.hits - b.hits AS d, a.first_hit AS x, b.first_hit AS y FROM h a JOIN h b ON a.k = b.k AND b.arm = 'A' AND a.arm <> 'A')"""


def _hits(m: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits of measured runs by item and arm, and each other arm's difference to the base arm on the same items."""
    hit = (F.col("common") > 0) & ~F.col("same")
    h = m.groupBy("k", "arm").agg(F.count(F.lit(1)).alias("reps"), F.count_if(hit).alias("hits"), F.bool_or(hit & (F.col("rep") == 1)).alias("x"))
    h = Scratch(m.sparkSession).write(h)
    base = h.where(F.col("arm") == BASE_ARM).select("k", F.col("hits").alias("base"), F.col("x").alias("y"))
    return h, h.where(F.col("arm") != BASE_ARM).join(large(base), "k").select("arm", "k", (F.col("hits") - F.col("base")).alias("d"), "x", "y")


@query(f"""WITH {_MEASURED}, {_PAIRED}, t AS (SELECT arm, sum(hits)::DOUBLE / sum(reps) AS touch FROM h GROUP BY arm),
q AS (SELECT arm, avg(common::DOUBLE / len(mine)) AS prec, avg(CASE WHEN lines >= len(mine) THEN 1 - list_aggregate(list_transform(range(0, len(mine)), lambda z: (greatest(lines - len(off), 0) - z)::DOUBLE / (lines - z)), 'product') ELSE 1 END) AS chance FROM m WHERE NOT same GROUP BY arm),
g AS (SELECT arm, count(*) FILTER (d > 0) AS better, count(*) FILTER (d < 0) AS worse, count(*) FILTER (x AND NOT y) AS b10, count(*) FILTER (NOT x AND y) AS b01 FROM d GROUP BY arm)
SELECT t.arm, round(touch, 6) AS touch, round(chance, 6) AS chance, round(prec, 6) AS edited_precision, better, worse, b10, b01 FROM t JOIN q USING (arm) LEFT JOIN g USING (arm)""")
def localisation_t6(spark, sf_dir):
    """Touch rate of each arm beside chance, precision of edited lines, and items better or worse than under the base arm."""
    t = Tables(spark, sf_dir)
    m = _measured(t)
    h, d = _hits(m)
    touch = h.groupBy("arm").agg((F.sum("hits") / F.sum("reps")).alias("touch"))
    size, other = F.size("mine"), F.greatest(F.col("lines") - F.size("off"), F.lit(0))
    miss = F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(1.0), lambda acc, z: acc * (other - z) / (F.col("lines") - z))
    q = m.where("not same").groupBy("arm").agg(F.avg(F.col("common") / size).alias("prec"), F.avg(F.when(F.col("lines") >= size, 1 - miss).otherwise(1.0)).alias("chance"))
    x, y = F.col("x"), F.col("y")
    g = d.groupBy("arm").agg(F.count_if(F.col("d") > 0).alias("better"), F.count_if(F.col("d") < 0).alias("worse"), F.count_if(x & ~y).alias("b10"), F.count_if(~x & y).alias("b01"))
    return touch.join(q, "arm").join(g, "arm", "left").select("arm", _r(F.col("touch")).alias("touch"), _r(F.col("chance")).alias("chance"), _r(F.col("prec")).alias("edited_precision"), "better", "worse", "b10", "b01")


@query()
def localisation_tests(spark, sf_dir):
    """Signed-rank test of each arm's hits against the base arm, its effect, Holm's correction, and McNemar on first runs."""
    _, d = _hits(_measured(Tables(spark, sf_dir)))
    w = T.wilcoxon(d, ["arm"], "d").select("arm", F.col("n").alias("nonzero"), _r(F.col("r")).alias("rank_biserial"), F.col("p").alias("p_raw"))
    m = T.mcnemar(d, ["arm"], F.col("x"), F.col("y")).select("arm", F.col("p").alias("mcnemar_p"))
    return W.holm(w.withColumn("family", F.lit("localisation")), ["family"], "p_raw", ["arm"], "p_holm").join(m, "arm").select("arm", "nonzero", "rank_biserial", "p_raw", "p_holm", "mcnemar_p")


@query(f"""WITH {_MEASURED}, e AS (SELECT arm, sum(CASE WHEN same THEN 0 ELSE common END)::DOUBLE AS c, sum(CASE WHEN same THEN 0 ELSE len(mine) END) AS na, sum(len(off)) AS nf FROM m GROUP BY arm)
SELECT arm, round(c / na, 6) AS precision, round(c / nf, 6) AS recall, round(2 * c / (na + nf), 6) AS f1 FROM e""")
def line_evidence(spark, sf_dir):
    """Micro-averaged precision, recall and F1 of changed lines against the fix's; unchanged functions change none."""
    none = F.col("same")
    e = _measured(Tables(spark, sf_dir)).groupBy("arm").agg(
        F.sum(F.when(none, 0).otherwise(F.col("common"))).alias("c"), F.sum(F.when(none, 0).otherwise(F.size("mine"))).alias("na"), F.sum(F.size("off")).alias("nf"))
    precision, recall, f1 = stats.prf(F.col("c"), F.col("na") - F.col("c"), F.col("nf") - F.col("c"))
    return e.select("arm", _r(precision).alias("precision"), _r(recall).alias("recall"), _r(f1).alias("f1"))


def fix_anatomy(rows: DataFrame) -> DataFrame:
    """What the anatomy of any patch needs of the fix. Takes v, f and the script fix."""
    out = rows if J.SIDES[0] in rows.columns else J.with_sides(rows)
    out = out.withColumns({"fr": C.untagged(F.col("__lost")), "fa": C.untagged(F.col("__new")), "off": E.changed_lines(F.col("fix"))})
    return out.withColumns({
        "hunks": E.runs_of(F.col("off")), "fset": F.array_union("fr", "fa"), "fi": C.edit_names(F.col("fa")), "fix_kind": C.edit_kind(F.col("fr"), F.col("fa")),
        "fix_stmts": F.size("fr") + F.size("fa"),
    })


def anatomy_of(rows: DataFrame) -> DataFrame:
    """How a patch relates to the fix: hunks met, kinds of both edits, relation, and shared names. Takes v, f, p, and the scripts fix and own."""
    out = rows if "fix_stmts" in rows.columns else fix_anatomy(rows)
    out = out if J.OWN[0] in out.columns else J.with_own(out)
    out = out.withColumns({"pr": C.untagged(F.col("__lost_p")), "pa": C.untagged(F.col("__new_p")), "mine": E.changed_lines(F.col("own"))})
    out = out.withColumns({"pset": F.array_union("pr", "pa"), "pi": C.edit_names(F.col("pa"))})
    met = F.size(F.filter("hunks", lambda h: F.exists("mine", lambda i: (i >= h["s"] - 1) & (i <= h["e"] + 1))))
    none = F.size(F.array_intersect("fset", "pset")) == 0
    relation = F.when(~none & C.proper_subset(F.col("pset"), F.col("fset")), "incomplete").when(none, "different").otherwise("overlapping")
    names = F.size(F.array_union("fi", "pi"))
    return out.withColumns({
        "n_hunks": F.size("hunks"), "hunks_covered": met, "relation": relation, "patch_kind": C.edit_kind(F.col("pr"), F.col("pa")),
        "var_jaccard": F.when(names > 0, F.round(F.size(F.array_intersect("fi", "pi")) / names, 3)).otherwise(0.0),
        "patch_stmts": F.size("pr") + F.size("pa"),
    })


def dissected(t: Tables) -> DataFrame:
    """Each candidate with its anatomy; all that concerns a function and its fix alone is found once."""
    known = fix_anatomy(E.with_script(J.with_sides(items(t)), "v", "f", "fix"))
    return anatomy_of(J.with_own(E.with_script(candidates(t, known), "v", "p", "own")))


def _kind_sql(rem: str, add: str) -> str:
    skeleton = lambda a: f"list_sort(list_transform({a}, lambda s: regexp_replace(s, '{C.SKELETON}', '', 'g')))"
    no_call = ", ".join(f"'{x}'" for x in C.NO_CALL)
    calls = lambda a: f"list_sort(list_filter(list_distinct(flatten(list_transform({a}, lambda s: regexp_extract_all(s, '\\b([A-Za-z_]\\w*)\\s*\\(', 1)))), lambda c: c NOT IN ({no_call})))"
    guard = f"len(list_filter({add}, lambda s: NOT (regexp_matches(s, '{C.CONTROL}') OR contains(s, 'return')))) = 0"
    return f"CASE WHEN len({rem}) = 0 AND len({add}) > 0 AND {guard} THEN 'guard' WHEN len({rem}) > 0 AND len({add}) > 0 AND {skeleton(rem)} = {skeleton(add)} THEN 'bound' WHEN {calls(rem)} <> {calls(add)} THEN 'call' ELSE 'other' END"


_PLAIN = ", ".join(f"'{x}'" for x in C.PLAIN_NAMES)


def _names_sql(rows: str) -> str:
    return f"list_filter(list_distinct(flatten(list_transform({rows}, lambda s: regexp_extract_all(s, '[A-Za-z_]\\w{{2,}}')))), lambda z: z NOT IN ({_PLAIN}))"


@query(f"""WITH {_CANDIDATES}, {_KNOWN}, a0 AS (SELECT c.*, mine, off, {_stm("v")} AS sv, {_stm("f")} AS sf, {_stm("p")} AS sp FROM c JOIN kn ON kn.t = c.t AND kn.kind = c.kind),
a1 AS (SELECT *, {_minus("sv", "sf")} AS fr, {_minus("sf", "sv")} AS fa, {_minus("sv", "sp")} AS pr, {_minus("sp", "sv")} AS pa FROM a0),
a2 AS (SELECT *, list_distinct(list_concat(fr, fa)) AS fs, list_distinct(list_concat(pr, pa)) AS ps, {_names_sql("fa")} AS fi, {_names_sql("pa")} AS pi,
 CASE WHEN len(off) = 2 THEN [[off[1], off[1]], [off[2], off[2]]] ELSE [[off[1], off[1]]] END AS hs FROM a1)
SELECT k, kind, len(hs)::INT AS n_hunks, len(list_filter(hs, lambda h: len(list_filter(mine, lambda z: z BETWEEN h[1] - 1 AND h[2] + 1)) > 0))::INT AS hunks_covered,
 CASE WHEN len(list_intersect(fs, ps)) = 0 THEN 'different' WHEN len(list_intersect(fs, ps)) = len(ps) AND len(ps) < len(fs) THEN 'incomplete' ELSE 'overlapping' END AS relation,
 {_kind_sql("fr", "fa")} AS fix_kind, {_kind_sql("pr", "pa")} AS patch_kind,
 CASE WHEN len(fi) + len(pi) > 0 THEN round(len(list_intersect(fi, pi))::DOUBLE / len(list_distinct(list_concat(fi, pi))), 3) ELSE 0 END AS var_jaccard, (len(fr) + len(fa))::INT AS fix_stmts, (len(pr) + len(pa))::INT AS patch_stmts FROM a2""")
def anatomy(spark, sf_dir):
    """The anatomy of each candidate beside its fix."""
    return dissected(Tables(spark, sf_dir)).select("k", "kind", "n_hunks", "hunks_covered", "relation", "fix_kind", "patch_kind", "var_jaccard", "fix_stmts", "patch_stmts")


_ISSUES = r"""WITH {c}, x AS (SELECT k, kind, v, p, regexp_replace(regexp_replace(v, '(?s)/\*.*?\*/|//[^\n]*', ' ', 'g'), '\s+', '', 'g') AS bv, regexp_replace(regexp_replace(p, '(?s)/\*.*?\*/|//[^\n]*', ' ', 'g'), '\s+', '', 'g') AS bp,
 regexp_extract(v, '(?s)([A-Za-z_]\w*)\s*\([^;{{]*\)\s*\{{', 1) AS nv, regexp_extract(p, '(?s)([A-Za-z_]\w*)\s*\([^;{{]*\)\s*\{{', 1) AS np FROM c)"""


@query(_ISSUES.format(c=_CANDIDATES.replace(" AS p FROM i", " AS p FROM i")) + r"""
SELECT k, kind, array_to_string(list_filter([CASE WHEN bv = bp THEN 'unchanged' END, CASE WHEN length(p) - length(replace(p, '{', '')) <> length(p) - length(replace(p, '}', '')) THEN 'unbalanced_braces' END,
 CASE WHEN length(p) - length(replace(p, '(', '')) <> length(p) - length(replace(p, ')', '')) THEN 'unbalanced_parentheses' END, CASE WHEN nv <> '' AND np <> nv THEN 'renamed_function' END], lambda z: z IS NOT NULL), ',') AS issues FROM x""")
def static_checks(spark, sf_dir):
    """Checks that need neither headers nor the fix, as feedback on each candidate."""
    return candidates(Tables(spark, sf_dir)).select("k", "kind", F.array_join(C.static_issues(F.col("p"), F.col("v")), ",").alias("issues"))


@query(rf"""WITH {_CANDIDATES}, {_judged("c")}, h AS (SELECT k, kind, list_transform(string_split(p, chr(10)), lambda s: regexp_replace(regexp_replace(s, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) AS hl FROM c)
SELECT k, kind, similarity < 0.9 AS severed, CASE WHEN similarity < 0.9 THEN 0 ELSE least(len(list_filter(tv.sl, lambda s: list_contains(hl, regexp_replace(s, '\s+', ' ', 'g')))), 12) END::INT AS intact FROM j JOIN tv USING (k, kind) JOIN h USING (k, kind)""")
def severance_checks(spark, sf_dir):
    """Whether a candidate leaves the vulnerable slice as it was, and how many of its lines stand unchanged."""
    c = candidates(Tables(spark, sf_dir)).withColumn("severed", C.slice_similarity(F.col("p"), F.col("v")) < C.INTACT)
    return c.select("k", "kind", "severed", F.when(F.col("severed"), 0).otherwise(F.size(C.intact_rows(F.col("p"), F.col("v")))).alias("intact"))


_LADDER = f"""{_CANDIDATES}, {_judged("c")}, {_RUNS}, w AS (SELECT r.*, validated, reason FROM r JOIN j USING (k, kind) WHERE rep <= 5),
e AS (SELECT k, arm, coalesce(min(rep) FILTER (validated), max(rep)) AS iterations, bool_or(validated) AS validated FROM w GROUP BY k, arm)"""


@query(f"WITH {_LADDER} SELECT e.k, e.arm, e.validated, iterations, reason FROM e JOIN w ON e.k = w.k AND e.arm = w.arm AND rep = iterations")
def repair_ladder(spark, sf_dir):
    """A bounded retry loop over each item and arm, replayed with the judge's verdicts."""
    tried = _judged_runs(Tables(spark, sf_dir))
    out = ladder.replay(tried, ["k", "arm"], "rep", F.col("validated"), F.col("reason"))
    return out.select("k", "arm", "validated", F.col("iterations").cast("bigint").alias("iterations"), "reason")


@query(f"WITH {_LADDER} SELECT arm, count(*) AS n, count(*) FILTER (validated) AS k, round(avg(validated::INT), 6) AS vpr, round(coalesce(avg(iterations) FILTER (validated), 5), 6) AS iterations FROM e GROUP BY arm")
def repair_summary(spark, sf_dir):
    """Validated rate and mean attempts of each arm."""
    s = ladder.summary(repair_ladder(spark, sf_dir), ["arm"])
    return s.select("arm", "n", "k", _r(F.col("vpr")).alias("vpr"), _r(F.col("iterations")).alias("iterations"))


#: Another branch's copy of each function: with other indents, and with the changed statement written otherwise.
_BRANCHES = {"indented": tuple(v.replace("    ", "  ") for v, _ in FUNCTIONS), "diverged": tuple(v.replace("int used = len", "int used = 0").replace("i <= n", "i < n + 1").replace("strcpy(tmp, name)", "copy(tmp, name)").replace("free(q)", "drop(q)") for v, _ in FUNCTIONS)}
_PORTED = tuple(f.replace("    ", "  ") for _, f in FUNCTIONS)


def ports(t: Tables) -> DataFrame:
    """Each item's fix applied by context to the copies of two other branches."""
    made = F.array(*(F.struct(F.lit(b).alias("branch"), _filled(x).alias("target")) for b, x in _BRANCHES.items()))
    return items(t).select("k", "n", "t", "v", "f", F.inline(made)).withColumn("port", D.apply_patch_udf("v", "f", "target"))


@query(f"""WITH {_ITEMS} SELECT k, branch, branch = 'indented' AS applied, branch = 'indented' AS covers FROM i, (VALUES ('indented'), ('diverged')) b(branch)""")
def naive_patch(spark, sf_dir):
    """Whether a fix applies to another branch's copy, and whether what comes out covers the fix's changes."""
    done = J.judge(ports(Tables(spark, sf_dir)).withColumn("p", F.coalesce("port.text", F.lit(""))), "target", "f", "p")
    return done.select("k", "branch", F.col("port.applied").alias("applied"), F.col("validated").alias("covers"))


@query(f"""WITH {_CANDIDATES}, q0 AS (SELECT k, kind, {_stm("v")} AS sv, {_stm("f")} AS sf, {_stm("p")} AS sp FROM c), q AS (SELECT kind, len({_minus("sv", "sf")}) + len({_minus("sf", "sv")}) AS want,
 len({_minus(_minus("sv", "sf"), _minus("sv", "sp"))}) + len({_minus(_minus("sf", "sv"), _minus("sp", "sv"))}) AS missed FROM q0)
SELECT CASE WHEN missed = 0 THEN 'faithful' WHEN missed < want THEN 'omitting' ELSE 'unrelated' END AS split, kind, count(*) AS units FROM q GROUP BY ALL""")
def port_split(spark, sf_dir):
    """Ports that make all of the fix's statement changes, some, or none."""
    c = candidates(Tables(spark, sf_dir)).select("kind", C.statements(F.col("v")).alias("sv"), C.statements(F.col("f")).alias("sf"), C.statements(F.col("p")).alias("sp"))
    lost, new = C.minus(F.col("sv"), F.col("sf")), C.minus(F.col("sf"), F.col("sv"))
    c = c.withColumns({"lost": lost, "new": new, "lost_p": C.minus(F.col("sv"), F.col("sp")), "new_p": C.minus(F.col("sp"), F.col("sv"))})
    missed = F.size(C.minus(F.col("lost"), F.col("lost_p"))) + F.size(C.minus(F.col("new"), F.col("new_p")))
    split = F.when(missed == 0, "faithful").when(missed < F.size("lost") + F.size("new"), "omitting").otherwise("unrelated")
    return c.groupBy(split.alias("split"), "kind").agg(F.count(F.lit(1)).alias("units"))
