"""Replies and profiles as texts: verdict parsers, fenced blocks, slice profiles and the questions put to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import code as C
from assayer.functions import text as X
from assayer.jobs.base import Tables, query

#: Replies by kind; {k} is the event.
REPLIES = (
    "It copies {k} bytes.\nANSWER: SAFE\nOn reflection:\nAnswer: ** vulnerable **",
    "SAFE, though a vulnerable callee {k} is near",
    "  **Vulnerable**: no bound on {k}",
    "This is not vulnerable at {k}.",
    'Verdict {"label": "Wrong-Place ", "reason": "line {k}"} as asked',
    "```c\nint f() { return {k}; }\n```\nor\n```cpp\n\nint g() {\n  return {k};\n}\n```\nANSWER: B",
    "B) the second one, {k}",
    "",
)
LABELS = ("wrong_place", "right_place", "correct")


def replies(t: Tables) -> DataFrame:
    """A reply of one of the kinds for each event."""
    kind = F.element_at(F.array(*map(F.lit, REPLIES)), ((F.col("event_id") + F.col("user_id")) % len(REPLIES) + 1).cast("int"))
    return t.events.select("event_id", F.replace(kind, F.lit("{k}"), F.col("event_id").cast("string")).alias("text"))


_REPLIES = "x AS (SELECT event_id, replace(([{}])[(event_id + user_id) % {} + 1], '{{k}}', event_id::VARCHAR) AS text FROM events)".format(", ".join(f"'{r}'" for r in REPLIES), len(REPLIES))


@query(rf"""WITH {_REPLIES}, u AS (SELECT *, upper(text) AS up, right(upper(text), 200) AS tail, upper(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS s FROM x),
m AS (SELECT *, regexp_extract_all(up, 'ANSWER:\s*\**\s*(VULNERABLE|SAFE)', 1) AS a, regexp_extract_all(up, 'ANSWER:\s*\**\s*([AB])', 1) AS c, regexp_extract(s, '^\W*(VULNERABLE|SAFE)\b', 1) AS w,
 replace(replace(lower(trim(regexp_extract(text, '"label": "([^"]*)"', 1))), '-', '_'), ' ', '_') AS l FROM u),
n AS (SELECT *, CASE WHEN len(a) > 0 THEN a[-1] = 'VULNERABLE' ELSE contains(tail, 'VULNERABLE') AND NOT contains(tail, 'NOT VULNERABLE') END::INT AS last FROM m)
SELECT event_id, last AS last_answer, CASE WHEN w <> '' THEN (w = 'VULNERABLE')::INT ELSE last END AS first_answer,
 CASE WHEN len(c) > 0 THEN c[-1] WHEN left(s, 1) IN ('A', 'B', '') THEN left(s, 1) WHEN contains(left(s, 5), 'A') THEN 'A' ELSE 'B' END AS choice, CASE WHEN l IN ('wrong_place', 'right_place', 'correct') THEN l ELSE 'incorrect' END AS label FROM n""")
def answers(spark, sf_dir):
    """Verdicts read from replies in four ways."""
    text = F.col("text")
    return replies(Tables(spark, sf_dir)).select(
        "event_id", C.last_answer(text).alias("last_answer"), C.first_answer(text).alias("first_answer"), C.choice_answer(text).alias("choice"), C.json_label(text, LABELS, "incorrect").alias("label"))


@query(rf"""WITH {_REPLIES}, b AS (SELECT event_id, regexp_extract_all(text, '(?s)```(?:c|C|cpp)?\s*\n(.*?)```', 1) AS b FROM x)
SELECT event_id, len(b)::INT AS blocks, md5(coalesce(regexp_replace(list_reduce(b, lambda p, q: CASE WHEN length(q) > length(p) THEN q ELSE p END), '^\n+|\n+$', '', 'g'), '')) AS longest FROM (SELECT event_id, CASE WHEN len(b) > 0 THEN b END AS b FROM b)
""".replace("len(b)::INT AS blocks", "coalesce(len(b), 0)::INT AS blocks"))
def fenced_blocks(spark, sf_dir):
    """The longest fenced code block of each reply."""
    blocks = F.regexp_extract_all("text", F.lit(r"(?s)```(?:c|C|cpp)?\s*\n(.*?)```"), F.lit(1))
    return replies(Tables(spark, sf_dir)).select("event_id", F.size(blocks).alias("blocks"), F.md5(C.longest_fence(F.col("text"))).alias("longest"))


# A run with braces that match, at most two deep, and commas that such a run follows up to the end.
_MATCHED = r"(?:[^{}]|\{(?:[^{}]|\{[^{}]*+\})*+\})*+"
_OUTER, _MARK, _SHORT = rf",(?={_MATCHED}\z)", "\x01", 300


def split_top(text: Column) -> Column:
    """The parts between commas that stand outside braces, with blanks trimmed.

    Short texts whose braces match and are at most two deep, as profiles are, are cut by a pattern; others step by step.
    """
    plain = lambda t: (F.length(t) <= _SHORT) & ~t.contains(_MARK) & t.rlike(rf"\A{_MATCHED}\z")
    cut = lambda t: F.transform(F.split(F.regexp_replace(t, _OUTER, _MARK), _MARK), lambda s: F.trim(s))
    return X.let(text, lambda t: F.when(plain(t), cut(t)).otherwise(_stepwise(t)))


def _stepwise(text: Column) -> Column:
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("one"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        cut = (c == ",") & (acc["depth"] == 0)
        depth = acc["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.when(cut, "").otherwise(F.concat(acc["one"], c)).alias("one"), F.when(cut, F.concat(acc["out"], F.array(F.trim(acc["one"])))).otherwise(acc["out"]).alias("out"))

    # Runs of other characters are taken whole, so that only braces and commas are steps.
    marks = F.regexp_extract_all(text, F.lit(r"[{},]|[^{},]+"), F.lit(0))
    end = F.aggregate(marks, start, step)
    return F.concat(end["out"], F.array(F.trim(end["one"])))


def profiles_of(lines: Column) -> Column:
    """Struct of the variable, definition and use lines, dependent variables, pointers and called functions of a profile line.

    Fields stand between commas: file, function, variable, then def{..}, use{..}, dvars{..}, pointers{..}, cfuncs{name{n},..}.
    """

    def parsed(parts: Column) -> Column:
        def field(*heads: str) -> Column:
            found = F.element_at(F.filter(F.slice(parts, 4, 100), lambda f: F.exists(F.array(*map(F.lit, heads)), lambda h: f.startswith(h))), -1)
            return F.coalesce(X.let(F.regexp_extract(found, r"(?s)\{(.*)\}", 1), lambda body: F.filter(split_top(body), lambda x: x != "")), F.array().cast("array<string>"))

        def numbers(rows: Column) -> Column:
            return F.transform(F.filter(rows, lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("int"))

        return F.when((F.size(parts) >= 4) & lines.contains("{"), F.struct(
            F.get(parts, 2).alias("variable"), numbers(field("def")).alias("defs"), numbers(field("use")).alias("uses"), field("dvars").alias("dvars"),
            field("pointers", "ptrs").alias("ptrs"), F.transform(field("cfuncs"), lambda x: F.regexp_extract(x, r"^[^{]*", 0)).alias("cfuncs")))

    return X.let(split_top(lines), parsed)


def profiles(t: Tables) -> DataFrame:
    """A profile line for each order line: order as function, line number as variable."""
    text = F.concat(
        F.lit("f.c,f"), F.col("l_orderkey").cast("string"), F.lit(",v"), F.col("l_linenumber").cast("string"), F.lit(",def{"), F.col("l_linenumber").cast("string"), F.lit(",x},use{"), (F.col("l_linenumber") + F.col("l_suppkey") % 5).cast("string"), F.lit(","),
        (F.col("l_partkey") % 9).cast("string"), F.lit("},dvars{"), F.when(F.col("l_returnflag") == "R", F.concat(F.lit("v"), (F.col("l_linenumber") + 1).cast("string"), F.lit(", w"))).otherwise(F.lit("")),
        F.lit("},pointers{"), F.when(F.col("l_linestatus") == "O", F.lit("p")).otherwise(F.lit("")), F.lit("},cfuncs{g{1},h{2}}"))
    return t.lineitem.select("l_orderkey", "l_linenumber", text.alias("line"))


_PROFILE = """p AS (SELECT l_orderkey, l_linenumber, 'v' || l_linenumber AS variable, [l_linenumber::INT] AS defs, [(l_linenumber + l_suppkey % 5)::INT, (l_partkey % 9)::INT] AS uses,
 CASE WHEN l_returnflag = 'R' THEN ['v' || (l_linenumber + 1), 'w'] ELSE [] END AS dvars, CASE WHEN l_linestatus = 'O' THEN ['p'] ELSE [] END AS ptrs, ['g', 'h'] AS cfuncs FROM lineitem)"""


def _parsed(t: Tables) -> DataFrame:
    parsed = profiles(t).select("l_orderkey", "l_linenumber", F.explode(F.array(profiles_of(F.col("line")))).alias("p"))
    return parsed.select("l_orderkey", "l_linenumber", "p.*")


@query(f"""WITH {_PROFILE} SELECT l_orderkey, l_linenumber, variable, array_to_string(defs, ',') AS defs, array_to_string(uses, ',') AS uses, array_to_string(dvars, ',') AS dvars, array_to_string(ptrs, ',') AS ptrs, array_to_string(cfuncs, ',') AS cfuncs FROM p""")
def slice_profiles(spark, sf_dir):
    """Profile lines parsed with regard to nested braces."""
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return _parsed(Tables(spark, sf_dir)).select("l_orderkey", "l_linenumber", "variable", *map(text, ("defs", "uses", "dvars", "ptrs", "cfuncs")))


def vectors(t: Tables) -> DataFrame:
    """Four ratios of each variable's profile to its function's number of lines: size, coverage, links and span."""
    m = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("double").alias("m"))
    p = _parsed(t).join(m, "l_orderkey")
    d, q, c = (F.size(x).cast("double") for x in ("dvars", "ptrs", "cfuncs"))
    span = F.abs(F.coalesce(F.array_max("uses"), F.lit(0)) - F.coalesce(F.array_min("defs"), F.lit(0)))
    return p.select("l_orderkey", "l_linenumber", "variable", ((1 + d + q) / F.col("m")).alias("sc"), (F.size(F.array_union("defs", "uses")) / F.col("m")).alias("scvg"), ((d + q + c) / F.col("m")).alias("si"), (span / F.col("m")).alias("ss"))


_VECTOR = f"""{_PROFILE}, m AS (SELECT l_orderkey, count(*)::DOUBLE AS m FROM lineitem GROUP BY 1),
vec AS (SELECT l_orderkey, l_linenumber, variable, (1 + len(dvars) + len(ptrs)) / m AS sc, len(list_distinct(list_concat(defs, uses))) / m AS scvg, (len(dvars) + len(ptrs) + len(cfuncs)) / m AS si, abs(list_max(uses) - list_min(defs)) / m AS ss FROM p JOIN m USING (l_orderkey))"""


@query(f"WITH {_VECTOR} SELECT l_orderkey, l_linenumber, round(sc, 6) AS sc, round(scvg, 6) AS scvg, round(si, 6) AS si, round(ss, 6) AS ss FROM vec")
def slice_vector(spark, sf_dir):
    """The vector of each variable's slice profile."""
    return vectors(Tables(spark, sf_dir)).select("l_orderkey", "l_linenumber", *(F.round(c, 6).alias(c) for c in ("sc", "scvg", "si", "ss")))
