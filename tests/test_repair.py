"""Patches, the judge, variants and replies against plain Python."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assayer.functions import code as C
from assayer.functions import variants as V
from assayer.jobs import answers, repair
from assayer.jobs.base import Tables
from assayer.jobs.variants import variants
from assayer.operators import edits as E
from assayer.operators import judge

SF = "/root/testdata/sf0.001"
IDLE = ["\t" + s for s in V.IDLE]


def plain_statements(text):
    rows = [re.sub(r"\s+", "", re.sub(r"//.*", "", s)) for s in re.sub(r"/\*.*?\*/", " ", text, flags=re.S).splitlines()]
    return [s for s in rows if s not in ("", "{", "}", "};")]


def plain_verdict(v, f, p):
    sv, sf, sp = map(plain_statements, (v, f, p))
    cv, cf, cp = map(Counter, (sv, sf, sp))
    depth, fine = 0, "{" in p
    for c in p:
        depth += (c == "{") - (c == "}")
        fine = fine and depth >= 0
    if cv == cp:
        return "unchanged"
    if not fine or depth:
        return "unbalanced_braces"
    if sp == sf:
        return "equivalent_to_official_fix"
    covers = not ((cv - cf) - (cv - cp)) and not ((cf - cv) - (cp - cv))
    return "covers_official_fix_changes" if covers else "missing_official_fix_changes"


def random_functions(n):
    rng = random.Random(11)
    pool = ["  a = b;", "  if (a) return 1; // why", "  strcpy(a, b);", "  /* c */ a = b;", "  {", "  }", "  };", "  x[ i ] = y;", "", "  return  a;", "  a = b; /* long"]
    return ["\n".join(["int f() {", *(rng.choice(pool) for _ in range(rng.randint(0, 7))), "}"]) for _ in range(n)]


def test_judge_by_plain_multisets(spark):
    texts = random_functions(360)
    rows = [tuple(texts[k : k + 3]) for k in range(0, 360, 3)]
    rows += [(v, f, f) for v, f, _ in rows] + [(v, f, v) for v, f, _ in rows] + [(v, f, f.replace("{\n", "{\n  more();\n", 1)) for v, f, _ in rows] + [("", "", ""), ("a;", "b;", "b;")]
    got = [(r.v, r.f, r.p, r.reason, r.validated) for r in judge.judge(spark.createDataFrame(rows, "v string, f string, p string")).collect()]
    seen = Counter()
    for v, f, p, reason, validated in got:
        assert reason == plain_verdict(v, f, p)
        assert validated == (reason in (judge.EXACT, judge.COVERS))
        seen[reason] += 1
    assert len(got) == len(rows) and set(seen) == set(judge.REASONS)


def test_slices_by_plain_python(spark):
    rows = random_functions(60) + ["no sink here\nx = 1\nx y\nz", "nothing", "", "gets(q)\r\nq\r\nz\n"]
    got = {r.t: list(r.s) for r in spark.createDataFrame([(t,) for t in rows], "t string").select("t", C.slice_rows(F.col("t")).alias("s")).collect()}
    for t in rows:
        lines = [s.strip() for s in t.splitlines() if s.strip()]
        start = [s for s in lines if re.search(C.SINK, s)] or [s for s in lines if "=" in s or "(" in s]
        names = {n for s in start for n in re.findall(r"[A-Za-z_][A-Za-z0-9_]*", s)}
        assert got[t] == [s for s in lines if s in start or names & set(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", s))]
        assert V.slice_set(t) == {" ".join(s.split()) for s in got[t]}


def test_anatomy_by_hand(spark):
    v, f = repair.FUNCTIONS[3]
    rows = spark.createDataFrame([(k, v, f, repair.CANDIDATES[kind][3]) for k, kind in enumerate(("partial", "other", "extra"))], "k int, v string, f string, p string")
    a, b, c = repair.anatomy_of(E.with_script(E.with_script(rows, "v", "f", "fix"), "v", "p", "own")).orderBy("k").collect()
    assert (a.n_hunks, a.hunks_covered, a.relation, a.fix_stmts, a.patch_stmts) == (2, 1, "incomplete", 2, 1)
    assert (a.fix_kind, a.patch_kind) == ("other", "guard") and (b.relation, b.patch_kind, b.var_jaccard) == ("different", "bound", 0.0)
    assert (c.hunks_covered, c.relation) == (2, "overlapping")


def test_hunks(spark):
    cases = {(): [], (4,): [(4, 4)], (1, 2, 4, 7, 9, 12): [(1, 4), (7, 9), (12, 12)]}
    df = spark.createDataFrame([(list(k),) for k in cases], "x array<int>").select("x", E.runs_of(F.col("x")).alias("h"))
    assert {tuple(r.x): [tuple(h) for h in r.h] for r in df.collect()} == cases


def test_feedback(spark):
    v = "int f(char *a) {\n  gets(a);\n  return a[0];\n}"
    cases = {"": ["no_code_block"], v + " // same": ["unchanged"], v[:-1]: ["unbalanced_braces"], v.replace("f(", "g("): ["renamed_function"], v.replace("gets(a)", "gets(a"): ["unbalanced_parentheses"], v.replace("gets", "fgets"): []}
    rows = spark.createDataFrame([(p, v) for p in cases], "p string, v string").select("p", C.static_issues(F.col("p"), F.col("v")).alias("i"), C.intact_rows(F.col("p"), F.col("v")).alias("rows"))
    got = {r.p: (list(r.i), list(r.rows)) for r in rows.collect()}
    assert {p: i for p, (i, _) in got.items()} == cases
    assert got[v.replace("gets", "fgets")][1] == ["int f(char *a) {", "return a[0];"] and len(got[v + " // same"][1]) == 3


def test_replies(spark):
    cases = {
        "ANSWER: SAFE\nanswer: ** vulnerable": (1, 1), "SAFE. ANSWER: VULNERABLE": (1, 0), "not vulnerable": (0, 0), "it is vulnerable": (1, 1), "**Vulnerable** no": (1, 1),
        "vulnerable" + "x" * 200: (0, 0), "SAFELY vulnerable": (1, 1), "": (0, 0),
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", C.last_answer(F.col("t")).alias("a"), C.first_answer(F.col("t")).alias("b"))
    assert {r.t: (r.a, r.b) for r in df.collect()} == cases
    choices = {"ANSWER: a\nAnswer: **B": "B", "Both": "B", "c A": "A", "zzzzzzA": "B", "": "", " a": "A"}
    df = spark.createDataFrame([(t,) for t in choices], "t string").select("t", C.choice_answer(F.col("t")).alias("c"))
    assert {r.t: r.c for r in df.collect()} == choices
    labels = {'x {"label": "Right place"} y': "right_place", '{"label": 3}': "incorrect", "{broken": "incorrect", "": "incorrect"}
    df = spark.createDataFrame([(t,) for t in labels], "t string").select("t", C.json_label(F.col("t"), answers.LABELS, "incorrect").alias("c"))
    assert {r.t: r.c for r in df.collect()} == labels


def test_variants_keep_their_slices(spark):
    """Names are changed as a whole and come back, and idle statements leave the slice as it was."""
    rows = variants(Tables(spark, SF)).collect()
    assert all(r.certified and r.accepted for r in rows) and {r.renamed > 0 for r in rows} == {True}
    assert any(set(r.b.splitlines()) & set(IDLE) for r in rows)
    for r in rows:
        assert r.b != r.v and [s.strip() for s in r.undone.splitlines() if s not in IDLE] == [s.strip() for s in r.v.splitlines()]


def test_a_variant_that_changes_its_slice_is_not_certified(spark):
    canonical = C.slice_tokens(F.col("t"))
    a, b = (set(r.s) for r in spark.createDataFrame([("f(a)\nb = c",), ("f(a)\nb = c\ng = c",)], "t string").select(canonical.alias("s")).collect())
    assert a != b


def test_names_outside_literals():
    code = 'int f(char *p, int n) {\n  struct s *q = p->n;\n  puts("n p"); // n\n  q.n = n; MAXX = n;\n  /* p */ return n;\n}'
    assert V.locals_of(code) == ["p", "q"]
    out, names = V.variant(code, 5)
    assert '"n p"' in out and "// n" in out and "/* p */" in out and "->n" in out and "return n;" in out
    assert [s.strip() for s in V.renamed(out, names).splitlines() if s not in IDLE] == [s.strip() for s in code.splitlines()]
    assert V.variant(None, 1) == ("", {}) and V.variant("", 1) == ("", {})


@pytest.mark.parametrize("text,parts", [("a, b{c,d{e}},f", ["a", "b{c,d{e}}", "f"]), ("", [""]), ("{a,b},", ["{a,b}", ""])])
def test_split_top(spark, text, parts):
    assert spark.range(1).select(answers.split_top(F.lit(text))).first()[0] == parts


def test_artifacts_replace_their_manifest_row(spark, tmp_path):
    from assayer.jobs.variants import build_artifacts

    folder = str(tmp_path)
    spark.createDataFrame([("variants", 1, "old"), ("other", 2, "kept")], "name string, rows bigint, sha256 string").write.parquet(f"{folder}/manifest")
    build_artifacts(spark, SF, folder)
    got = {r.name: (r.rows, r.sha256) for r in spark.read.parquet(f"{folder}/manifest").collect()}
    assert got["other"] == (2, "kept") and got["variants"][0] == spark.read.json(f"{folder}/variants").count() > 100
    build_artifacts(spark, SF, folder)
    assert {r.name: (r.rows, r.sha256) for r in spark.read.parquet(f"{folder}/manifest").collect()} == got
    assert build_artifacts(spark, SF, f"{folder}/new").count() == 1
