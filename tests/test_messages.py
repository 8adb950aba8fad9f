"""Messages, links and embeddings against plain Python."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from assayer.functions import text as X
from assayer.jobs import detectors, messages


#: A line, whether it stays, and what it counts as if it goes; ``intlimit=3`` is the only added statement of eight characters.
LINES = [
    ("Fix a bound", True, None), ("  kept, stripped  ", True, None), ("Signed-off-by: me", False, "trailer"), ("Bug 12: x", True, None), ("bug: 12", False, "trailer"), ("cc=you", False, "trailer"),
    ("See: https://x.y", False, "trailer"), ("by: a@b", False, "trailer"), ("+ new", False, "code"), ("-old", False, "code"), ("@@ 1", False, "code"), ("```", False, "code"), ("index 12", False, "code"),
    ("x;", False, "code"), ("{", False, "code"), ("int limit = 3", False, "leak"), ("int limit = 4", True, None), ("tiny", True, None), ("(cherry picked from", False, "trailer"), ("[1.2.3]", False, "trailer"),
    ("Merged from x", False, "trailer"), ("Merged by x", True, None),
]
#: Whole messages with what comes out, the counts of code, leaks and trailers, and whether it was cut.
MESSAGES = [
    ("", "", 0, 0, 0, False), ("\r\n a\r\n", "a", 0, 0, 0, False), ("a\n\n\n\n\nb", "a\n\nb", 0, 0, 0, False), ("a\nx;\n\nb", "a\n\nb", 1, 0, 0, False),
    ("Fix it\n\nint limit = 3\n+ int limit = 3\nCc: x\nReviewed-by: y", "Fix it", 1, 1, 2, False),
    ("x" * 90, "x" * 60 + " [...]", 0, 0, 0, True), ("word " * 20, "word " * 11 + "word [...]", 0, 0, 0, True), ("y" * 60, "y" * 60, 0, 0, 0, False),
]


def test_clean_message(spark):
    added = F.array(F.lit("intlimit=3"), F.lit("tiny"))
    single = [(f"first\n{line}\nlast", f"first\n{line.strip()}\nlast" if stays else "first\nlast", kind == "code", kind == "leak", kind == "trailer", False) for line, stays, kind in LINES]
    cases = {text: out for text, *out in [*MESSAGES, *single]}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", X.clean_message(F.col("t"), added, 60).alias("m"))
    for r in df.collect():
        assert list(r.m) == cases[r.t], r.t


def test_links(spark):
    want = [("github", "ann/lib", "0123abc7"), ("github", "ann/lib", "0123456789abcdef"), ("gsource", "platform/x", None), ("gitlab", "two/two", None), None, ("github", "mirror/tool", None), None, None]
    links = [x.replace("{k}", "7") for x in messages.LINKS]
    df = spark.createDataFrame([(x,) for x in links], "l string").select("l", X.resolve_link(F.col("l"), messages.FORGES, messages.MIRRORS).alias("r"))
    got = {r.l: r.r for r in df.collect()}
    for link, w in zip(links, want):
        assert (got[link] is None) == (w is None)
        if w:
            assert (got[link].kind, got[link].repo) == w[:2] and got[link].sha == (w[2] or "0123456789abcdef0123456789abcdef01234567")


def test_embedding(spark):
    text = "Été_1, a-b\nlong words; x"
    toks = re.findall(r"\w+", text.lower())
    clean = "".join(toks)
    grams = toks + [f"{a}~{b}" for a, b in zip(toks, toks[1:])] + [clean[i : i + 4] for i in range(max(0, len(clean) - 3))]
    vec = [0.0] * 256
    for g in grams:
        h = int(hashlib.md5(("42" + g).encode()).hexdigest(), 16)
        vec[h % 256] += 1 if h >> 8 & 1 else -1
    norm = math.sqrt(sum(x * x for x in vec))

    class T:
        conversations = spark.createDataFrame([(1, 0, text), (2, 0, ""), (3, 0, "a")], "conv_id long, turn long, text string")

    got = messages.embeddings(T).collect()
    assert {r.slot: pytest.approx(r.w) for r in got if r.conv_id == 1} == {k: x / norm for k, x in enumerate(vec) if x}
    assert not [r for r in got if r.conv_id == 2] and [abs(r.w) for r in got if r.conv_id == 3] == [1.0]


def plain_word_grams(text):
    out = []
    for w in text.lower().split():
        w = f" {w} "
        for n in (3, 4, 5):
            at = 0
            out.append(w[:n])
            while at + n < len(w):
                at += 1
                out.append(w[at : at + n])
            if at == 0:
                break
    return out


def test_word_grams(spark):
    texts = ["a", "ab abc", "Abcd abcdef\n x", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", detectors.word_grams(F.col("t")).alias("g"))
    assert {r.t: sorted(r.g) for r in df.collect()} == {t: sorted(plain_word_grams(t)) for t in texts}


def test_logistic_head_on_held_out_labels(spark):
    rows = detectors.logistic_head(spark, "/root/testdata/sf0.01").collect()
    assert sum(r.label == r.predicted for r in rows) / len(rows) > 0.8 and len({r.predicted for r in rows}) == 2
