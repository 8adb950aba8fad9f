"""The manifest, the exact search and the alignment against plain Python, on odd, repeated and empty tables."""

import hashlib
import math
import random
import sys

import numpy as np
import oracle
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from assayer.llm import align, merkle, topk
from assayer.llm.queries import QUERIES

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return h(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in FIELDS))


def plain_tree(nodes):
    """The root, and for each node its siblings level by level as (left, right)."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, place in enumerate(at):
            run = nodes[place // 8 * 8 : place // 8 * 8 + 8]
            ways[k].append(("".join(run[: place % 8]), "".join(run[place % 8 + 1 :])))
        nodes, at = [h(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)], [place // 8 for place in at]
    return nodes[0], ways


def plain_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    root, ups = plain_tree([trees[g][0] for g in order])
    return sorted(
        (str(x[3]["doc_id"]), x[2], trees[g][0], root, way + up)
        for g, up in zip(order, ups) for x, way in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1])
    )


def manifest(spark, rows):
    found = merkle.prove(spark.createDataFrame(rows, DOCS), FIELDS)
    kept = found.withColumn("again", merkle.fold(F.col("leaf"), F.col("proof"))).collect()
    assert all(r.again == r.root for r in kept)
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, [tuple(s) for s in r.proof]) for r in kept)


@pytest.mark.parametrize("n, langs", [(1, ["en"]), (8, ["en"]), (9, ["en"]), (65, [None]), (30, ["b", "a", "ä", None, ""]), (700, ["en"] * 40 + [f"l{k}" for k in range(20)])])
def test_manifest(spark, n, langs):
    draw = random.Random(n)
    rows = [(k * 7 % 1000, draw.choice(["Ab", "", None, "é\n"]), draw.choice(langs), None, k, "x", 1) for k in range(n)]
    assert manifest(spark, rows) == plain_manifest([dict(zip((c.split()[0] for c in DOCS.split(", ")), r)) for r in rows])


def test_manifest_with_repeated_rows_and_null_ids(spark):
    rows = [(None, None, None, None, None, "x", 1)] * 20 + [(1, "same", "en", "s", 4, "x", 1)] * 11 + [(1, "other", "en", "s", 4, "x", 1), (None, "t", "en", "s", 4, "x", 1)]
    assert manifest(spark, rows) == plain_manifest([dict(zip((c.split()[0] for c in DOCS.split(", ")), r)) for r in rows])


def test_empty_manifest(spark):
    assert merkle.prove(spark.createDataFrame([], DOCS), FIELDS, carry={"n": F.col("n_chars")}).dtypes[-1] == ("n", "bigint")
    assert merkle.prove(spark.createDataFrame([], DOCS), FIELDS).count() == 0


def test_tampering_shows(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{oracle.SF}/documents.parquet").collect()}
    import zlib

    for r in QUERIES["op11_merkle_manifest"](spark, oracle.SF).collect():
        changed = any("A" <= c <= "Z" for c in docs[r.doc_id].text or "") and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
        assert r.verified == (not changed) and (r.folded_root == r.root) == r.verified


def plain_search(rows, k):
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, w) in enumerate(fine):
        if q % 50 == 0:
            scores = ((min(max(sum(a * b for a, b in zip(w, x)), -(2**63)), 2**63 - 1), i) for k2, (i, x) in enumerate(fine) if k2 != at)
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:k])]
    return sorted(out)


def searched(spark, rows, k=5):
    found = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int, rank string"), F.col("vec_id") % 50 == 0, k)
    return sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect())


def test_search(spark):
    draw = np.random.default_rng(3)
    rows = [(k, [float(x) for x in draw.choice([0.0, -0.001, 0.5, -1.25, 0.3], 6)], 1, "x") for k in range(400)]
    rows += [(450, None, 1, "x"), (500, [1.0, None], 1, "x"), (550, [float("nan"), 1.0], 1, "x"), (600, [float("inf")], 1, "x"), (None, [9.0] * 6, 1, "x")]
    rows += [(650, [], 1, "x"), (700, [1.0], 1, "x"), (50, [1.0] * 8, 1, "x"), (50, [1.0] * 8, 1, "x"), (-50, [-1.0] * 6, 1, "x")]
    assert searched(spark, rows) == plain_search([r[:2] for r in rows], 5)
    assert searched(spark, rows, 1000) == plain_search([r[:2] for r in rows], 1000)


def test_search_of_wide_numbers_and_few_rows(spark):
    rows = [(0, [1e16, 3.0], 1, "x"), (1, [1e15, -2.0], 1, "x"), (2, [1e300, 1.0], 1, "x"), (50, [-1e300, 0.1], 1, "x"), (3, [0.25, 7.0], 1, "x")]
    assert searched(spark, rows) == plain_search([r[:2] for r in rows], 5)
    assert searched(spark, rows[:1]) == [] and searched(spark, []) == []


def test_blocks_are_merged(spark, monkeypatch):
    draw = np.random.default_rng(5)
    rows = [(k, [float(x) for x in draw.normal(size=4)]) for k in range(300)]
    monkeypatch.setattr(topk, "BLOCK", 7)
    monkeypatch.setattr(topk, "TOGETHER", 2)
    group = [topk.Postings(*(np.array([r[0] for r in part]) for _ in range(2)), np.floor(256 * np.array([r[1] for r in part])).astype(np.int64)) for part in (rows[k : k + 7] for k in range(0, 300, 7))]
    import pyarrow as pa

    asked = [r for r in rows if r[0] % 50 == 0]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in asked]), pa.array([r[0] for r in asked]), pa.array([[float(math.floor(256 * x)) for x in r[1]] for r in asked])], names=["row", "id", "w"])
    got = [tuple(r.values())[1:] for b in topk._answers(group, batch, 5) for r in b.to_pylist()]
    assert sorted(got) == sorted((q, v, s) for q, _, v, s in plain_search(rows, 5))


def plain_alignment(texts):
    """By sets of ends, with the tokenizers called one text at a time."""
    sys.path.insert(0, "/opt/tokenizers")
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    coder, each, counts = align.coder(align.FOLDER), [], {}
    for t in texts:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        whole = (" " + t).encode() if t else b""
        if b"".join(coder.a_bytes[i] for i in x) != whole or b"".join(coder.b_bytes[i] for i in y) != whole:
            x, y = [], []
        ends = []
        for ids, known in ((x, coder.a_bytes), (y, coder.b_bytes)):
            at, own = 0, {}
            for k, i in enumerate(ids):
                at += len(known[i])
                own[at] = k
            ends.append(own)
        shared = sorted(set(ends[0]) & set(ends[1]))
        links = [(x[ends[0][e]], y[ends[1][e]]) for e in shared]
        groups, i, j = [], 0, 0
        for e in shared:
            p, q = ends[0][e] + 1, ends[1][e] + 1
            groups.append(",".join(map(str, x[i:p])) + "|" + ",".join(map(str, y[j:q])))
            i, j = p, q
        for link in links:
            counts[link] = counts.get(link, 0) + 1
        each.append((len(x), len(y), len(groups), links, h(";".join(groups)) if x else ""))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(n, m, g, len(links), sum(counts[s] == best[s[1]] for s in links), sum(counts[s] for s in links), d) for n, m, g, links, d in each]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{oracle.SF}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_token_alignment"](spark, oracle.SF).collect()}
    assert got == dict(zip(texts, plain_alignment([t or "" for t in texts.values()])))


ODD = [None, "", " ", "  a  b", "▁", "a▁b", "<|endoftext|> <s> </s> <0x41>", "naïve café 漢字 👩‍👩‍👧", "ﬁ ①", "\t\n\r\n x", "\x00\x01", "é", "a" * 5000, "word " * 3000, "x", "x", "İstanbul ſ K", "…………", "12345 3.14e-7 --== {}"]


def test_odd_texts(spark):
    docs = spark.createDataFrame([(k, t, 1, "p") for k, t in enumerate(ODD)] + [(None, "null id", 1, "p")], "doc_id long, text string, n_a int, pairs string")
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in align.align_corpus(docs).collect()}
    assert got == dict(zip([*range(len(ODD)), None], plain_alignment([*(t or "" for t in ODD), "null id"])))
    assert got[0] == got[1] == (0, 0, 0, 0, 0, 0, "") and align.align_corpus(docs.where("doc_id < 0")).count() == 0


def test_common_ends():
    draw = random.Random(1)
    for n in range(300):
        size = draw.choice([3, 20, 200, 1000])
        left, right = (sorted(draw.sample(range(size), draw.randint(0, size))) for _ in range(2))
        if n % 5 == 0:
            left, right = list(range(0, 2 * size, 2)), list(range(1, 2 * size, 2))
        cuts = sorted(draw.sample(range(len(left) + 1), min(3, len(left))))
        first = np.array([0, *cuts, len(left)])
        got = align.common_ends(np.array(left, np.int64), np.array(right, np.int64), first)
        assert [x for x, f in zip(left, got) if f] == sorted(set(left) & set(right))


def test_linkable_pairs_are_few(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pairs, _ = align.count_links(align.align(docs))
    known = align.coder(align.FOLDER)
    assert len(pairs) < known.linkable() < 2_000_000
    for p in pairs[::37].tolist():
        a, b = known.a_bytes[p // align._PAIR], known.b_bytes[p % align._PAIR]
        assert a.endswith(b) or b.endswith(a)


def test_remembered_words_are_those_of_the_tokenizer():
    coder, draw = align.coder(align.FOLDER), random.Random(9)
    pool = ["a", "B", "é", "ß", "ǅ", "7", "²", "½", " ", "  ", "\n", "\t", "\r\n", "'s", "'ll", "'", "-", "…", "“", "_", ".", "<|endoftext|>", "\u00a0", "\u2028", "\x1f", "\x85", "漢", "👍", "\u0301", "ª", "٣", "\u00ad"]
    texts = ["".join(draw.choice(pool[:22] if n % 2 else pool) for _ in range(draw.randint(0, 30))) for n in range(4000)]
    want = [e.ids for e in coder.a.encode_batch(texts, add_special_tokens=False)]
    assert coder.encode_bytes(texts) == want
    assert sum(bool(align._SETTLED.fullmatch(t)) for t in texts) > 1000
    docs = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    assert coder.encode_bytes(docs) == [e.ids for e in coder.a.encode_batch(docs, add_special_tokens=False)]


def test_few_words_are_remembered(monkeypatch):
    coder = align.Coder(align.FOLDER)
    monkeypatch.setattr(align, "_REMEMBERED", 3)
    texts = [" one two", " three four five", " one six", "", " two"]
    assert [coder.encode_bytes([t])[0] for t in texts] == [coder.a.encode(t, add_special_tokens=False).ids for t in texts]
