"""The registered queries without SQL against plain Python on the smallest tables."""

import hashlib
import re

import oracle
import pytest
import test_llm_operators as base
import xxhash

from assayer.llm.packing import CAPACITY
from assayer.llm.queries import QUERIES


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{oracle.SF}/documents.parquet").collect()}


def test_op4(spark, texts):
    prints = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", base.lower(t))
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[k] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    pairs = [(a, b) for a in prints for b in prints if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2]
    root = base.union(pairs, list(prints))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op4_simhash_near_dedup"](spark, oracle.SF).collect()}
    assert got == {k: (f"{p:016x}", root[k]) for k, p in prints.items()}


def test_op5(spark, texts):
    order = ("email", "ip", "card", "phone")
    for r in QUERIES["op5_pii"](spark, oracle.SF).collect():
        spans = sorted(base.naive_spans(texts[r.doc_id]), key=lambda s: (order.index(s[0]), s[1]))
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in order]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(r.spans.split(","))


def test_op6(spark, texts):
    order = sorted(texts)
    gone = base.removed_lines([texts[k] for k in order], 0.8)
    got = {r.doc_id: (r.n_lines, r.removed_lines) for r in QUERIES["op6_line_dedup"](spark, oracle.SF).collect()}
    assert got == {k: (texts[k].count("\n") + 1, ",".join(map(str, gone.get(at, [])))) for at, k in enumerate(order)}


def test_op1(spark, texts):
    """Every word is in one place, bins hold no more than they can, and no source or copy twice."""
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{oracle.SF}/documents.parquet").collect()}
    rows = QUERIES["op1_best_fit_packing"](spark, oracle.SF).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for k, t in texts.items():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t))
        own = sorted(pieces[k], key=lambda r: r.piece)
        assert sum(r.n_tokens for r in own) == n and [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == [CAPACITY * j for j in range(len(own))]
    bins = {}
    for r in rows:
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    for b in bins.values():
        assert sum(r.n_tokens for r in b) <= CAPACITY and sorted(r.slot for r in b) == list(range(len(b)))
        assert len({source[r.doc_id] for r in b}) == len(b) and len({base.lower(texts[r.doc_id]) for r in b}) == len({r.doc_id for r in b})


def test_op2_range_and_threshold(spark):
    import zlib

    for r in QUERIES["op2_toxicity"](spark, oracle.SF).collect():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
