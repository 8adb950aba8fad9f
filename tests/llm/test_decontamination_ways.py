"""Both ways of the join, and documents judged row by row."""

import random

import pytest
import test_llm_operators as base

from assayer.llm import decontaminate


def tables(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(30)}"
    items = [" ".join(word() for _ in range(rng.choice((3, 10, 14)))) for _ in range(12)] + [None, ""]
    texts = [" ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(40)] + [None, "", *(f"a {i} b, {i.upper()}" for i in items[:6])]
    d = base.docs(spark, texts)
    return d.union(d.limit(3)), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def test_shuffled_way_finds_the_same(spark, monkeypatch):
    d, items = tables(spark)
    want = sorted(map(str, decontaminate.find_hits(d, items).collect()))
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_WINDOWS", 0)
    assert sorted(map(str, decontaminate.find_hits(d, items).collect())) == want
    assert any("start=2" in r for r in want)


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_removed_documents_are_those_with_hits(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_HITS", limit)
    d, items = tables(spark)
    hit = {r.doc_id for r in decontaminate.find_hits(d, items).collect() if r.hits}
    kept = decontaminate.remove_documents(d, items)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in d.collect() if r.doc_id not in hit)
    assert hit


def test_rows_of_one_id_are_judged_each(spark):
    bad = "one two three four five six seven eight nine ten"
    d = spark.createDataFrame([(1, bad, "en", "s", 0), (1, "fine", "en", "s", 0), (None, bad, "en", "s", 0), (None, "fine", "en", "s", 0), (2, None, "en", "s", 0)], base.SCHEMA)
    items = spark.createDataFrame([(1, bad)], "item_id long, text string")
    assert sorted((str(r.doc_id), str(r.text)) for r in decontaminate.remove_documents(d, items).collect()) == [("1", "fine"), ("2", "None"), ("None", "fine")]
