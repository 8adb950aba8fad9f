"""The order of lines where numbers and ids are unusual."""

import random

import test_llm_operators as base

from assayer.llm import line_dedup


def words(draw, n):
    return [f"w{draw.randrange(10**6)}" for _ in range(n)]


def test_lines_beyond_a_million_are_ordered_by_their_numbers(spark):
    draw = random.Random(2)
    lines, want = [""] * 1_048_600, []
    for k in range(12):
        near = words(draw, 12)
        lines.append(" ".join(near))
        lines.append(" ".join(near[:-1] + words(draw, 1)))
        want.append(1_048_600 + 2 * k + 1)
    found = line_dedup.later_matches(base.docs(spark, ["one line of words that no other has", "\n".join(lines)])).collect()
    assert [(r.id, list(r.removed)) for r in found] == [(1, want)]


def test_other_ids_give_their_own_order(spark):
    draw = random.Random(3)
    rows, want = [], {}
    for k in range(30):
        near = words(draw, 12)
        ids = sorted([f"d{draw.randrange(10**9)}", f"D{draw.randrange(10**9)}", f"é{k}"], key=str.encode)
        texts = [" ".join(near), " ".join(near[:-1] + words(draw, 1)), " ".join(near) + "\n" + " ".join(words(draw, 9))]
        draw.shuffle(texts)
        rows += [(i, t, 1) for i, t in zip(ids, texts)]
        want |= {i: base.removed_lines(texts, 0.8)[at] for at, i in enumerate(ids) if base.removed_lines(texts, 0.8).get(at)}
    rows.append((None, rows[0][1], 1))
    docs = spark.createDataFrame(rows, "name string, text string, place int").repartition(5)
    found = {r.id: list(r.removed) for r in line_dedup.later_matches(docs, "name").collect()}
    first = rows[0][1].split("\n")
    assert None not in found and found.pop(rows[0][0]) == list(range(len(first)))
    want.pop(rows[0][0], None)
    assert found.items() >= want.items()
