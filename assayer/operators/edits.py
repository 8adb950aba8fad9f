"""Edit scripts: two texts are compared once, and all that is asked of their differences follows from the script by SQL.

A script is an array of edits (tag, the lines of either side); ``rows`` makes it a table with a row for each edit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.diff import compare_udf

_INTS = "array<int>"
_STRINGS = "array<string>"


def with_script(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds the struct ``name``: the ``edits`` from text ``a`` to ``b`` and their ``size``.

    Texts are compared where they are and never shuffled; a pair that neighbours share is compared once.  Null counts as empty.
    Other columns stay.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.withColumn(name, compare_udf(text(a), text(b)))


def rows(scripts: DataFrame, key: list[str], script: str) -> DataFrame:
    """A row for each edit, with its place ``at`` in the script."""
    return scripts.select(*key, F.posexplode(F.col(script)["edits"]).alias("at", "edit")).select(*key, "at", "edit.*")


def _flat(edits: Column, of, kind: str) -> Column:
    return F.flatten(F.transform(edits, of)).cast(kind)


def _range(low: Column, high: Column) -> Column:
    return F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast(_INTS))


def marks(script: Column) -> Column:
    """``line`` and ``mark`` in order: ``change`` for a line of the left side that goes or is replaced, ``insert`` for one that lines follow.

    Lines before the first count as following it; a line is marked once, by its first edit.
    """
    def one(e: Column) -> Column:
        changed = F.transform(_range(e["a_from"], e["a_to"]), lambda i: F.struct(i.alias("line"), F.lit("change").alias("mark")))
        return F.when(e["tag"] == "insert", F.array(F.struct(F.greatest(e["a_from"] - 1, F.lit(0)).alias("line"), F.lit("insert").alias("mark")))).otherwise(changed)

    every = F.flatten(F.transform(script["edits"], one))
    first = F.aggregate(every, F.slice(every, 1, 0), lambda acc, m: F.when(F.exists(acc, lambda x: x["line"] == m["line"]), acc).otherwise(F.concat(acc, F.array(m))))
    return F.array_sort(first)


def changed_lines(script: Column) -> Column:
    """The marked lines, in order."""
    lines = _flat(script["edits"], lambda e: F.when(e["tag"] == "insert", F.array(F.greatest(e["a_from"] - 1, F.lit(0)))).otherwise(_range(e["a_from"], e["a_to"])), _INTS)
    return F.array_sort(F.array_distinct(lines))


def removed(script: Column, lines: Column) -> Column:
    """Stripped lines of the left side that an edit removes or replaces, without empty ones."""
    taken = _flat(script["edits"], lambda e: F.slice(lines, e["a_from"] + 1, e["a_to"] - e["a_from"]), _STRINGS)
    return F.filter(F.transform(taken, _strip), lambda s: s != "")


def added(script: Column, lines: Column) -> Column:
    """Stripped lines of the right side that an edit inserts or puts in place of others, without empty ones."""
    taken = _flat(script["edits"], lambda e: F.slice(lines, e["b_from"] + 1, e["b_to"] - e["b_from"]), _STRINGS)
    return F.filter(F.transform(taken, _strip), lambda s: s != "")


def _strip(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+\z", "")


def hunks(script: Column) -> Column:
    """The runs of marked lines."""
    return runs_of(changed_lines(script))


def runs_of(lines: Column, gap: int = 2) -> Column:
    """Starts ``s`` and ends ``e`` of the runs of rising numbers that differ by so many at most."""
    start = F.array().cast("array<struct<s:int,e:int>>")

    def step(acc: Column, i: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), i.alias("e"))))
        return F.when((F.size(acc) > 0) & (i <= last["e"] + gap), grown).otherwise(F.concat(acc, F.array(F.struct(i.alias("s"), i.alias("e")))))

    return F.aggregate(lines, start, step)
