"""Line differences, patches and text variants as small helpers behind Arrow-batched functions.

The longest-matching-block difference has no SQL form; Spark deals the rows, and each row's two texts
meet in one call of the standard library.
"""

from __future__ import annotations

import difflib
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _rows(text: str | None) -> list[str]:
    return [s.strip() for s in (text or "").splitlines()]


def _edits(left: list[str], right: list[str]) -> list[tuple[range, range]]:
    """The lines of each side in every place where they differ; an insertion has no line on the left."""
    blocks = difflib.SequenceMatcher(None, left, right, autojunk=False).get_matching_blocks()
    out, i, j = [], 0, 0
    for block in blocks:
        if block.a > i or block.b > j:
            out.append((range(i, block.a), range(j, block.b)))
        i, j = block.a + block.size, block.b + block.size
    return out


def script(a: str | None, b: str | None) -> list[tuple[str, int, int, int, int]]:
    """The edits from ``a`` to ``b`` in order: tag, and the lines (from 0, the end not included) of either side."""
    return _tagged(_edits(_rows(a), _rows(b)))


def edit_size(a: str | None, b: str | None) -> int:
    """How many lines a line-by-line delta marks as removed or added."""
    left, right = _rows(a), _rows(b)
    return _size(left, right, _edits(left, right))


def _size(left: list[str], right: list[str], edits: list[tuple[range, range]]) -> int:
    # The delta marks all lines of a place, in pairs that look alike or not, unless some of them are equal; from 200 lines on it
    # takes frequent lines for junk and finds other places.
    if len(right) < 200 and all({left[i] for i in x}.isdisjoint(right[j] for j in y) for x, y in edits):
        return sum(len(x) + len(y) for x, y in edits)
    return sum(line.startswith(("+ ", "- ")) for line in difflib.ndiff(left, right))


@lru_cache(maxsize=16)
def compared(a: str, b: str) -> tuple[list[dict], int]:
    """The script as rows, and its size; the last pairs are remembered, as neighbours often have the same."""
    left, right = _rows(a), _rows(b)
    edits = _edits(left, right)
    return [dict(zip(_EDIT.names, e)) for e in _tagged(edits)], _size(left, right, edits)


def _tagged(edits: list[tuple[range, range]]) -> list[tuple[str, int, int, int, int]]:
    return [("replace" if len(x) and len(y) else "delete" if len(x) else "insert", x.start, x.stop, y.start, y.stop) for x, y in edits]


def unified(a: str | None, b: str | None, context: int = 2) -> str:
    return "\n".join(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), "a", "b", n=context, lineterm=""))


def apply_patch(before: str | None, after: str | None, target: str | None) -> tuple[bool, str | None]:
    """Applies the change from ``before`` to ``after`` to ``target`` by context, without fuzz.

    The replaced lines of each place, or the line before an insertion, are looked for in the target at or after the
    place of the last ones, blanks around lines aside; the first match counts.  A place that is not found, or an
    insertion before the first line, which has no context, refuses the whole.
    """
    old, new, text = ([line.rstrip() for line in (t or "").splitlines()] for t in (before, after, target))
    keys = [line.strip() for line in text]
    out: list[str] = []
    done = 0
    for lines, added in _edits(old, new):
        context = list(lines) or list(range(max(0, lines.start - 1), lines.start))
        wanted = [old[k].strip() for k in context]
        fits = (k for k in range(done, len(keys) - len(wanted) + 1) if keys[k : k + len(wanted)] == wanted)
        place = next(fits, None) if wanted else None
        if place is None:
            return False, None
        kept = place if len(lines) else place + 1
        out += text[done:kept] + [new[k] for k in added]
        done = place + len(wanted)
    return True, "\n".join(out + text[done:])


def functions_of(text: str | None) -> list[tuple[str, str]]:
    """Name and whole text of brace-balanced functions or blocks that follow a parameter list."""
    source, out, at = text or "", [], 0
    head = re.compile(r"([A-Za-z_][A-Za-z0-9_]*)\s*\([^(){};]*\)\s*\{")
    while m := head.search(source, at):
        depth, k = 1, m.end()
        while k < len(source) and depth:
            depth += {"{": 1, "}": -1}.get(source[k], 0)
            k += 1
        if not depth:
            out.append((m[1], source[m.start() : k]))
        at = k if not depth else m.end()
    return out


_EDIT = T.StructType().add("tag", "string").add("a_from", "integer").add("a_to", "integer").add("b_from", "integer").add("b_to", "integer")


@F.pandas_udf(T.StructType().add("edits", T.ArrayType(_EDIT)).add("size", "integer"))
def compare_udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """The script of edits between two texts, and its size."""
    return pd.DataFrame([compared(x, y) for x, y in zip(a, b)], columns=["edits", "size"])


@F.pandas_udf(T.StringType())
def unified_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([unified(x, y) for x, y in zip(a, b)], dtype=object)


@F.pandas_udf(T.StructType([T.StructField("applied", T.BooleanType()), T.StructField("text", T.StringType())]))
def apply_patch_udf(before: pd.Series, after: pd.Series, target: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([apply_patch(x, y, z) for x, y, z in zip(before, after, target)], columns=["applied", "text"])


@F.udtf(returnType=T.StructType([T.StructField("name", T.StringType()), T.StructField("code", T.StringType())]))
class SplitFunctions:
    """Table function: one row for each function in a text."""

    def eval(self, text: str):
        yield from functions_of(text)
