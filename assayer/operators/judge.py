"""The judge of patches: statement multisets of a patch against those of the official fix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import code as C
from assayer.functions.text import jaccard

EXACT, COVERS, MISSING = "equivalent_to_official_fix", "covers_official_fix_changes", "missing_official_fix_changes"
UNCHANGED, UNBALANCED = "unchanged", "unbalanced_braces"
REASONS = (EXACT, COVERS, MISSING, UNCHANGED, UNBALANCED)


_ADDED = ("reason", "similarity", "validated", "severed")
#: What is read of a function and its fix, and of a patch: statements, as sets too, their differences, and the function's slice.
SIDES, OWN = ("__v", "__f", "__rows_f", "__tokens", "__lost", "__new"), ("__rows_p", "__p", "__lost_p", "__new_p")


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def with_sides(rows: DataFrame, vulnerable: str = "v", fixed: str = "f") -> DataFrame:
    """Adds ``SIDES``; of rows that many patches are made of later, so that a function and its fix are read once."""
    read = rows.withColumns({"__v": C.tagged(C.statements(_text(vulnerable))), "__rows_f": C.statements(_text(fixed)), "__tokens": C.slice_tokens(_text(vulnerable))})
    read = read.withColumn("__f", C.tagged(F.col("__rows_f")))
    return read.withColumns({"__lost": F.array_except("__v", "__f"), "__new": F.array_except("__f", "__v")})


def with_own(rows: DataFrame, patch: str = "p") -> DataFrame:
    """Adds ``OWN`` to rows that have ``SIDES``."""
    read = rows.withColumn("__rows_p", C.statements(_text(patch))).withColumn("__p", C.tagged(F.col("__rows_p")))
    return read.withColumns({"__lost_p": F.array_except("__v", "__p"), "__new_p": F.array_except("__p", "__v")})


def judge(rows: DataFrame, vulnerable: str = "v", fixed: str = "f", patch: str = "p") -> DataFrame:
    """``validated``, ``reason``, ``similarity`` to the vulnerable slice and ``severed`` for each row's patch.

    A patch is accepted if it changes the statements, keeps the braces balanced, and either has the statements of the
    fix or removes and adds, as multisets, all that the fix removes and adds.  Severance is reported, not judged by.
    Null texts count as empty; columns of these four names are replaced, all others stay.

    Texts are read where they are and never shuffled; rows that bring ``SIDES`` or ``OWN`` along aren't read for these again.
    """
    rows = rows.drop(*_ADDED)
    out = rows if SIDES[0] in rows.columns else with_sides(rows, vulnerable, fixed)
    out = out if OWN[0] in rows.columns else with_own(out, patch)
    changed = (F.size("__lost_p") > 0) | (F.size("__new_p") > 0)
    covers = (F.size(F.array_except("__lost", "__lost_p")) == 0) & (F.size(F.array_except("__new", "__new_p")) == 0)
    exact = F.col("__rows_p") == F.col("__rows_f")
    reason = F.when(~changed, UNCHANGED).when(~C.balanced(_text(patch)), UNBALANCED).when(exact, EXACT).when(covers, COVERS).otherwise(MISSING)
    out = out.select(*rows.columns, reason.alias("reason"), C.slice_tokens(_text(patch)).alias("__tokens_p"), F.col("__tokens").alias("__tokens_v"))
    out = out.select(*rows.columns, "reason", jaccard(F.col("__tokens_p"), F.col("__tokens_v")).alias("similarity"))
    return out.select(*rows.columns, "reason", "similarity", F.col("reason").isin(EXACT, COVERS).alias("validated"), (F.col("similarity") < C.INTACT).alias("severed"))
