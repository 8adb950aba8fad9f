"""Variants of the items, their certificate and acceptance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import code as C
from assayer.functions import stats
from assayer.functions import text as X
from assayer.functions.variants import variant_udf
from assayer.jobs.base import Tables, query
from assayer.jobs.repair import items
from assayer.sources import readers, sinks
from assayer.sources.shared import Scratch

SEED = 42


def variants(t: Tables) -> DataFrame:
    """A variant ``b`` of each item's function, its measures, and whether it is certified and accepted.

    Certified: with the old names back, its canonical slice is that of the source.  Accepted: certified, and the
    similarity of the slices is the judge's threshold or more.
    """
    rows = items(t).withColumn("made", variant_udf("v", F.col("k") + SEED)).select("k", "cwe", "v", F.col("made.text").alias("b"), F.col("made.undone").alias("undone"), F.col("made.names").alias("renamed"))
    canonical = lambda c: X.canonical_code(F.array_join(C.slice_rows(F.col(c)), "\n"))
    tokens = lambda c: F.array_distinct(X.code_tokens(F.col(c)))
    grams = F.size(F.array_intersect(X.char_grams(F.col("v")), X.char_grams(F.col("b")))) / F.greatest(F.size(X.char_grams(F.col("v"))), F.lit(1))
    print_of = lambda c: F.md5(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?s)/\*.*?\*/|//[^\n]*", " "), X.IDENTIFIER, "X"), r"\s+", ""))
    out = rows.withColumns({"certified": canonical("undone") == canonical("v"), "similarity": C.slice_similarity(F.col("v"), F.col("undone"))})
    return out.withColumns({
        "accepted": F.col("certified") & (F.col("similarity") >= C.INTACT), "edit_norm": X.line_distance(F.col("v"), F.col("b")), "token_jaccard": X.jaccard(tokens("v"), tokens("b")),
        "gram_overlap": grams, "same_print": print_of("v") == print_of("b"),
    })


@query()
def variant_certify(spark, sf_dir):
    """Each item's variant: certificate, acceptance and how far its surface moved."""
    r = lambda c: F.round(c, 6).alias(c)
    return variants(Tables(spark, sf_dir)).select("k", "certified", "accepted", "renamed", r("similarity"), r("edit_norm"), r("token_jaccard"), r("gram_overlap"), "same_print")


@query()
def variant_yield(spark, sf_dir):
    """Accepted share by weakness class and overall, with its interval."""
    y = variants(Tables(spark, sf_dir)).rollup("cwe").agg(F.count(F.lit(1)).alias("total"), F.count_if("accepted").alias("accepted"))
    lo, hi = stats.wilson(F.col("accepted"), F.col("total"))
    return y.select(F.coalesce("cwe", F.lit("all")).alias("cwe"), "total", "accepted", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


def build_artifacts(spark, sf_dir: str, folder: str) -> DataFrame:
    """Writes the accepted variants as JSON lines under ``folder``, and returns its manifest with this artifact put in or replaced.

    The manifest (name, rows, checksum of the rows in any order) is itself a table in the folder.
    """
    accepted = variants(Tables(spark, sf_dir)).where("accepted").select("k", "cwe", F.col("b").alias("code"), "similarity", "edit_norm")
    sinks.write_json_lines(accepted, f"{folder}/variants")
    written = spark.read.schema("k bigint, cwe string, code string, similarity double, edit_norm double").json(f"{folder}/variants")
    digest = F.sha2(F.concat_ws(",", F.count(F.lit(1)).cast("string"), F.sum(F.xxhash64("k", "code").cast("decimal(38,0)")).cast("string")), 256)
    new = written.agg(F.lit("variants").alias("name"), F.count(F.lit(1)).alias("rows"), digest.alias("sha256"))
    path = f"{folder}/manifest"
    old = readers.read_or_empty(spark, path, "name string, rows bigint, sha256 string")
    # Written anew under another name first: what is read is not what is overwritten.
    manifest = Scratch(spark).write(sinks.upsert(old, new, ["name"]))
    manifest.write.mode("overwrite").parquet(path)
    return manifest
