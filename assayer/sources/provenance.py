"""What a run read, did and wrote, as documents that a rerun replaces."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.sources import readers, sinks
from assayer.sources.shared import Scratch

_RUNS = "run string, settings string, tables string, lineage string, observed string"


def table_digest(df: DataFrame) -> DataFrame:
    """One row: ``rows`` and ``digest`` of a table, whatever the order of its rows; columns count by name and type.

    The digest is of the number of rows and two sums of their 64-bit hashes, which tasks add up; repeated rows count.
    """
    names = sorted(df.columns)
    values = [F.coalesce(F.to_json(F.struct(F.col(f"`{c}`").alias("v"))), F.lit("")) for c in names]
    a, b = F.xxhash64(F.lit(1), *values), F.xxhash64(F.lit(2), *values)
    total = lambda x: F.coalesce(F.sum(x.cast("decimal(38,0)")), F.lit(0)).cast("string")
    kinds = ",".join(f"{c}:{dict(df.dtypes)[c]}" for c in names)
    sums = df.agg(F.count(F.lit(1)).alias("rows"), total(a).alias("a"), total(b).alias("b"))
    return sums.select("rows", F.sha2(F.concat_ws("|", F.lit(kinds), F.col("rows").cast("string"), "a", "b"), 256).alias("digest"))


def run_document(run: str, settings: dict, inputs: dict[str, DataFrame], outputs: dict[str, DataFrame], observed: dict) -> dict:
    """The document of a run: its settings and their digest, the digests of its tables, which output came from which inputs, and counts.

    It holds no time and no path, so the same run over the same tables gives the same document.
    """
    def facts(tables: dict[str, DataFrame]) -> dict:
        return {name: table_digest(df).first().asDict() for name, df in sorted(tables.items())}

    return {
        "run": run, "settings": settings, "tables": {"inputs": facts(inputs), "outputs": facts(outputs)},
        "lineage": [{"output": o, "input": i} for o in sorted(outputs) for i in sorted(inputs)], "observed": observed,
    }


def record(spark: SparkSession, folder: str, document: dict) -> DataFrame:
    """Puts a document into the table of runs under ``folder``, in place of one of the same name and settings; returns the table."""
    text = lambda x: json.dumps(x, sort_keys=True)
    row = [(document["run"], *(text(document[k]) for k in ("settings", "tables", "lineage", "observed")))]
    old = readers.read_or_empty(spark, f"{folder}/runs", _RUNS)
    # Written anew under another name first: what is read is not what is overwritten.
    table = Scratch(spark).write(sinks.upsert(old, spark.createDataFrame(row, _RUNS), ["run", "settings"]))
    table.coalesce(1).write.mode("overwrite").parquet(f"{folder}/runs")
    return table
