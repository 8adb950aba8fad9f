"""Structured Streaming over the events table: windows, late data, deduplication and a stateful stop rule."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from assayer.sources.shared import Scratch


def event_time() -> Column:
    """The table's time stamps have no zone; a watermark needs an instant, here of the session's zone."""
    return F.col("ts").cast("timestamp")


def read_stream(spark: SparkSession, sf_dir: str, name: str = "events", files_per_trigger: int = 64) -> DataFrame:
    """A table's files as a stream, so many in a micro-batch."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")


def tumbling(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by type and window; rows later than the watermark are dropped by the stream."""
    timed = events.withColumn("at", event_time()).withWatermark("at", late)
    g = timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 days", slide: str = "1 day") -> DataFrame:
    timed = events.withColumn("at", event_time()).withWatermark("at", "2 days")
    g = timed.groupBy(F.window("at", width, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    timed = events.withColumn("at", event_time()).withWatermark("at", "1 day")
    g = timed.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")


def first_writes(events: DataFrame, keys: list[str], late: str = "2 days") -> DataFrame:
    """An idempotent upsert as a stream: of equal keys within the watermark one row passes."""
    return events.withColumn("at", event_time()).withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


def stop_rule(events: DataFrame, limit: float = 120.0, budget: int = 5, late: str = "2 days", idle_days: int = 30) -> DataFrame:
    """For each user and type the bounded loop as state: attempts until one exceeds ``limit`` or the budget is spent.

    The state is the first ``budget`` attempts by time and id, whatever the order in which they arrive, so an attempt
    that comes late (within the watermark) takes its place and the updated outcome is given out again.  A unit without
    attempts for ``idle_days`` of event time is forgotten.
    """

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first = list(zip(*state.get)) if state.exists else []
        for pdf in rows:
            at = pdf["at"].astype("datetime64[us]").astype("int64")
            first = sorted([*first, *zip(at.tolist(), pdf["event_id"].tolist(), pdf["value"].tolist())])[:budget]
        state.update(tuple(map(list, zip(*first))))
        state.setTimeoutTimestamp(max(first[-1][0] // 1000, state.getCurrentWatermarkMs()) + idle_days * 86_400_000)
        hit = next((k for k, one in enumerate(first, 1) if one[2] > limit), None)
        yield pd.DataFrame({"user_id": [key[0]], "arm": [key[1]], "iterations": [hit or len(first)], "validated": [hit is not None]})

    out = "user_id long, arm string, iterations long, validated boolean"
    timed = events.withColumn("at", event_time()).withWatermark("at", late)
    held = "at array<long>, id array<long>, value array<double>"
    return timed.groupBy("user_id", "event_type").applyInPandasWithState(step, out, held, "update", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, into Parquet in the shared folder, and reads the result.

    Updates of a key in later micro-batches are kept with the batch's number as ``batch``.
    """
    spark = stream.sparkSession
    scratch = Scratch(spark)
    out = f"{scratch.root}/out"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{scratch.root}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(out)
