"""Streams give what the batch form gives."""

from assayer.sources.tables import table
from assayer.streaming import events as E

SF = "/root/testdata/sf0.001"


def test_tumbling_stream_equals_batch(spark):
    batch = {tuple(r) for r in E.tumbling(table(spark, SF, "events")).collect()}
    streamed = E.drain(E.tumbling(E.read_stream(spark, SF)), "complete").drop("batch")
    assert {tuple(r) for r in streamed.collect()} == batch


def test_first_writes_pass_once(spark):
    got = E.drain(E.first_writes(E.read_stream(spark, SF), ["event_type"], "90 days"))
    assert got.count() == table(spark, SF, "events").select("event_type").distinct().count()


def test_stop_rule_in_any_order_of_arrival(spark, tmp_path):
    """One file a micro-batch, the latest attempts first: the last update of each unit is the batch result."""
    from pyspark.sql import functions as F

    rows = [(k, f"2024-01-{1 + k // 3:02d} 0{k % 3}:00:00", k % 2, "click", float(v)) for k, v in enumerate((10, 130, 20, 30, 125, 40, 50, 60, 70, 80, 140, 5, 6, 7))]
    schema = "event_id long, ts string, user_id long, event_type string, value double"
    for n, part in enumerate((rows[9:], rows[4:9], rows[:4])):
        spark.createDataFrame(part, schema).select("event_id", F.to_timestamp("ts").alias("ts"), "user_id", "event_type", "value").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    updates = E.drain(E.stop_rule(stream, late="60 days"), "update")
    last = updates.groupBy("user_id").agg(F.max(F.struct("batch", "iterations", "validated")).alias("x")).select("user_id", "x.iterations", "x.validated", "x.batch")
    got = {r.user_id: (r.iterations, r.validated) for r in last.collect()}
    want = {}
    for user in (0, 1):
        own = [v for k, _, u, _, v in rows if u == user][:5]
        hit = next((k for k, v in enumerate(own, 1) if v > 120), None)
        want[user] = (hit or len(own), hit is not None)
    assert got == want and updates.select("batch").distinct().count() == 3
