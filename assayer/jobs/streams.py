"""Windowed and stateful jobs over events; an extension, as the reference has no streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.jobs.base import Tables, query
from assayer.streaming import events as E


@query("""
SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""".replace("time_bucket(INTERVAL 1 DAY, ts) AS start", "strftime(date_trunc('day', ts), '%Y-%m-%d') AS start"))
def tumbling_windows(spark, sf_dir):
    w = E.tumbling(Tables(spark, sf_dir).events)
    return w.withColumn("start", F.date_format("start", "yyyy-MM-dd"))


@query("""
WITH d AS (SELECT date_trunc('day', ts) AS d FROM events), s AS (SELECT d AS start FROM d UNION ALL SELECT d - INTERVAL 1 DAY FROM d)
SELECT strftime(start, '%Y-%m-%d') AS start, count(*) AS n FROM s GROUP BY 1""")
def sliding_windows(spark, sf_dir):
    return E.sliding(Tables(spark, sf_dir).events).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf_dir):
    return E.sessions(Tables(spark, sf_dir).events).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT md5(props || event_type) AS k, count(*) AS n FROM (SELECT DISTINCT props, event_type FROM events) GROUP BY k")
def stream_first_writes(spark, sf_dir):
    """Streamed deduplication by key; one row of each key passes, whichever came first."""
    stream = E.first_writes(E.read_stream(spark, sf_dir), ["props", "event_type"], "60 days")
    return E.drain(stream).groupBy(F.md5(F.concat("props", "event_type")).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH a AS (SELECT user_id, event_type AS arm, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS attempt, value FROM events)
SELECT user_id, arm, coalesce(min(attempt) FILTER (value > 120), max(attempt)) AS iterations, bool_or(value > 120) AS validated FROM a WHERE attempt <= 5 GROUP BY ALL""")
def stream_stop_rule(spark, sf_dir):
    """The bounded loop as a stateful stream; the last update of each unit counts."""
    updates = E.drain(E.stop_rule(E.read_stream(spark, sf_dir)), "update")
    last = F.max(F.struct("batch", "iterations", "validated")).alias("x")
    return updates.groupBy("user_id", "arm").agg(last).select("user_id", "arm", "x.iterations", "x.validated")
