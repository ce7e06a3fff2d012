"""Structured Streaming queries: each drains what is there and returns what was emitted."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglake.operators import idempotent, resilience
from loglake.plans.book import Book
from loglake.streaming import operators as S

query = Book()
QUERIES, ORACLES = query.queries, query.oracles


@query("""WITH d AS (SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT CAST(date_diff('day', DATE '2024-01-01', day) AS INTEGER) AS day, event_type, n FROM d
    WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_window_counts(spark, d):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    out = S.drain(S.window_counts(S.tail(spark, d, "events")))
    return out.select(F.datediff(F.col("start").cast("date"), F.lit("2024-01-01").cast("date")).alias("day"), "event_type", "n")


@query("""WITH w AS (SELECT date_trunc('day', ts) - INTERVAL (k) DAY AS day, event_type FROM events, range(2) r(k)), d AS (SELECT day, event_type, count(*) AS n FROM w GROUP BY ALL) SELECT CAST(date_diff('day', DATE '2024-01-01', day) AS INTEGER) AS day, event_type, n FROM d
    WHERE day + INTERVAL 2 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_sliding_counts(spark, d):
    out = S.drain(S.window_counts(S.tail(spark, d, "events"), width="2 days", slide="1 day"))
    return out.select(F.datediff(F.col("start").cast("date"), F.lit("2024-01-01").cast("date")).alias("day"), "event_type", "n")


@query("SELECT CAST(user_id AS VARCHAR) AS key, max(event_id) AS \"offset\", arg_max(props, event_id) AS value FROM events GROUP BY ALL")
def stream_compaction(spark, d):
    e = S.tail(spark, d, "events").select(F.lit("events").alias("topic"), F.lit(0).alias("partition"), F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("offset"), F.col("props").alias("value"))
    return S.drain(S.latest(e), "complete").select("key", "offset", "value")


@query()
def stream_sessions(spark, d):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    out = S.drain(S.sessions(S.tail(spark, d, "events"), "user_id", "ts", "6 hours"))
    return out.select("user_id", F.unix_micros("started").alias("started"), "heartbeats")


@query("SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def stream_dedup(spark, d):
    out = S.drain(S.dedup(S.tail(spark, d, "events"), "ts", "60 days", ["user_id", "event_type"]).select("user_id", "event_type"))
    return out.groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 THEN 'Accept' ELSE 'Duplicate' END AS verdict FROM (SELECT user_id, event_id * 2 AS event_id FROM events UNION ALL SELECT user_id, event_id * 2 + 1 FROM events)")
def stream_idempotent(spark, d):
    e = S.tail(spark, d, "events").select("user_id", F.explode(F.array(F.col("event_id") * 2, F.col("event_id") * 2 + 1)).alias("event_id"))
    # each batch is sent twice; its sequence is its place among its producer's
    return S.drain(S.stateful(e, ["user_id"], "event_id", idempotent.resend_step, "string")).select("user_id", "event_id", F.col("result").alias("verdict"))


@query()
def stream_token_bucket(spark, d):
    e = S.tail(spark, d, "events").select("user_id", "event_id", F.expr("event_id * 60000000").alias("now"))
    return S.drain(S.stateful(e, ["user_id"], "event_id", lambda s, r: resilience.token_bucket(s, r, 0.0001, 3), "boolean"))
