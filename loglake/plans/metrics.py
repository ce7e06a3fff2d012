"""Queries over metrics and latencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglake.model import LOG_SQL, event_log, micros, table
from loglake.operators import metrics as M
from loglake.plans.book import Book

query = Book()
QUERIES, ORACLES = query.queries, query.oracles
WITH = f"WITH {LOG_SQL}"
BOUNDS = [1.0, 5.0, 10.0, 50.0, 100.0, 250.0]


@query(f"""{WITH} SELECT CASE WHEN event_type IN ('purchase', 'signup') THEN 'produce' ELSE 'fetch' END AS api, CASE WHEN user_id % 2 = 0 THEN 'native' ELSE 'kafka' END AS protocol, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, CAST(sum(encoded_size) AS BIGINT) AS bytes FROM log GROUP BY ALL""")
def request_metrics(spark, d):
    r = event_log(spark, d).select(
        F.when(F.col("event_type").isin("purchase", "signup"), "produce").otherwise("fetch").alias("api"), F.when(F.pmod("user_id", F.lit(2)) == 0, "native").otherwise("kafka").alias("protocol"), (F.col("event_type") == "error").alias("failed"), F.col("encoded_size").alias("bytes")
    )
    return M.requests(r)


_HIST = " UNION ALL ".join(f"SELECT event_type, CAST({b} AS DOUBLE) AS le, count(*) FILTER (value <= {b}) AS bucket, count(*) AS count FROM events GROUP BY ALL" for b in BOUNDS)


@query(f"{_HIST} UNION ALL SELECT event_type, CAST('Infinity' AS DOUBLE), count(*), count(*) FROM events GROUP BY ALL")
def prom_histogram(spark, d):
    return M.histogram(table(spark, d, "events"), ["event_type"], "value", BOUNDS).select("event_type", "le", "bucket", "count")


@query("SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def gauge_last(spark, d):
    return M.gauge(table(spark, d, "events"), ["user_id"], "value", "event_id")


@query("""SELECT event_type AS name, 'a=' || (user_id % 3) || ',b=' || (user_id % 2) AS labels, count(*) AS value FROM events GROUP BY ALL""")
def metric_series(spark, d):
    a, b = F.pmod("user_id", F.lit(3)).cast("string"), F.pmod("user_id", F.lit(2)).cast("string")
    labels = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("a"), a, F.lit("b"), b)).otherwise(F.create_map(F.lit("b"), b, F.lit("a"), a))
    e = table(spark, d, "events").select(F.col("event_type").alias("name"), labels.alias("labels"), F.lit(1).cast("long").alias("value"))
    return M.series(e).select("name", F.expr("array_join(transform(labels, l -> l.key || '=' || l.value), ',')").alias("labels"), "value")


_V = "CAST(floor(value * 1000) AS BIGINT)"
_REP = "CASE WHEN v < 64 THEN v ELSE (v >> CAST(length(bin(v)) - 7 AS INTEGER)) << CAST(length(bin(v)) - 7 AS INTEGER) END"


@query(f"""WITH v AS (SELECT event_type, {_V} AS v FROM events) SELECT event_type, {_REP} AS bucket, count(*) AS n FROM v GROUP BY ALL""")
def latency_histogram(spark, d):
    e = table(spark, d, "events").select("event_type", F.floor(F.col("value") * 1000).cast("long").alias("v"))
    return M.latency_buckets(e, ["event_type"], "v")


@query(f"""WITH v AS (SELECT event_type, {_V} AS v FROM events), b AS (SELECT event_type, {_REP} AS bucket, count(*) AS n FROM v GROUP BY ALL),
    c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER (PARTITION BY event_type) AS total FROM b)
    SELECT event_type, p, min(bucket) AS value FROM c, (VALUES (CAST(50 AS DOUBLE)), (CAST(99 AS DOUBLE)), (CAST(99.9 AS DOUBLE))) q(p) WHERE cum >= least(greatest(floor(p / 100 * total), 1), total) GROUP BY ALL""")
def latency_percentiles(spark, d):
    e = table(spark, d, "events").select("event_type", F.floor(F.col("value") * 1000).cast("long").alias("v"))
    return M.percentiles(M.latency_buckets(e, ["event_type"], "v"), ["event_type"], [50.0, 99.0, 99.9])


@query(f"""WITH v AS (SELECT {_V} AS v FROM events) SELECT {_REP} AS bucket, count(*) AS n FROM v GROUP BY ALL""")
def latency_merge(spark, d):
    e = table(spark, d, "events").select("event_type", F.floor(F.col("value") * 1000).cast("long").alias("v"))
    parts = M.latency_buckets(e.withColumn("worker", F.pmod(F.hash("event_type"), F.lit(4))), ["worker"], "v")
    return M.merge_buckets(parts, [])


@query("""WITH r AS (SELECT user_id % 4 AS run, epoch_us(ts) AS started, CAST(floor(value * 1000) AS BIGINT) AS latency, event_type = 'error' AS failed FROM events)
    SELECT run, count(*) FILTER (NOT failed) AS recorded, count(*) FILTER (failed) AS errors, min(latency) FILTER (NOT failed) AS min_latency, max(latency) FILTER (NOT failed) AS max_latency, CAST(sum(latency) FILTER (NOT failed) AS BIGINT) AS sum_latency,
    CAST(floor(count(*) FILTER (NOT failed) * 1e12 / (max(started + latency) - min(started))) AS BIGINT) AS rate_millionths FROM r GROUP BY ALL""")
def load_report(spark, d):
    r = table(spark, d, "events").select(F.pmod("user_id", F.lit(4)).alias("run"), micros("ts").alias("started"), F.floor(F.col("value") * 1000).cast("long").alias("latency"), (F.col("event_type") == "error").alias("failed"))
    out = M.load_report(r.withColumn("ended", F.col("started") + F.col("latency")), ["run"])
    return out.withColumn("rate_millionths", F.floor(F.col("recorded") * F.lit(1e12) / (F.col("recorded") * F.lit(1e6) / F.col("rate"))).cast("long")).drop("rate")


@query("SELECT event_id, CAST(1000000 + floor(event_id * 250.0) AS BIGINT) AS intended, CAST(1000000 + floor(event_id * 250.0) + floor(value * 1000) AS BIGINT) AS ended, CAST(floor(value * 1000) AS BIGINT) AS corrected_latency FROM events")
def open_loop_schedule(spark, d):
    e = table(spark, d, "events").withColumn("ended", (F.lit(1000000) + F.floor(F.col("event_id") * F.lit(250.0)) + F.floor(F.col("value") * 1000)).cast("long"))
    return M.intended(e, "event_id", 1_000_000, 4000.0).select("event_id", "intended", "ended", "corrected_latency")


@query("""WITH f AS (SELECT user_id, event_id, CAST(event_type = 'error' AS INTEGER) AS bad FROM events), w AS (SELECT *, count(*) OVER r AS n, sum(bad) OVER r AS b FROM f WINDOW r AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
    SELECT user_id, event_id, CASE WHEN n >= 10 THEN CAST(b AS DOUBLE) / n ELSE CAST(0 AS DOUBLE) END AS ratio FROM w""")
def failure_ratio_window(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("failed"))
    return M.failure_ratio(e, ["user_id"], "event_id", "failed").select("user_id", "event_id", "ratio")


@query("""SELECT 'requests_total' AS name, 'requests_total{api="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type""")
def prometheus_text(spark, d):
    e = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("value"))
    return M.render_prometheus(e.select(F.lit("requests_total").alias("name"), F.create_map(F.lit("api"), F.col("event_type")).alias("labels"), "value"))
