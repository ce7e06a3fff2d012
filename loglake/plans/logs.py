"""Queries over the log itself: reads, writes, compaction, transactions, idempotence, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglake.model import BATCH_SQL, LOG_SQL, PLACE, batches, event_log, micros
from loglake.operators import compact as C
from loglake.operators import idempotent as I
from loglake.operators import read as R
from loglake.operators import resilience
from loglake.operators import retention as T
from loglake.operators import txn as X
from loglake.operators import write as W
from loglake.plans.book import Book

query = Book()
QUERIES, ORACLES = query.queries, query.oracles
WITH = f"WITH {LOG_SQL}"
WITH_BATCH = f"{WITH}, {BATCH_SQL}"


@query(f'{WITH} SELECT topic, "partition", "offset", key, value FROM log WHERE "offset" >= 100')
def log_read_from_offset(spark, d):
    return R.read_from(event_log(spark, d), 100).select(*PLACE, "offset", "key", "value")


@query(f'{WITH} SELECT topic, "partition", "offset", base_offset, key FROM log WHERE base_offset >= 100')
def log_read_whole_batches(spark, d):
    return R.read_from(event_log(spark, d), 105, whole_batches=True).select(*PLACE, "offset", "base_offset", "key")


@query(
    f"""{WITH_BATCH}, w AS (SELECT *, CAST(coalesce(sum(bytes) OVER (PARTITION BY topic, "partition" ORDER BY base_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bytes_before
    FROM batch WHERE last_offset >= 105) SELECT topic, "partition", base_offset, last_offset, bytes, bytes_before FROM w WHERE bytes_before < 5000"""
)
def log_read_byte_budget(spark, d):
    log = event_log(spark, d)
    asked = spark.createDataFrame([("events", p, 105, 5000) for p in range(4)], "topic string, partition int, fetch_offset long, max_bytes long")
    return R.byte_budget(log, asked).select(*PLACE, "base_offset", "last_offset", "bytes", "bytes_before")


@query(f"""{WITH}, s AS (SELECT DISTINCT topic, "partition", CAST("offset" // 500 * 500 AS BIGINT) AS segment_base FROM log)
    SELECT l.topic, l."partition", l."offset", max(segment_base) AS segment_base FROM log l JOIN s ON s."partition" = l."partition" AND segment_base <= "offset" WHERE "offset" % 97 = 0 GROUP BY ALL""")
def segment_lookup_asof(spark, d):
    log = event_log(spark, d)
    segments = log.where("offset % 500 = 0").select(*PLACE, F.col("offset").alias("segment_base"))
    return R.floor_lookup(log.where("offset % 97 = 0").select(*PLACE, "offset"), segments, PLACE, "offset", "segment_base")


@query(f"""{WITH} SELECT topic, "partition", "offset", max(CASE WHEN "offset" % 500 = 0 THEN "offset" END) OVER (PARTITION BY topic, "partition" ORDER BY "offset") AS segment_base FROM log""")
def segment_lookup_every_offset(spark, d):
    log = event_log(spark, d)
    segments = log.where("offset % 500 = 0").select(*PLACE, F.col("offset").alias("segment_base"))
    return R.floor_lookup(log.select(*PLACE, "offset"), segments, PLACE, "offset", "segment_base")


@query(f"""{WITH}, m AS (SELECT topic, "partition", min("offset") AS lo, max("offset") + 1 AS hi FROM log GROUP BY ALL), r(p, ts) AS (SELECT p, t FROM range(5) a(p), (VALUES (-2), (-1), (1700000000000)) b(t))
    SELECT 'events' AS topic, CAST(p AS INTEGER) AS "partition", CAST(ts AS BIGINT) AS timestamp, CAST(coalesce(CASE WHEN ts = -2 THEN lo ELSE hi END, -1) AS BIGINT) AS "offset",
    CASE WHEN hi IS NULL THEN 'UNKNOWN_TOPIC_OR_PARTITION' ELSE 'NONE' END AS error FROM r LEFT JOIN m ON p = "partition" """)
def list_offsets(spark, d):
    asked = spark.createDataFrame([("events", p, t) for p in range(5) for t in (-2, -1, 1700000000000)], "topic string, partition int, timestamp long")
    return R.list_offsets(R.watermarks(event_log(spark, d)), asked)


@query(f'{WITH} SELECT topic, "partition", min("offset") AS log_start, max("offset") + 1 AS log_end, max("offset") + 1 AS high_watermark FROM log GROUP BY ALL')
def partition_watermarks(spark, d):
    return R.watermarks(event_log(spark, d))


@query(f"""{WITH}, m AS (SELECT topic, "partition", min("offset") AS lo, max("offset") + 1 AS hi FROM log GROUP BY ALL)
    SELECT 'events' AS topic, CAST(p AS INTEGER) AS "partition", CAST(o AS BIGINT) AS fetch_offset, CASE WHEN hi IS NULL THEN 'UNKNOWN_TOPIC_OR_PARTITION' WHEN o < lo THEN 'OFFSET_OUT_OF_RANGE' ELSE 'NONE' END AS error
    FROM (SELECT p, o FROM range(5) a(p), (VALUES (-5), (0), (99999999)) b(o)) LEFT JOIN m ON p = "partition" """)
def fetch_errors(spark, d):
    asked = spark.createDataFrame([("events", p, o) for p in range(5) for o in (-5, 0, 99999999)], "topic string, partition int, fetch_offset long")
    return R.out_of_range(asked, R.watermarks(event_log(spark, d))).select(*PLACE, "fetch_offset", "error")


@query(f"""{WITH_BATCH}, w AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY topic, "partition" ORDER BY base_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM batch WHERE last_offset >= 33) SELECT topic, "partition", CAST(33 AS BIGINT) AS position, CAST(sum(record_count) AS BIGINT) AS records, max(last_offset) + 1 AS next_position FROM w WHERE before < 4000 GROUP BY ALL""")
def consumer_poll(spark, d):
    at = spark.createDataFrame([("events", p, 33) for p in range(4)], "topic string, partition int, position long")
    return R.poll(event_log(spark, d), at, 4000)


@query(f"""{WITH}, t AS (SELECT topic, count(DISTINCT "partition") AS n FROM log GROUP BY ALL)
    SELECT r.topic, CAST(n AS BIGINT) AS partitions, CASE WHEN n IS NULL THEN 'UNKNOWN_TOPIC' ELSE 'NONE' END AS error FROM (VALUES ('events'), ('absent')) r(topic) LEFT JOIN t ON t.topic = r.topic""")
def metadata_left_join(spark, d):
    topics = event_log(spark, d).groupBy("topic").agg(F.countDistinct("partition").alias("partitions"))
    return R.metadata(spark.createDataFrame([("events",), ("absent",)], "topic string"), topics)


@query(f"""{WITH_BATCH}, v AS (SELECT *, base_offset % 770 <> 700 AS valid FROM batch)
    SELECT topic, "partition", base_offset FROM v WHERE base_offset < coalesce((SELECT min(base_offset) FROM v b WHERE b."partition" = v."partition" AND NOT valid), 9223372036854775807)""")
def torn_tail_prefix(spark, d):
    parts = batches(event_log(spark, d)).withColumn("valid", F.col("base_offset") % 770 != 700)
    return R.valid_prefix(parts, PLACE, "base_offset", "valid").select(*PLACE, "base_offset")


@query(f"""{WITH}, s AS (SELECT DISTINCT "partition", CAST("offset" // 200 * 200 AS BIGINT) AS base_offset FROM log), l AS (SELECT "partition", max(base_offset) AS keep FROM s GROUP BY ALL)
    SELECT s."partition", base_offset FROM s JOIN l ON l."partition" = s."partition" WHERE base_offset < keep - 200""")
def tier_cold_prefix(spark, d):
    segments = event_log(spark, d).where("offset % 200 = 0").select("partition", F.col("offset").alias("base_offset"))
    last = segments.groupBy("partition").agg((F.max("base_offset") - 200).alias("_keep"))
    local = segments.join(last, "partition").where("base_offset >= _keep").drop("_keep")
    return R.cold_prefix(segments, local, ["partition", "base_offset"])


COMPACT = """SELECT topic, "partition", "offset", key, value FROM (SELECT *, row_number() OVER (PARTITION BY topic, "partition", key ORDER BY "offset" DESC) AS k FROM log WHERE key IS NOT NULL) WHERE k = 1"""


@query(f"{WITH} {COMPACT} AND value IS NOT NULL")
def log_compaction(spark, d):
    return C.compact(event_log(spark, d)).select(*PLACE, "offset", "key", "value")


@query(f"{WITH} {COMPACT}")
def log_compaction_retain_tombstones(spark, d):
    return C.compact(event_log(spark, d), retain_tombstones=True).select(*PLACE, "offset", "key", "value")


KEYLESS = LOG_SQL.replace("CAST(user_id AS VARCHAR) AS key", "CASE WHEN event_type <> 'view' THEN CAST(user_id AS VARCHAR) END AS key")


def _keyless(spark, d):
    return event_log(spark, d).withColumn("key", F.when(F.col("event_type") != "view", F.col("key")))


@query(f'WITH {KEYLESS} {COMPACT} AND value IS NOT NULL UNION ALL SELECT topic, "partition", "offset", key, value FROM log WHERE key IS NULL')
def log_compaction_keyless(spark, d):
    return C.compact(_keyless(spark, d)).select(*PLACE, "offset", "key", "value")


@query(f"""WITH {KEYLESS}, k AS (SELECT topic, "partition", key, count(*) AS n, arg_max(value IS NULL, "offset") AS dead FROM log WHERE key IS NOT NULL GROUP BY ALL),
    b AS (SELECT topic, "partition", count(*) AS n FROM log WHERE key IS NULL GROUP BY ALL), a AS (SELECT topic, "partition", sum(n) AS n, count(*) AS keys, sum(CAST(dead AS INTEGER)) AS dead FROM k GROUP BY ALL)
    SELECT a.topic, a."partition", CAST(a.n + b.n AS BIGINT) AS records_in, CAST(keys - dead + b.n AS BIGINT) AS kept, CAST(a.n - keys AS BIGINT) AS superseded, CAST(dead AS BIGINT) AS tombstones_dropped
    FROM a JOIN b ON a."partition" = b."partition" """)
def compaction_stats(spark, d):
    return C.compaction_stats(_keyless(spark, d))


@query("SELECT conv_id, turn, text AS value FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k = 1")
def changelog_latest(spark, d):
    log = spark.read.parquet(f"{d}/conversations.parquet").select(F.lit("conversations").alias("topic"), F.lit(0).alias("partition"), F.col("conv_id").alias("key"), F.col("turn").alias("offset"), F.col("text").alias("value"))
    return C.compact(log).select(F.col("key").alias("conv_id"), F.col("offset").alias("turn"), "value")


@query(f'{WITH} SELECT topic, "partition", arrival, CAST("offset" + 1000 AS BIGINT) AS "offset" FROM log')
def append_offsets(spark, d):
    new = event_log(spark, d).drop("offset", "base_offset")
    ends = spark.createDataFrame([("events", p, 1000) for p in range(4)], "topic string, partition int, log_end long")
    return W.append(new, "arrival", ends).select(*PLACE, "arrival", "offset")


_SEGMENTS = """RECURSIVE {log}, {batch}, o AS (SELECT *, row_number() OVER (PARTITION BY "partition" ORDER BY base_offset) AS k FROM batch),
    f AS (SELECT "partition", k, base_offset, CAST(0 AS BIGINT) AS segment, bytes AS used FROM o WHERE k = 1 UNION ALL
      SELECT o."partition", o.k, o.base_offset, CASE WHEN used >= 6000 THEN segment + 1 ELSE segment END, CASE WHEN used >= 6000 THEN o.bytes ELSE used + o.bytes END FROM f JOIN o ON o."partition" = f."partition" AND o.k = f.k + 1)"""


@query(f"WITH {_SEGMENTS.format(log=LOG_SQL, batch=BATCH_SQL)} SELECT 'events' AS topic, \"partition\", base_offset, segment FROM f")
def segment_roll(spark, d):
    return W.greedy_segments(batches(event_log(spark, d)), 6000)


@query(f"""WITH RECURSIVE {LOG_SQL}, {BATCH_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY "partition" ORDER BY base_offset) AS k FROM batch),
    f AS (SELECT "partition", k, base_offset, false AS hit, bytes AS since FROM o WHERE k = 1 UNION ALL
      SELECT o."partition", o.k, o.base_offset, since >= 4096, CASE WHEN since >= 4096 THEN o.bytes ELSE since + o.bytes END FROM f JOIN o ON o."partition" = f."partition" AND o.k = f.k + 1)
    SELECT 'events' AS topic, "partition", base_offset AS anchor FROM f WHERE hit""")
def sparse_index_anchors(spark, d):
    return W.index_anchors(batches(event_log(spark, d)), 4096)


@query(f"""WITH {_SEGMENTS.format(log=LOG_SQL, batch=BATCH_SQL)} SELECT 'events' AS topic, f."partition", max(last_offset) + 1 AS recovery_point FROM f JOIN batch b ON b."partition" = f."partition" AND b.base_offset = f.base_offset
    WHERE segment < (SELECT max(segment) FROM f g WHERE g."partition" = f."partition") GROUP BY ALL""")
def recovery_point(spark, d):
    return W.recovery_point(batches(event_log(spark, d)), 6000)


@query(f"""{WITH} SELECT 'events-dlq' AS topic, "partition", "offset", key, concat_ws(';', 'x-dlq-topic=' || topic, 'x-dlq-partition=' || "partition", 'x-dlq-offset=' || "offset", 'x-dlq-error=' || event_type, 'x-dlq-attempts=5') AS headers
    FROM log WHERE event_type = 'error'""")
def dead_letter_route(spark, d):
    failed = event_log(spark, d).where("event_type = 'error'").withColumn("headers", F.expr("cast(array() AS array<struct<key:string,value:binary>>)"))
    out = W.dead_letters(failed, "events-dlq", F.col("event_type"), F.lit(5))
    return out.select(*PLACE, "offset", "key", F.expr("array_join(transform(headers, h -> h.key || '=' || cast(h.value AS string)), ';')").alias("headers"))


@query(f'{WITH} SELECT topic, "partition", "offset" FROM log WHERE base_offset < 300')
def truncate_suffix(spark, d):
    return W.truncate_suffix(event_log(spark, d), 300).select(*PLACE, "offset")


TXN = f"""{WITH}, n AS (SELECT *, coalesce(sum(CAST(is_control AS INTEGER)) OVER (PARTITION BY "partition", producer_id ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS txn_no FROM log),
    t AS (SELECT topic, "partition", producer_id, CAST(txn_no AS BIGINT) AS txn_no, min("offset") FILTER (NOT is_control) AS first_offset, max("offset") FILTER (is_control) AS marker_offset, max(decision) AS decision FROM n GROUP BY ALL HAVING first_offset IS NOT NULL),
    l AS (SELECT m."partition", hwm, least(hwm, (SELECT min(first_offset) FROM t WHERE t."partition" = m."partition" AND marker_offset IS NULL)) AS lso FROM (SELECT "partition", max("offset") + 1 AS hwm FROM log GROUP BY ALL) m)"""


@query(f"{TXN} SELECT * FROM t")
def txn_ranges(spark, d):
    return X.transactions(event_log(spark, d))


@query(f"{TXN} SELECT 'events' AS topic, \"partition\", hwm AS high_watermark, lso FROM l")
def last_stable_offset(spark, d):
    log = event_log(spark, d)
    return X.last_stable_offset(X.transactions(log), R.watermarks(log))


@query(f"{TXN} SELECT topic, \"partition\", producer_id, first_offset, marker_offset FROM t WHERE decision = 'ABORT' AND marker_offset > 200 AND marker_offset >= 100")
def aborted_transactions(spark, d):
    return X.aborted(X.transactions(event_log(spark, d)), 200, 100).select(*PLACE, "producer_id", "first_offset", "marker_offset")


@query(f"""{TXN} SELECT n.topic, n."partition", n."offset", n.producer_id, n.key FROM n JOIN t ON t."partition" = n."partition" AND t.producer_id = n.producer_id AND t.txn_no = n.txn_no JOIN l ON l."partition" = n."partition"
    WHERE NOT is_control AND t.decision = 'COMMIT' AND n."offset" < lso""")
def read_committed(spark, d):
    log = event_log(spark, d)
    return X.read_committed(log, X.last_stable_offset(X.transactions(log), R.watermarks(log))).select(*PLACE, "offset", "producer_id", "key")


@query(f"""{TXN} SELECT n.topic, n."partition", n."offset" FROM n WHERE NOT is_control AND NOT EXISTS (SELECT 1 FROM t WHERE t.decision = 'ABORT' AND t."partition" = n."partition" AND t.producer_id = n.producer_id AND n."offset" >= first_offset AND n."offset" < marker_offset)""")
def aborted_range_antijoin(spark, d):
    log = event_log(spark, d)
    return X.drop_aborted(log.withColumn("base_offset", F.col("offset")), X.aborted(X.transactions(log))).select(*PLACE, "offset")


@query(f"""{WITH}, u AS (SELECT "partition", producer_id, arrival, epoch_us(ts) AS us FROM log), g AS (SELECT *, coalesce(lead(us) OVER (PARTITION BY producer_id ORDER BY us, "partition", arrival), 1706659200000000) - us AS idle_micros FROM u)
    SELECT producer_id, arrival, CAST(idle_micros AS BIGINT) AS idle_micros FROM g WHERE idle_micros > 18000000000""")
def txn_timeout(spark, d):
    act = event_log(spark, d).select("producer_id", micros("ts").alias("us"), "partition", "arrival")
    return X.timed_out(act, ["producer_id"], "us", 18_000_000_000, _NOW).select("producer_id", "arrival", F.col("idle_micros").cast("long").alias("idle_micros"))


@query("""SELECT CAST(user_id % 15 AS VARCHAR) AS transactional_id, CAST(event_id // 500 AS BIGINT) AS txn_no, array_to_string(list_sort(list_distinct(list('events-' || (user_id % 4)))), ',') AS participants FROM events GROUP BY ALL""")
def txn_participants(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    added = e.select(F.pmod("user_id", F.lit(15)).cast("string").alias("transactional_id"), F.floor(F.col("event_id") / 500).cast("long").alias("txn_no"), F.lit("events").alias("topic"), F.pmod("user_id", F.lit(4)).alias("partition"))
    return X.participants(added).select("transactional_id", "txn_no", F.expr("array_join(transform(participants, p -> p.topic || '-' || p.partition), ',')").alias("participants"))


@query("""WITH e AS (SELECT event_id % 7 AS p, event_id, (event_id * 31) % 11 AS epoch FROM events), s AS (SELECT *, max(epoch) OVER (PARTITION BY p ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM e)
    SELECT p, event_id, epoch FROM s WHERE seen IS NULL OR epoch >= seen""")
def marker_fencing(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select((F.col("event_id") % 7).alias("p"), "event_id", (F.col("event_id") * 31 % 11).alias("epoch"))
    return X.fence(e, ["p"], "event_id", "epoch")


_SENT = f"""{WITH}, s AS (SELECT topic, "partition", producer_id, CAST(0 AS INTEGER) AS producer_epoch, CAST(row_number() OVER (PARTITION BY producer_id ORDER BY arrival) - 1 AS BIGINT) AS base_sequence, arrival FROM log),
    b AS (SELECT *, arrival * 2 AS seq_at FROM s UNION ALL SELECT *, arrival * 2 + 1 FROM s WHERE arrival % 7 = 0)"""


def _sent(spark, d):
    from pyspark.sql import Window

    log = event_log(spark, d)
    seq = F.row_number().over(Window.partitionBy("producer_id").orderBy("arrival")) - 1
    s = log.select(*PLACE, "producer_id", F.lit(0).alias("producer_epoch"), seq.cast("long").alias("base_sequence"), F.lit(1).alias("record_count"), "arrival")
    twice = s.where("arrival % 7 = 0").withColumn("arrival", F.col("arrival") * 2 + 1)
    return s.withColumn("arrival", F.col("arrival") * 2).unionByName(twice)


@query(f'{_SENT} SELECT topic, "partition", producer_id, base_sequence, min(seq_at) AS arrival FROM b GROUP BY ALL')
def idempotent_dedup(spark, d):
    return I.dedup(_sent(spark, d)).select(*PLACE, "producer_id", "base_sequence", "arrival")


@query(f"{_SENT} SELECT topic, \"partition\", producer_id, seq_at AS arrival, CASE WHEN seq_at % 2 = 1 THEN 'Duplicate' ELSE 'Accept' END AS verdict FROM b")
def idempotent_classify(spark, d):
    return I.classify(_sent(spark, d)).select(*PLACE, "producer_id", "arrival", "verdict")


@query(f"""{_SENT}, a AS (SELECT *, CAST(sum(CASE WHEN seq_at % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY "partition" ORDER BY seq_at ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS o FROM b)
    SELECT topic, "partition", seq_at AS arrival, o AS last_offset FROM a""")
def idempotent_produce(spark, d):
    return I.produce(_sent(spark, d)).select(*PLACE, "arrival", "last_offset")


#: Sends of three epochs per producer: each counts its own from 0; some come again, skip ahead or bear an older epoch.
_MIXED = f"""{WITH}, e AS (SELECT topic, "partition", producer_id, arrival, CAST(arrival // 300 % 3 AS INTEGER) AS epoch FROM log),
    s AS (SELECT *, row_number() OVER (PARTITION BY "partition", producer_id, epoch ORDER BY arrival) - 1 AS n, row_number() OVER (PARTITION BY "partition", producer_id ORDER BY arrival) AS k FROM e),
    b AS (SELECT topic, "partition", producer_id, arrival, k, CAST(CASE WHEN arrival % 13 = 5 THEN greatest(epoch - 1, 0) ELSE epoch END AS INTEGER) AS producer_epoch,
      CAST(greatest(0, CASE WHEN arrival % 11 = 3 THEN 2 * n + 4 WHEN arrival % 7 = 2 THEN 2 * n - 2 WHEN arrival % 17 = 4 THEN 2 * n - 1 ELSE 2 * n END) AS BIGINT) AS base_sequence, 2 AS record_count FROM s)"""


def _mixed(spark, d):
    from pyspark.sql import Window

    e = event_log(spark, d).select(*PLACE, "producer_id", "arrival", F.expr("cast(arrival div 300 % 3 AS int)").alias("epoch"))
    e = e.withColumn("n", F.row_number().over(Window.partitionBy("partition", "producer_id", "epoch").orderBy("arrival")) - 1)
    sequence = "greatest(0, CASE WHEN arrival % 11 = 3 THEN 2 * n + 4 WHEN arrival % 7 = 2 THEN 2 * n - 2 WHEN arrival % 17 = 4 THEN 2 * n - 1 ELSE 2 * n END)"
    epoch = "CASE WHEN arrival % 13 = 5 THEN greatest(epoch - 1, 0) ELSE epoch END"
    return e.select(*PLACE, "producer_id", "arrival", F.expr(epoch).cast("int").alias("producer_epoch"), F.expr(sequence).cast("long").alias("base_sequence"), F.lit(2).alias("record_count"))


_VERDICT = """CASE WHEN b.producer_epoch < f.e THEN 'Fenced' WHEN b.producer_epoch > f.e THEN CASE WHEN b.base_sequence = 0 THEN 'Accept' ELSE 'Gap' END
      WHEN b.base_sequence = f.l + 1 THEN 'Accept' WHEN b.base_sequence > f.l + 1 THEN 'Gap' WHEN b.base_sequence + 1 <= f.l THEN 'Duplicate' ELSE 'Gap' END"""


@query(f"""{_MIXED.replace("WITH", "WITH RECURSIVE", 1)}, f AS (SELECT "partition", producer_id, CAST(0 AS BIGINT) AS k, min_by(producer_epoch, k) AS e, CAST(-1 AS BIGINT) AS l, CAST(NULL AS VARCHAR) AS verdict FROM b GROUP BY ALL
    UNION ALL SELECT b."partition", b.producer_id, b.k, CASE WHEN {_VERDICT} = 'Accept' THEN b.producer_epoch ELSE f.e END, CASE WHEN {_VERDICT} = 'Accept' THEN b.base_sequence + 1 ELSE f.l END, {_VERDICT}
      FROM f JOIN b ON b."partition" = f."partition" AND b.producer_id = f.producer_id AND b.k = f.k + 1)
    SELECT b.topic, b."partition", b.producer_id, b.arrival, verdict FROM f JOIN b ON b."partition" = f."partition" AND b.producer_id = f.producer_id AND b.k = f.k""")
def idempotent_verdicts(spark, d):
    return I.classify(_mixed(spark, d)).select(*PLACE, "producer_id", "arrival", "verdict")


_ASKED = f"""{WITH}, r AS (SELECT CASE WHEN user_id % 9 = 0 THEN 'absent' ELSE topic END AS topic, "partition", arrival, arrival % 10 <> 3 AS valid, CASE WHEN arrival % 17 = 0 OR "partition" = 3 THEN 'compatible' ELSE 'native' END AS protocol, CAST(1 + arrival % 3 AS INTEGER) AS record_count FROM log)"""


def _asked(spark, d):
    return event_log(spark, d).select(
        F.expr("CASE WHEN user_id % 9 = 0 THEN 'absent' ELSE topic END").alias("topic"), "partition", "arrival", F.expr("arrival % 10 <> 3").alias("valid"),
        F.expr("CASE WHEN arrival % 17 = 0 OR partition = 3 THEN 'compatible' ELSE 'native' END").alias("protocol"), F.expr("cast(1 + arrival % 3 AS int)").alias("record_count"),
    )


@query(f"""{_ASKED}, o AS (SELECT *, (SELECT arg_min(protocol, arrival) FROM r c WHERE c.topic = r.topic AND c."partition" = r."partition" AND c.valid) AS owner FROM r),
    e AS (SELECT *, CASE WHEN topic = 'absent' THEN 'UnknownTopicOrPartition' WHEN NOT valid THEN 'CorruptMessage' WHEN protocol <> owner THEN 'InvalidRequest' ELSE 'None' END AS error_code FROM o),
    s AS (SELECT *, sum(CASE WHEN error_code = 'None' THEN record_count ELSE 0 END) OVER (PARTITION BY topic, "partition" ORDER BY arrival ROWS UNBOUNDED PRECEDING) AS upto FROM e)
    SELECT topic, "partition", arrival, error_code, CAST(CASE WHEN error_code = 'None' THEN 1000 + upto - record_count END AS BIGINT) AS base_offset FROM s""")
def produce_outcomes(spark, d):
    catalog = spark.createDataFrame([("events", p, 1000) for p in range(4)], "topic string, partition int, log_end long")
    return W.produce_outcomes(_asked(spark, d), catalog).select(*PLACE, "arrival", "error_code", "base_offset")


@query(f"""{WITH}, m AS (SELECT "partition", min("offset") AS lo, max("offset") + 1 AS hi FROM log GROUP BY ALL), q AS (SELECT CAST(p AS INTEGER) AS p, o FROM range(5) a(p), (VALUES (-5), (0), (99999999)) b(o)),
    e AS (SELECT q.*, lo, hi, CASE WHEN hi IS NULL THEN 'UnknownTopicOrPartition' WHEN p = 3 THEN 'InvalidRequest' WHEN o < lo THEN 'OffsetOutOfRange' ELSE 'None' END AS error_code FROM q LEFT JOIN m ON m."partition" = p)
    SELECT 'events' AS topic, p AS "partition", CAST(o AS BIGINT) AS fetch_offset, error_code, CASE WHEN error_code = 'None' THEN hi END AS high_watermark, CASE WHEN error_code = 'None' THEN lo END AS log_start FROM e""")
def fetch_outcomes(spark, d):
    asked = spark.createDataFrame([("events", p, o) for p in range(5) for o in (-5, 0, 99999999)], "topic string, partition int, fetch_offset long")
    marks = R.watermarks(event_log(spark, d)).withColumn("protocol", F.expr("CASE partition WHEN 3 THEN 'compatible' WHEN 2 THEN cast(null AS string) ELSE 'native' END"))
    return R.fetch_outcomes(asked, marks)


_DECIDED = """decided AS (SELECT user_id % 16 AS producer_id, CAST(event_id % 5 AS INTEGER) AS producer_epoch, CASE WHEN value >= 25 THEN 'COMMIT' ELSE 'ABORT' END AS decision, CAST(event_id * 7919 % 4294967296 - 2147483648 AS INTEGER) AS coordinator_epoch, event_id FROM events WHERE event_type = 'signup')"""


@query(f"""WITH {_DECIDED} SELECT 'events' AS topic, CAST(p AS INTEGER) AS "partition", producer_id, producer_epoch, 48 AS attrs, 1 AS record_count, CASE decision WHEN 'COMMIT' THEN '00000001' ELSE '00000000' END AS key,
    '0000' || upper(printf('%08x', (CAST(coordinator_epoch AS BIGINT) + 4294967296) % 4294967296)) AS value, decision, coordinator_epoch, CAST(NULL AS VARCHAR) AS error FROM decided, range(2) r(p)""")
def control_batches(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").where("event_type = 'signup'")
    decided = e.select(F.pmod("user_id", F.lit(16)).alias("producer_id"), F.expr("cast(event_id % 5 AS int)").alias("producer_epoch"), F.expr("CASE WHEN value >= 25 THEN 'COMMIT' ELSE 'ABORT' END").alias("decision"), F.expr("cast(event_id * 7919 % 4294967296 - 2147483648 AS int)").alias("coordinator_epoch"), F.expr("array(struct('events' AS topic, 0 AS partition), struct('events' AS topic, 1 AS partition))").alias("participants"))
    return X.parse_markers(X.control_batches(decided)).withColumn("key", F.hex("key")).withColumn("value", F.hex("value"))


@query(f"""{WITH}, b AS (SELECT "partition", "offset", CAST(CASE "offset" % 8 WHEN 0 THEN 16 ELSE 48 END AS INTEGER) AS attrs FROM log), e AS (SELECT *, CASE "offset" % 8 WHEN 0 THEN 'InvalidArgument' WHEN 1 THEN 'InvalidArgument' WHEN 2 THEN 'Corrupt' WHEN 3 THEN 'Unsupported' WHEN 4 THEN 'Corrupt' END AS error FROM b)
    SELECT "partition", "offset", error, CASE WHEN error IS NULL THEN CASE WHEN "offset" % 8 = 5 THEN 'ABORT' ELSE 'COMMIT' END END AS decision, CAST(CASE WHEN error IS NULL THEN "offset" % 256 END AS INTEGER) AS coordinator_epoch FROM e""")
def control_batch_parse(spark, d):
    b = event_log(spark, d).select("partition", "offset", F.expr("CASE offset % 8 WHEN 0 THEN 16 ELSE 48 END").alias("attrs"), F.expr("CASE offset % 8 WHEN 1 THEN 2 ELSE 1 END").alias("record_count"))
    key = "unhex(CASE offset % 8 WHEN 2 THEN '000000' WHEN 3 THEN '00010000' WHEN 4 THEN '00000002' WHEN 5 THEN '00000000' ELSE '00000001' END)"
    b = b.withColumn("key", F.expr(key)).withColumn("value", F.expr("unhex('0000000000' || lpad(hex(offset % 256), 2, '0'))"))
    return X.parse_markers(b).select("partition", "offset", "error", "decision", "coordinator_epoch")


@query()
def txn_coordinator_fold(spark, d):
    from pyspark.sql import Window

    kind = "CASE WHEN event_id < 40 OR event_id % 90 = 0 THEN 'init' ELSE CASE event_id % 9 WHEN 0 THEN 'begin' WHEN 1 THEN 'begin' WHEN 5 THEN 'commit' WHEN 6 THEN 'ack' WHEN 7 THEN 'abort' WHEN 8 THEN 'tick' ELSE 'add' END END"
    e = spark.read.parquet(f"{d}/events.parquet").select(F.expr("user_id % 5").alias("id"), "event_id", F.expr(kind).alias("op"), micros("ts").alias("now"), F.expr("array('events', cast(user_id % 2 AS string))").alias("part"), F.col("event_id").alias("new_id"), F.lit(3_600_000_000).alias("timeout"))
    # requests bear the epoch of the latest init, some an older one
    inits = F.sum((F.col("op") == "init").cast("int")).over(Window.partitionBy("id").orderBy("event_id"))
    e = e.withColumn("epoch", (inits - 1 - (F.col("event_id") % 23 == 0).cast("int")).cast("int"))
    return resilience.fold(e, ["id"], "event_id", X.coordinate, "string")


_EPOCH = "CAST(((arrival * 37) % 101) // 20 AS INTEGER)"


@query(f"""{WITH}, e AS (SELECT topic, "partition", producer_id, arrival, {_EPOCH} AS producer_epoch FROM log), k AS (SELECT *, max(producer_epoch) OVER (PARTITION BY "partition", producer_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known_epoch FROM e)
    SELECT topic, "partition", producer_id, arrival, producer_epoch, known_epoch FROM k WHERE producer_epoch < known_epoch""")
def producer_fencing(spark, d):
    e = event_log(spark, d).withColumn("producer_epoch", F.expr("cast(((arrival * 37) % 101) div 20 AS int)"))
    return I.fenced(e).select(*PLACE, "producer_id", "arrival", "producer_epoch", "known_epoch")


_RETAIN = """s AS (SELECT b.*, (SELECT max(epoch_us(ts)) FROM log l WHERE l."partition" = b."partition" AND l.base_offset = b.base_offset) AS mtime FROM batch b),
    w AS (SELECT *, sum(bytes) OVER (PARTITION BY "partition" ORDER BY base_offset DESC ROWS UNBOUNDED PRECEDING) AS rest, lead(base_offset) OVER (PARTITION BY "partition" ORDER BY base_offset) IS NULL AS active FROM s)"""


def _segments(spark, d):
    log = event_log(spark, d)
    return log.groupBy(*PLACE, "base_offset").agg(F.sum("encoded_size").alias("bytes"), F.max(micros("ts")).alias("mtime"))


def _retained(rule: str) -> str:
    return f"""{WITH_BATCH}, {_RETAIN}, g AS (SELECT *, min(CAST(({rule}) AND NOT active AS INTEGER)) OVER (PARTITION BY "partition" ORDER BY base_offset ROWS UNBOUNDED PRECEDING) AS gone FROM w)
    SELECT topic, "partition", base_offset FROM g WHERE gone = 0"""


@query(_retained("rest > 60000"))
def retention_by_size(spark, d):
    return T.retain(_segments(spark, d), retention_bytes=60000).select(*PLACE, "base_offset")


_NOW = 1706659200000000  # 2024-01-31


@query(_retained(f"{_NOW} - mtime > 864000000000"))
def retention_by_age(spark, d):
    return T.retain(_segments(spark, d), retention_micros=864_000_000_000, now_micros=_NOW).select(*PLACE, "base_offset")


@query(_retained(f"rest > 90000 OR {_NOW} - mtime > 1728000000000"))
def retention_sweep(spark, d):
    limits = spark.createDataFrame([("events", 90000, 1_728_000_000_000)], "topic string, retention_bytes long, retention_micros long")
    return T.retain_by_topic(_segments(spark, d), limits, _NOW).select(*PLACE, "base_offset")


@query(f"""{WITH_BATCH}, n AS (SELECT *, lead(base_offset) OVER (PARTITION BY "partition" ORDER BY base_offset) AS nxt FROM batch) SELECT topic, "partition", base_offset FROM n WHERE nxt IS NULL OR nxt > 155""")
def truncate_prefix(spark, d):
    return T.truncate_prefix(batches(event_log(spark, d)), 155).select(*PLACE, "base_offset")


@query(f"""{WITH_BATCH} SELECT topic, "partition", base_offset, CASE WHEN lead(base_offset) OVER (PARTITION BY "partition" ORDER BY base_offset) IS NULL THEN 'hot' ELSE 'cold' END AS tier FROM batch""")
def tier_offload(spark, d):
    return T.offload(batches(event_log(spark, d))).select(*PLACE, "base_offset", "tier")


@query(f"""{WITH} SELECT topic, "partition", "offset", CASE WHEN "offset" < 100 THEN 'cold' ELSE 'hot' END AS tier FROM log WHERE "offset" >= 50""")
def tiered_read(spark, d):
    log = event_log(spark, d)
    both = log.where("offset < 100").withColumn("tier", F.lit("cold")).unionByName(log.where("offset >= 100").withColumn("tier", F.lit("hot")))
    return R.read_from(both, 50).select(*PLACE, "offset", "tier")
