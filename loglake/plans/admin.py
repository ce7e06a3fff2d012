"""Queries of the administration facade, replicated logs as a whole, exposition text, and relational forms beside them."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from loglake.model import LOG_SQL, PLACE, event_log, table
from loglake.operators import admin as A
from loglake.operators import catalog as K
from loglake.operators import groups as G
from loglake.operators import metrics as M
from loglake.operators import quorum as Q
from loglake.operators import read as R
from loglake.operators import txn as X
from loglake.operators import write as W
from loglake.plans.book import Book

query = Book()
QUERIES, ORACLES = query.queries, query.oracles
WITH = f"WITH {LOG_SQL}"
STATE = f"""{WITH}, m AS (SELECT topic, "partition", min("offset") AS log_start, max("offset") + 1 AS hwm FROM log GROUP BY ALL), c AS (SELECT event_type AS "group", topic, "partition", arg_max("offset", arrival) AS "offset" FROM log GROUP BY ALL),
    t AS (SELECT topic, CAST(n AS INTEGER) AS partitions FROM (VALUES ('events', 4), ('idle', 1), ('audit', 2)) v(topic, n)),
    g AS (SELECT event_type AS "group", count(DISTINCT user_id % 3) AS members FROM log GROUP BY ALL), l AS (SELECT c.*, hwm, greatest(hwm - c."offset", 0) AS lag FROM c JOIN m ON m."partition" = c."partition")"""
GROUPS = """SELECT g."group", members, count(*) AS partitions, CAST(sum(lag) AS BIGINT) AS total_lag FROM g JOIN l ON l."group" = g."group" GROUP BY ALL"""


def _admin(spark, d):
    log = event_log(spark, d)
    commits = log.select(F.col("event_type").alias("group"), *PLACE, "offset", F.col("arrival").alias("commit_seq"))
    members = log.select(F.col("event_type").alias("group"), F.pmod("user_id", F.lit(3)).alias("member"))
    replicated = spark.createDataFrame([("events", 2, "follower", 3, 10, 12)], "topic string, partition int, role string, term long, commit_index long, last_index long")
    catalog = spark.createDataFrame([("events", 4), ("idle", 1), ("audit", 2)], "topic string, partitions int")
    return A.Admin(catalog, R.watermarks(log), G.committed(commits), members, replicated)


@query(f"{STATE} SELECT topic, partitions FROM t ORDER BY topic LIMIT 2 OFFSET 2")
def admin_topics_page(spark, d):
    return _admin(spark, d).get("/topics?page=2&size=2")


@query(f"""{STATE} SELECT t.topic, partitions, "partition", hwm AS high_watermark FROM t JOIN m ON m.topic = t.topic""")
def admin_topic(spark, d):
    return _admin(spark, d).get("/topics/events")


@query(f"{STATE} {GROUPS}")
def admin_groups(spark, d):
    return _admin(spark, d).get("/groups")


@query(f"""{STATE} SELECT "group", topic, "partition", "offset", hwm AS high_watermark, lag FROM l WHERE "group" = 'purchase'""")
def admin_group(spark, d):
    return _admin(spark, d).get("/groups/purchase")


@query(f"""{STATE} SELECT topic, "partition", CASE "partition" WHEN 2 THEN 'follower' ELSE 'leader' END AS role, CAST(CASE "partition" WHEN 2 THEN 3 ELSE 0 END AS BIGINT) AS term, CAST(CASE "partition" WHEN 2 THEN 10 ELSE hwm END AS BIGINT) AS commit_index, CAST(CASE "partition" WHEN 2 THEN 12 ELSE hwm END AS BIGINT) AS last_index FROM m""")
def admin_cluster(spark, d):
    return _admin(spark, d).get("/cluster")


@query(f"""{STATE} SELECT "partition", log_start, hwm AS high_watermark FROM m""")
def command_partitions(spark, d):
    return _admin(spark, d).command("partitions", "events")


@query(f"{STATE} SELECT * FROM ({GROUPS}) WHERE \"group\" = 'error'")
def command_group_describe(spark, d):
    return _admin(spark, d).command("group", "describe", "error")


@query("""SELECT protocol, api, CAST(a AS INTEGER) AS oldest, CAST(b AS INTEGER) AS newest FROM (SELECT 'native' AS protocol, unnest(['ApiVersions', 'Metadata', 'Produce', 'Fetch', 'CreateTopic', 'DeleteTopic', 'OffsetCommit', 'OffsetFetch', 'JoinGroup', 'SyncGroup', 'Heartbeat', 'LeaveGroup']) AS api, 0 AS a, 0 AS b
    UNION ALL SELECT 'compatible', * FROM (VALUES ('Produce', 0, 9), ('Fetch', 0, 12), ('ListOffsets', 0, 7), ('Metadata', 0, 9), ('ApiVersions', 0, 3)) v(api, a, b))""")
def api_versions(spark, d):
    return A.api_versions(spark)


@query(f"""{WITH} SELECT topic, "partition", count(*) AS n FROM (SELECT CASE WHEN user_id % 5 = 0 THEN 'old' ELSE topic END AS topic, "partition" FROM log) WHERE topic <> 'old' GROUP BY ALL""")
def topic_delete(spark, d):
    log = event_log(spark, d).withColumn("topic", F.expr("CASE WHEN user_id % 5 = 0 THEN 'old' ELSE topic END"))
    _, left = K.delete_topic(log.select("topic").distinct(), log, "old")
    return left.groupBy(*PLACE).agg(F.count("*").alias("n"))


@query(f"""{WITH}, m AS (SELECT topic, "partition", min("offset") AS lo, max("offset") + 1 AS hi FROM log GROUP BY ALL) SELECT topic, "partition", CAST(CASE WHEN "partition" = 1 THEN 500 ELSE lo END AS BIGINT) AS log_start, CAST(CASE WHEN "partition" = 1 THEN 500 ELSE hi END AS BIGINT) AS log_end FROM m""")
def log_reset(spark, d):
    log = event_log(spark, d)
    resets = spark.createDataFrame([("events", 1, 500)], "topic string, partition int, base long")
    left, marks = W.reset(log, R.watermarks(log), resets)
    return marks.join(left.groupBy(*PLACE).agg(F.count("*").alias("n")), PLACE, "left").where("(n IS NULL) = (partition = 1)").select(*PLACE, "log_start", "log_end")


_RAFT = f"""{WITH}, e AS (SELECT topic, "partition", "offset" AS index, "offset" // 100 AS term FROM log), s AS (SELECT topic, "partition", max("offset") AS last, max("offset") - 30 * ("partition" + 1) AS commit, CASE "partition" WHEN 2 THEN max("offset") - 95 ELSE 10 END AS snapshot FROM log GROUP BY topic, "partition")"""


def _raft(spark, d):
    log = event_log(spark, d)
    entries = log.select(*PLACE, F.col("offset").alias("index"), F.expr("offset div 100").alias("term"))
    state = log.groupBy(*PLACE).agg(F.max("offset").alias("last_index")).select(*PLACE, "last_index", F.expr("last_index - 30 * (partition + 1)").alias("commit_index"), F.expr("CASE partition WHEN 2 THEN last_index - 95 ELSE 10L END").alias("snapshot_index"))
    return entries, state


@query(f"""{_RAFT} SELECT e.topic, e."partition", index, term FROM e JOIN s ON s."partition" = e."partition" WHERE index > CASE WHEN commit > snapshot AND commit - snapshot >= 50 THEN commit ELSE snapshot END""")
def raft_compaction(spark, d):
    return Q.compact_entries(*_raft(spark, d), 50)


@query(f"""{_RAFT}, i AS (SELECT e.topic, e."partition", index, CASE WHEN index > last - 40 AND e."partition" <> 3 THEN term + 1 ELSE term END AS term FROM e JOIN s ON s."partition" = e."partition" WHERE index > last - 60 UNION ALL SELECT topic, "partition", last + 1, 99 FROM s),
    c AS (SELECT s."partition", coalesce(min(i.index) FILTER (l.term IS NULL OR l.term <> i.term), 9223372036854775807) AS cut FROM s JOIN i ON i."partition" = s."partition" LEFT JOIN e l ON l."partition" = i."partition" AND l.index = i.index GROUP BY ALL)
    SELECT e.topic, e."partition", index, term FROM e JOIN c ON c."partition" = e."partition" WHERE index < cut UNION ALL SELECT i.topic, i."partition", index, term FROM i JOIN c ON c."partition" = i."partition" WHERE index >= cut""")
def raft_append(spark, d):
    entries, state = _raft(spark, d)
    near = entries.join(state.select(*PLACE, "last_index"), PLACE)
    term = F.when((F.col("index") > F.col("last_index") - 40) & (F.col("partition") != 3), F.col("term") + 1).otherwise(F.col("term"))
    incoming = near.where("index > last_index - 60").select(*PLACE, "index", term.alias("term")).unionByName(state.select(*PLACE, (F.col("last_index") + 1).alias("index"), F.lit(99).cast("long").alias("term")))
    return Q.append_entries(entries, incoming)


@query(f"""{_RAFT} SELECT topic, "partition", CAST(greatest(last - commit, 0) AS BIGINT) AS uncommitted FROM s""")
def raft_backlog(spark, d):
    return Q.backlog(_raft(spark, d)[1]).select(*PLACE, "uncommitted")


@query(f"""{WITH} SELECT topic, "partition", "offset", CASE WHEN "offset" < 20 THEN 0 ELSE ("offset" - 20) // 50 * 50 + 20 END AS anchor, CASE WHEN "offset" < 20 THEN 0 ELSE (("offset" - 20) // 50 * 50 + 20) * 7 END AS position FROM log""")
def sparse_index_floor(spark, d):
    log = event_log(spark, d).select(*PLACE, "offset")
    anchors = log.where("offset % 50 = 20").select(*PLACE, F.col("offset").alias("anchor"), (F.col("offset") * 7).alias("position"))
    return R.index_floor(log, anchors, "offset").select(*PLACE, "offset", "anchor", "position")


@query(f"""{WITH}, n AS (SELECT *, coalesce(sum(CAST(is_control AS INTEGER)) OVER (PARTITION BY "partition", producer_id ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS txn_no FROM log),
    t AS (SELECT "partition", producer_id, txn_no, min("offset") FILTER (NOT is_control) AS first_offset, max("offset") FILTER (is_control) AS marker, max(decision) AS decision FROM n GROUP BY ALL HAVING first_offset IS NOT NULL),
    l AS (SELECT m."partition", least(hwm, (SELECT min(first_offset) FROM t WHERE t."partition" = m."partition" AND marker IS NULL)) AS lso FROM (SELECT "partition", max("offset") + 1 AS hwm FROM log GROUP BY ALL) m)
    SELECT 'read_uncommitted' AS isolation, "partition", count(*) AS n FROM log WHERE NOT is_control GROUP BY ALL UNION ALL
    SELECT 'read_committed', n."partition", count(*) FROM n JOIN t ON t."partition" = n."partition" AND t.producer_id = n.producer_id AND t.txn_no = n.txn_no JOIN l ON l."partition" = n."partition" WHERE NOT is_control AND t.decision = 'COMMIT' AND n."offset" < lso GROUP BY ALL""")
def isolation_levels(spark, d):
    log = event_log(spark, d)
    count = lambda level: X.visible(log, R.watermarks(log), level).groupBy("partition").agg(F.count("*").alias("n")).select(F.lit(level).alias("isolation"), "partition", "n")
    return count("read_uncommitted").unionByName(count("read_committed"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS key, CASE WHEN event_id % 3 <> 1 THEN props END AS value, CAST(event_id % 10 AS BIGINT) AS delta FROM events""")
def producer_records(spark, d):
    e = table(spark, d, "events")
    plain = W.records(e.where("event_id % 3 = 0"), value="props")
    tombstones = W.records(e.where("event_id % 3 = 1"), key="user_id")
    keyed = W.records(e.where("event_id % 3 = 2"), key="user_id", value="props")
    out = plain.unionByName(tombstones).unionByName(keyed)
    return W.batch_deltas(out.withColumn("batch", F.expr("event_id div 10")), ["batch"], "event_id").select("event_id", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "delta")


@query(f"""{WITH}, m AS (SELECT "partition", min("offset") AS lo, max("offset") + 1 AS hi FROM log GROUP BY ALL), q AS (SELECT CAST(p AS INTEGER) AS p, o FROM range(5) a(p), (VALUES (-5), (0)) b(o)),
    e AS (SELECT q.*, lo, hi, CASE WHEN hi IS NULL THEN 'UnknownTopicOrPartition' WHEN p = 3 THEN 'InvalidRequest' WHEN o < lo THEN 'OffsetOutOfRange' ELSE 'None' END AS error_code FROM q LEFT JOIN m ON m."partition" = p)
    SELECT 'events' AS topic, p AS "partition", CAST(o AS BIGINT) AS fetch_offset, error_code, CASE WHEN error_code = 'None' THEN hi END AS high_watermark, CASE WHEN error_code = 'None' THEN lo END AS log_start, CASE WHEN error_code = 'None' THEN hi END AS last_stable_offset, CAST(0 AS INTEGER) AS aborted FROM e""")
def compatible_fetch(spark, d):
    asked = spark.createDataFrame([("events", p, o) for p in range(5) for o in (-5, 0)], "topic string, partition int, fetch_offset long")
    marks = R.watermarks(event_log(spark, d)).withColumn("protocol", F.expr("CASE partition WHEN 3 THEN 'native' ELSE 'compatible' END"))
    out = R.fetch_outcomes(asked, marks, "compatible")
    # this protocol knows no transactions: the last stable offset is the high-watermark, and nothing is listed as aborted
    return out.withColumn("last_stable_offset", F.col("high_watermark")).withColumn("aborted", F.lit(0))


@query("SELECT event_id, CAST(a | 16 AS INTEGER) AS transactional, CAST(a & 47 AS INTEGER) AS plain, CAST(a | 32 AS INTEGER) AS control, CAST((a & 60) | 2 AS INTEGER) AS zstd FROM (SELECT event_id, event_id % 64 AS a FROM events)")
def batch_attribute_setters(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 64).cast("int").alias("attrs"))
    return e.select("event_id", X.with_bit("attrs", X.TRANSACTIONAL, True).alias("transactional"), X.with_bit("attrs", X.TRANSACTIONAL, False).alias("plain"), X.with_bit("attrs", X.CONTROL, True).alias("control"), X.with_codec("attrs", 2).alias("zstd"))


@query("SELECT user_id, CAST(sum(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END) AS BIGINT) AS value FROM events GROUP BY ALL")
def gauge_changes(spark, d):
    e = table(spark, d, "events").select("user_id", F.expr("CASE event_type WHEN 'view' THEN 'inc' WHEN 'click' THEN 'dec' END").alias("op"), F.lit(1).cast("long").alias("n"))
    return M.gauge_changes(e, ["user_id"], "op", "n")


_TEXT = """WITH h AS (SELECT event_type, count(*) FILTER (value <= 10) AS a, count(*) FILTER (value <= 100) AS b, count(*) AS n FROM events GROUP BY ALL)
    SELECT '# HELP value_units Values.' AS line UNION ALL SELECT '# TYPE value_units histogram' UNION ALL SELECT 'value_units_bucket{event="' || event_type || '",le="10"} ' || a FROM h UNION ALL SELECT 'value_units_bucket{event="' || event_type || '",le="100"} ' || b FROM h
    UNION ALL SELECT 'value_units_bucket{event="' || event_type || '",le="+Inf"} ' || n FROM h UNION ALL SELECT 'value_units_count{event="' || event_type || '"} ' || n FROM h"""


@query(_TEXT)
def exposition_text(spark, d):
    h = M.histogram(table(spark, d, "events"), ["event_type"], "value", [10.0, 100.0])
    series = h.select(F.lit("value_units").alias("name"), F.create_map(F.lit("event"), F.col("event_type")).alias("labels"), "le", "bucket", "count", "sum")
    # sums of floating point numbers depend on their order: their lines are left to the operator's test
    return M.render_histograms(series, {"value_units": "Values."}).where("line NOT LIKE '%\\_sum%'").select("line")


@query("SELECT n_regionkey, length(n_name) AS w, count(*) AS n FROM nation GROUP BY GROUPING SETS ((n_regionkey), (length(n_name)), ())")
def grouping_sets(spark, d):
    n = table(spark, d, "nation").select("n_regionkey", F.length("n_name").cast("long").alias("w"))
    return n.groupingSets([["n_regionkey"], ["w"], []], "n_regionkey", "w").agg(F.count("*").alias("n"))


@query("SELECT event_type, CAST(max(value) - min(value) AS DOUBLE) AS span FROM events GROUP BY ALL")
def user_defined_aggregate(spark, d):
    from pyspark.sql.functions import pandas_udf

    e = table(spark, d, "events")
    # partial results first, so that the function never sees a whole group's rows
    parts = e.groupBy("event_type", F.pmod(F.hash("event_id"), F.lit(64)).alias("part")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    span = pandas_udf(_span, "double")
    return parts.groupBy("event_type").agg(span("lo", "hi").alias("span"))


def _span(lo: pd.Series, hi: pd.Series) -> float:
    return float(hi.max() - lo.min())


class Words:
    """A table function: a text's words with their numbers."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        yield from enumerate((text or "").split(" "))


@query("SELECT p_partkey, CAST(k - 1 AS INTEGER) AS place, string_split(p_name, ' ')[k] AS word FROM part, LATERAL (SELECT unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS k)")
def user_defined_table_function(spark, d):
    from pyspark.sql.functions import udtf

    p = table(spark, d, "part").select("p_partkey", "p_name")
    return p.lateralJoin(udtf(Words, returnType="place int, word string")(F.col("p_name").outer())).select("p_partkey", "place", "word")
