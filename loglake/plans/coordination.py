"""Queries about groups, replicas, placement and the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglake.model import LOG_SQL, PLACE, event_log, micros, table
from loglake.operators import catalog as K
from loglake.operators import groups as G
from loglake.operators import placement as P
from loglake.operators import quorum as Q
from loglake.operators import resilience
from loglake.operators.read import watermarks
from loglake.plans.book import Book

query = Book()
QUERIES, ORACLES = query.queries, query.oracles
WITH = f"WITH {LOG_SQL}"
COMMITTED = f"""{WITH}, c AS (SELECT event_type AS "group", topic, "partition", arg_max("offset", arrival) AS "offset" FROM log GROUP BY ALL), m AS (SELECT "partition", max("offset") + 1 AS hwm FROM log GROUP BY ALL)"""


def _commits(spark, d):
    return event_log(spark, d).select(F.col("event_type").alias("group"), *PLACE, "offset", F.col("arrival").alias("commit_seq"))


@query(f"{COMMITTED} SELECT * FROM c")
def committed_offsets_latest(spark, d):
    return G.committed(_commits(spark, d))


@query(f"""{COMMITTED} SELECT c."group", c.topic, c."partition", c."offset", hwm AS high_watermark, greatest(hwm - c."offset", 0) AS lag FROM c JOIN m ON m."partition" = c."partition" """)
def consumer_lag(spark, d):
    return G.lag(G.committed(_commits(spark, d)), watermarks(event_log(spark, d))).select("group", *PLACE, "offset", "high_watermark", "lag")


@query(f"""{COMMITTED} SELECT r."group", 'events' AS topic, CAST(r.p AS INTEGER) AS "partition", CAST(coalesce(c."offset", -1) AS BIGINT) AS "offset" FROM (SELECT g AS "group", p FROM (VALUES ('click'), ('nobody')) a(g), range(5) b(p)) r LEFT JOIN c ON c."group" = r."group" AND c."partition" = r.p""")
def fetch_committed(spark, d):
    asked = spark.createDataFrame([(g, "events", p) for g in ("click", "nobody") for p in range(5)], "group string, topic string, partition int")
    return G.fetch_committed(asked, G.committed(_commits(spark, d)))


@query(f"""{COMMITTED} SELECT * FROM c WHERE "group" = 'purchase' ORDER BY topic, "partition" """)
def group_offsets_list(spark, d):
    return G.committed(_commits(spark, d)).where("group = 'purchase'").orderBy(*PLACE)


@query(f"""{COMMITTED} SELECT * FROM c ORDER BY "group", topic, "partition" LIMIT 5 OFFSET 5""")
def group_paging(spark, d):
    return G.page(G.committed(_commits(spark, d)), ["group", *PLACE], 2, 5)


@query("""WITH b AS (SELECT user_id, epoch_us(ts) AS us FROM events), n AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) <= 21600000000 THEN 0 ELSE 1 END AS fresh FROM b),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS session FROM n)
    SELECT user_id, CAST(session AS BIGINT) AS session, min(us) AS started, max(us) AS last_seen, count(*) AS heartbeats FROM s GROUP BY user_id, session""")
def group_session_expiry(spark, d):
    beats = table(spark, d, "events").select("user_id", micros("ts").alias("us"))
    return G.sessions(beats, ["user_id"], "us", 21_600_000_000)


REPLICAS = f"""{WITH}, r AS (SELECT topic, "partition", CAST(n AS INTEGER) AS node, n < 5 AS is_voter, CAST(max("offset") - n * 3 AS BIGINT) AS match_index FROM log, range(1, 6) a(n) GROUP BY topic, "partition", n)"""


def _replicas(spark, d):
    last = event_log(spark, d).groupBy(*PLACE).agg(F.max("offset").alias("_m"))
    return last.withColumn("node", F.explode(F.sequence(F.lit(1), F.lit(5)))).select(*PLACE, "node", (F.col("node") < 5).alias("is_voter"), (F.col("_m") - F.col("node") * 3).cast("long").alias("match_index"))


@query(f"""{REPLICAS} SELECT topic, "partition", list_reverse_sort(list(match_index))[CAST(count(*) // 2 + 1 AS INTEGER)] AS commit_index FROM r WHERE is_voter GROUP BY "partition", topic""")
def quorum_commit_index(spark, d):
    return Q.commit_index(_replicas(spark, d))


@query(f"""{REPLICAS}, q AS (SELECT topic, "partition", list_reverse_sort(list(match_index))[CAST(count(*) // 2 + 1 AS INTEGER)] AS m FROM r WHERE is_voter GROUP BY "partition", topic) SELECT topic, "partition", CASE WHEN m // 1000 = 2 THEN m END AS commit_index FROM q""")
def quorum_commit_term(spark, d):
    r = _replicas(spark, d).withColumn("entry_term", F.expr("match_index div 1000")).withColumn("current_term", F.lit(2).cast("long"))
    return Q.commit_index(r)


@query(f"""{REPLICAS}, q AS (SELECT topic, "partition", list_reverse_sort(list(match_index))[CAST(count(*) // 2 + 1 AS INTEGER)] AS m FROM r WHERE is_voter GROUP BY "partition", topic) SELECT topic, "partition", CAST(greatest(m, CASE WHEN "partition" % 2 = 0 THEN m + 40 ELSE m - 40 END) AS BIGINT) AS commit_index FROM q""")
def quorum_commit_advance(spark, d):
    r = _replicas(spark, d)
    now = Q.commit_index(r).select(*PLACE, F.expr("CASE WHEN partition % 2 = 0 THEN commit_index + 40 ELSE commit_index - 40 END").alias("known_commit"))
    return Q.commit_index(r.join(now, PLACE))


@query(f"""{REPLICAS} SELECT topic, "partition", node, match_index, max(match_index) OVER (PARTITION BY "partition") AS last_index, max(match_index) OVER (PARTITION BY "partition") - match_index AS lag FROM r""")
def follower_lag(spark, d):
    return Q.follower_lag(_replicas(spark, d)).select(*PLACE, "node", "match_index", "last_index", "lag")


@query(f"""{WITH}, c AS (SELECT "partition", max("offset") - 25 AS ci FROM log GROUP BY ALL) SELECT 'events' AS topic, "partition", ci AS commit_index, CAST(ci + 1 AS BIGINT) AS high_watermark FROM c""")
def quorum_high_watermark(spark, d):
    log = event_log(spark, d)
    commits = log.groupBy(*PLACE).agg((F.max("offset") - 25).alias("commit_index"))
    entries = log.select(*PLACE, F.col("offset").alias("index"), F.col("offset").alias("last_offset"))
    return Q.high_watermark(commits, entries, watermarks(log).select(*PLACE, "log_start"))


@query(f"""{WITH}, c AS (SELECT "partition", "offset" AS ci, arrival + 40 AS at FROM log WHERE "offset" % 8 = 7)
    SELECT l.topic, l."partition", l."offset" AS index, l.arrival AS proposed_at, c.at AS committed_at, c.at - l.arrival AS latency FROM log l JOIN c ON c."partition" = l."partition" AND c.ci = l."offset" // 8 * 8 + 7""")
def commit_latency_asof(spark, d):
    log = event_log(spark, d)
    proposed = log.select(*PLACE, F.col("offset").alias("index"), F.col("arrival").alias("at"))
    commits = log.where("offset % 8 = 7").select(*PLACE, F.col("offset").alias("commit_index"), (F.col("arrival") + 40).alias("at"))
    return Q.commit_latency(proposed, commits)


@query(f"""{WITH} SELECT topic, "partition", min("offset") FILTER ("offset" // 100 <> ("offset" + 7) // 100 AND "offset" > 150) AS conflict_index FROM log GROUP BY ALL""")
def raft_conflict(spark, d):
    log = event_log(spark, d)
    local = log.select(*PLACE, F.col("offset").alias("index"), F.expr("offset div 100").alias("term"))
    incoming = log.select(*PLACE, F.col("offset").alias("index"), F.expr("CASE WHEN offset > 150 THEN (offset + 7) div 100 ELSE offset div 100 END").alias("term"))
    return Q.conflict(local, incoming)


@query("""SELECT event_id, CAST(event_id % 5 > user_id % 5 OR (event_id % 5 = user_id % 5 AND event_id >= user_id) AS BOOLEAN) AS granted FROM events""")
def vote_check(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", "event_id % 5 AS last_term", "event_id AS last_index", "user_id % 5 AS own_term", "user_id AS own_index")
    return Q.may_vote(e).select("event_id", "granted")


@query("""WITH u AS (SELECT DISTINCT user_id FROM events) SELECT user_id, ['n1', 'n2', 'n3'][CAST((row_number() OVER (ORDER BY user_id) - 1) % 3 + 1 AS INTEGER)] AS node FROM u""")
def round_robin_assign(spark, d):
    return P.round_robin(table(spark, d, "events").select("user_id").distinct(), ["n3", "n1", "n2"], "user_id")


@query("""WITH RECURSIVE k AS (SELECT DISTINCT event_type AS name FROM events), h AS (SELECT name, 1 AS n, CAST(14695981039346656037 AS HUGEINT) AS h FROM k UNION ALL
    SELECT name, n + 1, (xor(h, CAST(ascii(substr(name, n, 1)) AS HUGEINT)) * 1099511628211) % CAST(18446744073709551616 AS HUGEINT) FROM h WHERE n <= length(name))
    SELECT name, CAST(h % 8 AS INTEGER) AS shard FROM h WHERE n = length(name) + 1""")
def fnv1a_shard(spark, d):
    return P.shard(table(spark, d, "events").select(F.col("event_type").alias("name")).distinct(), "name", 8)


@query()
def consistent_hash_assign(spark, d):
    return P.consistent_hash(table(spark, d, "events").select("user_id").distinct(), "user_id", ["n1", "n2", "n3"])


@query(f'{WITH} SELECT "partition", CAST("partition" % 3 AS INTEGER) AS core, count(*) AS n FROM log GROUP BY ALL')
def partition_owner_core(spark, d):
    return P.owner_core(event_log(spark, d), 3).groupBy("partition", "core").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT event_type AS service, 'n' || (user_id % 7) AS node, count(*) AS connections FROM events GROUP BY ALL)
    SELECT service, node, connections FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY connections, node) AS k FROM a) WHERE k = 1""")
def least_connections(spark, d):
    a = table(spark, d, "events").groupBy(F.col("event_type").alias("service"), F.concat(F.lit("n"), F.pmod("user_id", F.lit(7))).alias("node")).agg(F.count("*").alias("connections"))
    return P.least_connections(a)


@query("""SELECT p_name AS topic, CAST(p_size AS INTEGER) AS partitions, CASE WHEN NOT regexp_full_match(p_name, '[A-Za-z0-9._-]{1,249}') OR p_name IN ('.', '..') THEN 'INVALID_NAME' WHEN p_size < 1 THEN 'INVALID_PARTITIONS' WHEN p_partkey % 10 = 0 THEN 'ALREADY_EXISTS' ELSE 'OK' END AS outcome FROM part""")
def topic_create(spark, d):
    p = table(spark, d, "part")
    known = p.where("p_partkey % 10 = 0").select(F.col("p_name").alias("topic")).distinct()
    wanted = p.select(F.col("p_name").alias("topic"), F.col("p_size").cast("int").alias("partitions"))
    return K.create_topics(known, wanted)


@query("""SELECT n_name AS topic, CAST(CASE WHEN n_nationkey % 3 = 0 THEN 5000 ELSE n_nationkey * 1000 END AS BIGINT) AS retention_ms, CAST(n_regionkey * 100 AS BIGINT) AS retention_bytes FROM nation""")
def topic_alter_retention(spark, d):
    n = table(spark, d, "nation")
    catalog = n.select(F.col("n_name").alias("topic"), (F.col("n_nationkey") * 1000).cast("long").alias("retention_ms"), (F.col("n_regionkey") * 100).cast("long").alias("retention_bytes"))
    changes = n.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("topic"), F.lit(5000).cast("long").alias("retention_ms"), F.lit(None).cast("long").alias("retention_bytes"))
    return K.alter_retention(catalog, changes)


@query(f"""{WITH}, m AS (SELECT topic, "partition", max("offset") + 1 AS hwm FROM log GROUP BY ALL) SELECT t.topic, "partition", hwm AS high_watermark FROM (VALUES ('events'), ('idle')) t(topic) LEFT JOIN m ON m.topic = t.topic ORDER BY 1, 2""")
def topic_describe(spark, d):
    catalog = spark.createDataFrame([("events",), ("idle",)], "topic string")
    return K.describe(catalog, watermarks(event_log(spark, d)).select(*PLACE, "high_watermark"))


@query(f"""{WITH}, m AS (SELECT topic, "partition", max("offset") + 1 AS hwm FROM log GROUP BY ALL) SELECT topic, "partition", CASE WHEN "partition" = 1 THEN 'follower' ELSE 'leader' END AS role, CAST(CASE WHEN "partition" = 1 THEN 7 ELSE 0 END AS BIGINT) AS term,
    CAST(CASE WHEN "partition" = 1 THEN 10 ELSE hwm END AS BIGINT) AS commit_index, CAST(CASE WHEN "partition" = 1 THEN 12 ELSE hwm END AS BIGINT) AS last_index FROM m""")
def cluster_describe(spark, d):
    replicated = spark.createDataFrame([("events", 1, "follower", 7, 10, 12)], "topic string, partition int, role string, term long, commit_index long, last_index long")
    return K.describe_cluster(replicated, watermarks(event_log(spark, d)))


@query("SELECT 'n' || (user_id % 9) AS node, bool_and(value < 489) AS ready FROM events GROUP BY ALL")
def readiness(spark, d):
    return K.ready(table(spark, d, "events").select(F.concat(F.lit("n"), F.pmod("user_id", F.lit(9))).alias("node"), (F.col("value") < 489).alias("healthy")))


@query("SELECT user_id, CAST(CASE WHEN least(user_id % 6, 4) >= 2 THEN least(user_id % 6, 4) ELSE 0 END AS INTEGER) AS version FROM (SELECT DISTINCT user_id FROM events)")
def version_negotiate(spark, d):
    u = table(spark, d, "events").select("user_id").distinct().withColumn("max_version", F.pmod("user_id", F.lit(6)))
    return K.negotiate(u, 2, 4).select("user_id", "version")


@query("SELECT DISTINCT n_name AS node FROM nation UNION SELECT r_name FROM region ORDER BY 1")
def cluster_nodes_union(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("node")).union(table(spark, d, "region").select("r_name")).distinct().orderBy("node")


@query()
def token_bucket_fold(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", micros("ts").alias("now"))
    return resilience.fold(e, ["user_id"], "event_id", lambda s, r: resilience.token_bucket(s, r, 0.00005, 2), "boolean")


@query()
def circuit_breaker_fold(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", micros("ts").alias("now"), (F.col("event_type") == "error").alias("failed"))
    return resilience.fold(e, ["user_id"], "event_id", lambda s, r: resilience.circuit_breaker(s, r, 20, 5, 0.4, 86_400_000_000), "string")


@query()
def health_fold(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("failed"))
    return resilience.fold(e, ["user_id"], "event_id", resilience.health, "boolean")


@query()
def group_membership_fold(spark, d):
    e = table(spark, d, "events").select("event_type", "event_id", F.col("event_type").alias("group"), micros("ts").alias("now"), F.concat(F.lit("m"), F.pmod("user_id", F.lit(3))).alias("member"), F.lit(7_200_000_000).alias("timeout"), F.when(F.col("event_id") % 11 == 0, "leave").when(F.col("event_id") % 5 == 0, "tick").otherwise("join").alias("op"))
    return resilience.fold(e, ["event_type"], "event_id", G.join_group, "string")


@query(f"""{COMMITTED}, g AS (SELECT event_type AS "group", count(DISTINCT user_id % 3) AS members FROM log GROUP BY ALL)
    SELECT g."group", g.members, count(*) AS partitions, CAST(sum(greatest(hwm - c."offset", 0)) AS BIGINT) AS total_lag FROM g JOIN c ON c."group" = g."group" JOIN m ON m."partition" = c."partition" GROUP BY ALL""")
def group_describe(spark, d):
    log = event_log(spark, d)
    members = log.select(F.col("event_type").alias("group"), F.pmod("user_id", F.lit(3)).alias("member"))
    return G.describe(G.lag(G.committed(_commits(spark, d)), watermarks(log)), members)


@query("""SELECT DISTINCT event_type AS "group", 'm' || (user_id % 3) AS member, 'p' || (user_id % 3) AS assignment FROM events""")
def group_sync_assign(spark, d):
    member = F.concat(F.lit("m"), F.pmod("user_id", F.lit(3)))
    members = table(spark, d, "events").select(F.col("event_type").alias("group"), member.alias("member"))
    given = table(spark, d, "events").select(F.col("event_type").alias("group")).distinct().withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    given = given.select("group", F.concat(F.lit("m"), "_k").alias("member"), F.concat(F.lit("p"), "_k").alias("assignment"))
    return G.distribute(given, members)


@query("""WITH q AS (SELECT user_id % 4 AS conn, event_id // 2 AS correlation_id, min(event_id) AS sent FROM events GROUP BY ALL), r AS (SELECT user_id % 4 AS conn, event_id // 2 AS correlation_id, event_type AS reply FROM events WHERE event_id % 6 = 0)
    SELECT q.conn, q.correlation_id, sent, reply FROM q LEFT JOIN r ON r.conn = q.conn AND r.correlation_id = q.correlation_id""")
def request_correlation(spark, d):
    from loglake.operators.read import correlate

    e = table(spark, d, "events").select(F.pmod("user_id", F.lit(4)).alias("conn"), F.expr("event_id div 2").alias("correlation_id"), "event_id", "event_type")
    return correlate(e.withColumnRenamed("event_id", "sent"), e.where("event_id % 6 = 0").select("conn", "correlation_id", F.col("event_type").alias("reply")))


@query(f"""{WITH} SELECT topic, "partition", "offset" AS index, arrival FROM log WHERE "offset" BETWEEN 100 AND 163""")
def raft_append_entries(spark, d):
    from loglake.operators.read import entries_from

    return entries_from(event_log(spark, d).select(*PLACE, F.col("offset").alias("index"), "arrival"), 100)
