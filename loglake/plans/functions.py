"""Queries that show the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loglake.functions import hashes as H
from loglake.functions import text as T
from loglake.model import LOG_SQL, event_log, table
from loglake.operators.catalog import CORE_ERRORS, WIRE_ERRORS, core_errors, valid_name, wire_errors
from loglake.operators.compact import compact
from loglake.plans.book import Book
from loglake.plans.logs import COMPACT
from loglake.sources.logfile import SCHEMA, decode_files, encode_segments

query = Book()
QUERIES, ORACLES = query.queries, query.oracles


@query("SELECT event_id, replace(replace(rtrim(to_base64(encode(props)), '='), '+', '-'), '/', '_') AS encoded, props AS decoded FROM events")
def base64url(spark, d):
    e = table(spark, d, "events").select("event_id", T.base64url_encode(F.encode("props", "utf-8")).alias("encoded"))
    return e.withColumn("decoded", F.decode(T.base64url_decode(F.col("encoded")), "utf-8"))


@query("SELECT event_id, sha256(props) AS digest FROM events")
def sha256_hex(spark, d):
    return table(spark, d, "events").select("event_id", H.sha256_hex(F.col("props")).alias("digest"))


@query()
def crc32c_check(spark, d):
    return table(spark, d, "events").select("event_id", H.crc32c(F.col("props")).alias("crc"))


@query()
def hmac_check(spark, d):
    return table(spark, d, "events").select("event_id", F.lower(F.hex(H.hmac_sha256(b"key", F.col("props")))).alias("mac"))


@query("SELECT event_id, CASE WHEN d >= 0 THEN d * 2 ELSE -d * 2 - 1 END AS encoded, d AS decoded FROM (SELECT event_id, event_id * 37 - 5000 AS d FROM events)")
def zigzag(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_id") * 37 - 5000).alias("v"))
    e = e.withColumn("encoded", T.zigzag_encode("v"))
    return e.select("event_id", "encoded", T.zigzag_decode("encoded").alias("decoded"))


@query("""SELECT event_id, lpad(to_hex(event_id + 1), 32, '0') AS trace_id, lpad(to_hex(user_id + 1), 16, '0') AS span_id, event_id % 2 = 0 AS sampled FROM events WHERE event_id % 5 <> 0""")
def traceparent_parse(spark, d):
    low = lambda c, n: F.lower(F.lpad(F.hex(c), n, "0"))
    e = table(spark, d, "events").select("event_id", T.format_traceparent(low(F.col("event_id") + 1, 32), low(F.col("user_id") + 1, 16), F.col("event_id") % 2 == 0).alias("h"))
    e = e.withColumn("h", F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("x"), "h")).otherwise(F.col("h"))).withColumn("t", T.parse_traceparent("h"))
    return e.where("t is not null").select("event_id", F.upper("t.trace_id").alias("trace_id"), F.upper("t.span_id").alias("span_id"), "t.sampled")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')").alias("k"))


@query("SELECT page_id, CAST(regexp_extract(url, '[?&]page=([0-9]+)', 1) AS VARCHAR) AS page FROM pages WHERE url LIKE '%?page=%'")
def pagination_parse(spark, d):
    return table(spark, d, "pages").select("page_id", T.query_param("url", "page").alias("page")).where("page is not null")


@query("SELECT DISTINCT user_id, lpad(CAST(user_id * 1000 AS VARCHAR), 20, '0') || '.log' AS name, 'events/' || (user_id % 4) || '/' || lpad(CAST(user_id AS VARCHAR), 20, '0') || '.log' AS key, user_id AS base_offset FROM events")
def segment_names(spark, d):
    u = table(spark, d, "events").select("user_id").distinct()
    u = u.select("user_id", T.segment_name(F.col("user_id") * 1000).alias("name"), T.tier_key(F.lit("events"), F.pmod("user_id", F.lit(4)).cast("int"), F.col("user_id")).alias("key"))
    return u.withColumn("base_offset", T.parse_tier_key("key")["base_offset"])


_SPECS = """SELECT DISTINCT event_type || CASE user_id % 8 WHEN 0 THEN '' WHEN 1 THEN ':' WHEN 2 THEN ':x' WHEN 3 THEN ':3x' WHEN 4 THEN ':0' WHEN 5 THEN ':-2' WHEN 6 THEN ':4:5' ELSE ':' || user_id END AS spec, event_type AS name, user_id FROM events"""


@query(f"SELECT DISTINCT spec, name, CAST(CASE WHEN user_id % 8 = 7 THEN user_id ELSE 1 END AS INTEGER) AS partitions FROM ({_SPECS})")
def topic_spec_parse(spark, d):
    tail = F.expr("CASE user_id % 8 WHEN 0 THEN '' WHEN 1 THEN ':' WHEN 2 THEN ':x' WHEN 3 THEN ':3x' WHEN 4 THEN ':0' WHEN 5 THEN ':-2' WHEN 6 THEN ':4:5' ELSE ':' || user_id END")
    e = table(spark, d, "events").select(F.concat("event_type", tail).alias("spec")).distinct()
    return e.withColumn("t", T.topic_spec("spec")).select("spec", "t.name", "t.partitions")


_PAGES = "CASE event_id % 10 WHEN 0 THEN '' WHEN 1 THEN 'page=' || user_id WHEN 2 THEN 'size=' || user_id WHEN 3 THEN 'page=2&size=100' WHEN 4 THEN 'page=0' WHEN 5 THEN 'x=1&page=7x' WHEN 6 THEN 'size=101' WHEN 7 THEN 'page=' WHEN 8 THEN 'page=3&page=4' ELSE 'mypage=9&size=5' END"


@query(f"""WITH q AS (SELECT event_id, user_id, {_PAGES} AS query FROM events), a AS (SELECT *, event_id % 10 AS k FROM q),
    b AS (SELECT *, CASE WHEN k IN (4, 5, 6, 7) OR (k = 1 AND user_id < 1) OR (k = 2 AND user_id NOT BETWEEN 1 AND 100) THEN 'InvalidArgument' END AS error FROM a)
    SELECT event_id, query, CAST(CASE WHEN error IS NULL THEN CASE k WHEN 1 THEN user_id WHEN 3 THEN 2 WHEN 8 THEN 3 ELSE 1 END END AS BIGINT) AS page, CAST(CASE WHEN error IS NULL THEN CASE k WHEN 2 THEN user_id WHEN 3 THEN 100 WHEN 9 THEN 5 ELSE 20 END END AS BIGINT) AS size, error FROM b""")
def pagination_checked(spark, d):
    e = table(spark, d, "events").select("event_id", F.expr(_PAGES).alias("query"))
    return e.withColumn("p", T.pagination("query")).select("event_id", "query", "p.page", "p.size", "p.error")


@query("SELECT p_name, regexp_full_match(p_name, '[A-Za-z0-9._-]{1,249}') AND p_name NOT IN ('.', '..') AS valid FROM part")
def topic_name_validate(spark, d):
    return table(spark, d, "part").select("p_name", valid_name("p_name").alias("valid"))


@query("SELECT event_id, 'event: ' || event_type || chr(10) || 'data: ' || props || chr(10) || chr(10) AS frame FROM events")
def sse_frames(spark, d):
    return table(spark, d, "events").select("event_id", T.sse_event(F.col("event_type"), F.col("props")).alias("frame"))


@query("""SELECT event_id, '{"level":"info","msg":"' || event_type || '","user":' || user_id || '}' AS line FROM events""")
def log_lines(spark, d):
    return table(spark, d, "events").select("event_id", T.log_line(F.lit("info"), F.col("event_type"), user=F.col("user_id")).alias("line"))


@query("""SELECT event_id, '{"type":"about:blank","title":"' || event_type || '","status":404,"detail":"' || user_id || '"}' AS body FROM events WHERE event_type = 'error'""")
def problem_bodies(spark, d):
    return table(spark, d, "events").where("event_type = 'error'").select("event_id", T.problem(F.col("event_type"), F.lit(404), F.col("user_id").cast("string")).alias("body"))


@query("SELECT event_id, 'GET' AS method, '/topics/' || event_type AS path, 'page=' || user_id AS query FROM events")
def request_line_parse(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("GET /topics/"), "event_type", F.lit("?page="), "user_id", F.lit(" HTTP/1.1")).alias("line"))
    return e.withColumn("r", T.request_line("line")).select("event_id", "r.method", "r.path", "r.query")


@query("SELECT event_id, props FROM events")
def encrypted_round_trip(spark, d):
    key, aad = F.lit(H.hkdf_sha256(b"root key", b"salt", b"segment 0")), F.lit("events/0")
    e = table(spark, d, "events").select("event_id", T.encrypt(F.encode("props", "utf-8"), key, aad).alias("sealed"))
    return e.select("event_id", F.decode(T.decrypt(F.col("sealed"), key, aad), "utf-8").alias("props"))


@query("SELECT event_id, codec, txn, control FROM (SELECT event_id, CAST(event_id % 64 & 3 AS BIGINT) AS codec, (event_id % 64 & 16) <> 0 AS txn, (event_id % 64 & 32) <> 0 AS control FROM events)")
def batch_attributes(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 64).alias("attrs"))
    return e.select("event_id", F.expr("attrs & 3").alias("codec"), F.expr("(attrs & 16) <> 0").alias("txn"), F.expr("(attrs & 32) <> 0").alias("control"))


_RETRY = "'NotLeaderForPartition', 'LeaderNotAvailable', 'RequestTimedOut', 'NotEnoughReplicas', 'Throttled', 'RebalanceInProgress'"
_WIRE = ", ".join(f"('{name}')" for name, _, _ in WIRE_ERRORS)
_CORE = ", ".join(f"('{name}')" for name, _, _ in CORE_ERRORS)


@query(f"""WITH w AS (SELECT *, row_number() OVER () - 1 AS k FROM (VALUES {_WIRE}) v(error)), e AS (SELECT event_id % 17 AS k, count(*) AS n FROM events GROUP BY ALL),
    c AS (SELECT w.error, n, CASE WHEN error = 'UnknownTopicOrPartition' THEN 'NotFound' WHEN error IN ('OffsetOutOfRange', 'OutOfOrderSequence', 'DuplicateSequence') THEN 'OutOfRange' WHEN error = 'CorruptMessage' THEN 'Corrupt'
      WHEN error = 'UnsupportedVersion' THEN 'Unsupported' WHEN error = 'InvalidProducerEpoch' THEN 'Fenced' WHEN error IN ({_RETRY}) THEN 'IoError' ELSE 'InvalidArgument' END AS core FROM e JOIN w ON w.k = e.k)
    SELECT error, error IN ({_RETRY}) AS retryable, core, CAST(CASE core WHEN 'NotFound' THEN 404 WHEN 'Unsupported' THEN 501 WHEN 'Fenced' THEN 409 WHEN 'Corrupt' THEN 500 WHEN 'IoError' THEN 500 ELSE 400 END AS INTEGER) AS http, n FROM c""")
def error_classify(spark, d):
    names = F.array(*(F.lit(name) for name, _, _ in WIRE_ERRORS))
    e = table(spark, d, "events").groupBy(F.element_at(names, (F.col("event_id") % 17).cast("int") + 1).alias("error")).agg(F.count("*").alias("n"))
    return e.join(wire_errors(spark), "error").select("error", "retryable", "core", "http", "n")


@query(f"""WITH c AS (SELECT *, row_number() OVER () - 1 AS k FROM (VALUES {_CORE}) v(core))
    SELECT event_id, core, CASE core WHEN 'Corrupt' THEN 'CorruptMessage' WHEN 'OutOfRange' THEN 'OffsetOutOfRange' WHEN 'NotFound' THEN 'UnknownTopicOrPartition' WHEN 'Unsupported' THEN 'UnsupportedVersion' WHEN 'InvalidArgument' THEN 'InvalidRequest'
      WHEN 'Fenced' THEN 'InvalidProducerEpoch' ELSE 'LeaderNotAvailable' END AS wire, CAST(CASE core WHEN 'InvalidArgument' THEN 400 WHEN 'OutOfRange' THEN 400 WHEN 'NotFound' THEN 404 WHEN 'Unsupported' THEN 501 WHEN 'OutOfSpace' THEN 507 WHEN 'Shutdown' THEN 503 WHEN 'Fenced' THEN 409 ELSE 500 END AS INTEGER) AS http
    FROM events JOIN c ON c.k = event_id % 9""")
def error_from_core(spark, d):
    names = F.array(*(F.lit(name) for name, _, _ in CORE_ERRORS))
    e = table(spark, d, "events").select("event_id", F.element_at(names, (F.col("event_id") % 9).cast("int") + 1).alias("core"))
    return e.join(core_errors(spark), "core").select("event_id", "core", "wire", "http")


@query()
def jwt_verify(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat_ws(".", "event_type", "props", F.lit("x")).alias("token"))
    return e.select("event_id", H.jwt(F.col("token"), b"secret", 1_700_000_000)["error"].alias("error"))


@query(f"WITH {LOG_SQL} {COMPACT} AND value IS NOT NULL")
def binary_log_round_trip(spark, d):

    log = compact(event_log(spark, d)).select("topic", "partition", "offset", "base_offset", "key", "value")
    segments = encode_segments(log, segment_bytes=4096)
    files = segments.select(F.concat_ws("/", "topic", F.col("partition").cast("string"), F.concat(F.col("base_offset").cast("string"), F.lit(".log"))).alias("path"), "content")
    return files.mapInArrow(decode_files, SCHEMA).select("topic", "partition", "offset", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
