"""Encodings and small text formats, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base64url_encode(data: Column) -> Column:
    """Unpadded."""
    return F.translate(F.rtrim(F.base64(data), F.lit("=")), "+/", "-_")


def base64url_decode(text: Column) -> Column:
    plain = F.translate(text, "-_", "+/")
    return F.unbase64(F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(text), F.lit(4)))))


def zigzag_encode(v: str) -> Column:
    return F.expr(f"shiftleft(cast({v} AS bigint), 1) ^ shiftright(cast({v} AS bigint), 63)")


def zigzag_decode(v: str) -> Column:
    return F.expr(f"shiftrightunsigned(cast({v} AS bigint), 1) ^ -(cast({v} AS bigint) & 1)")


def parse_traceparent(text: str) -> Column:
    """Struct of trace_id, span_id, sampled; null for anything but a well-formed, non-zero version 00 header."""
    pattern = "^00-([0-9a-f]{32})-([0-9a-f]{16})-([0-9a-f]{2})$"
    part = lambda k: F.regexp_extract(text, pattern, k)
    good = F.col(text).rlike(pattern) & (part(1) != "0" * 32) & (part(2) != "0" * 16)
    return F.when(good, F.struct(part(1).alias("trace_id"), part(2).alias("span_id"), (F.conv(part(3), 16, 10).cast("int") % 2 == 1).alias("sampled")))


def format_traceparent(trace_id: Column, span_id: Column, sampled: Column) -> Column:
    return F.concat_ws("-", F.lit("00"), trace_id, span_id, F.when(sampled, "01").otherwise("00"))


def segment_name(base: Column, suffix: str = ".log") -> Column:
    return F.concat(F.lpad(base.cast("string"), 20, "0"), F.lit(suffix))


def tier_key(topic: Column, partition: Column, base: Column, suffix: str = "log") -> Column:
    return F.format_string("%s/%d/%020d." + suffix, topic, partition, base)


def parse_tier_key(key: str) -> Column:
    pattern = r"^([A-Za-z0-9._-]+)/(\d+)/(\d{20})\.(\w+)$"
    part = lambda k: F.regexp_extract(key, pattern, k)
    return F.when(F.col(key).rlike(pattern), F.struct(part(1).alias("topic"), part(2).cast("int").alias("partition"), part(3).cast("long").alias("base_offset"), part(4).alias("suffix")))


def topic_spec(spec: str) -> Column:
    """``name:partitions``, cut at the first colon; one partition if there is no number after it, or none above 0."""
    rest = f"CASE WHEN locate(':', {spec}) > 0 THEN substring({spec}, locate(':', {spec}) + 1) END"
    n = F.expr(f"CASE WHEN ({rest}) RLIKE '^-?[0-9]+$' THEN try_cast({rest} AS int) END")
    return F.struct(F.expr(f"substring_index({spec}, ':', 1)").alias("name"), F.when(n >= 1, n).otherwise(1).alias("partitions"))


def escape_label(value: Column) -> Column:
    v = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(v, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def sse_event(event: Column, data: Column) -> Column:
    """A server-sent event: a data line per line of data."""
    lines = F.transform(F.split(data, "\n"), lambda x: F.concat(F.lit("data: "), x))
    return F.concat(F.lit("event: "), event, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n\n"))


def problem(title: Column, status: Column, detail: Column) -> Column:
    return F.to_json(F.struct(F.lit("about:blank").alias("type"), title.alias("title"), status.alias("status"), detail.alias("detail")))


def log_line(level: Column, message: Column, **fields: Column) -> Column:
    return F.to_json(F.struct(level.alias("level"), message.alias("msg"), *(v.alias(k) for k, v in fields.items())))


def query_param(url: str, name: str) -> Column:
    return F.expr(f"try_parse_url({url}, 'QUERY', '{name}')")


#: Rows of a page, unless the query says otherwise, and at most.
PAGE_SIZE, LARGEST_PAGE = 20, 100


def pagination(query: str) -> Column:
    """page and size that a query string (``k=v&k2=v2``) asks for, and an error instead if one isn't a number in its range. The first of
    repeated parameters counts."""
    first = lambda key: f"regexp_extract({query}, '(?:^|&){key}=([^&]*)', 1)"
    there = lambda key: f"{query} RLIKE '(?:^|&){key}='"
    number = lambda key: f"CASE WHEN {first(key)} RLIKE '^[0-9]+$' THEN try_cast({first(key)} AS bigint) END"
    value = lambda key, default: f"CASE WHEN {there(key)} THEN {number(key)} ELSE {default} END"
    page, size = value("page", 1), value("size", PAGE_SIZE)
    error = f"CASE WHEN coalesce({page}, 0) < 1 OR coalesce({size}, 0) NOT BETWEEN 1 AND {LARGEST_PAGE} THEN 'InvalidArgument' END"
    return F.expr(f"CASE WHEN ({error}) IS NULL THEN struct({page} AS page, {size} AS size, cast(null AS string) AS error) ELSE struct(cast(null AS bigint) AS page, cast(null AS bigint) AS size, {error} AS error) END")


def request_line(line: str) -> Column:
    """Method, path and query of an HTTP request line; null if malformed."""
    pattern = r"^([A-Z]+) ([^ ?]+)(?:\?([^ ]*))? HTTP/1\.[01]$"
    part = lambda k: F.regexp_extract(line, pattern, k)
    return F.when(F.col(line).rlike(pattern), F.struct(part(1).alias("method"), part(2).alias("path"), part(3).alias("query")))


def decrypt(data: Column, key: Column, aad: Column) -> Column:
    """A sealed block (nonce, ciphertext, tag) back to bytes; null if it was tampered with."""
    return F.try_aes_decrypt(data, key, F.lit("GCM"), F.lit("DEFAULT"), aad)


def encrypt(data: Column, key: Column, aad: Column, iv: Column | None = None) -> Column:
    return F.aes_encrypt(data, key, F.lit("GCM"), F.lit("DEFAULT"), iv if iv is not None else F.lit(b""), aad)
