"""URL filters: block and allow rules looked up by hashed host-suffix and path-prefix expressions.

A URL is expanded into every host suffix (at dots) joined with every path prefix (at slashes) that a rule could
have: not more labels or slashes than the deepest rule. Expressions meet rules in an equi-join on the first
``PREFIX_BYTES`` bytes of their SHA-256, the full digests confirm, and the longest rule wins. Rule paths that
don't end in a slash are looked up by prefixes of their own lengths.

Results for odd input: a null URL or one without ``://`` has empty host and path and gets the default verdict; rows
that repeat are judged once each; of rules with equal host and path, block wins; of matching rules with equal
length, the one with the longer host; an empty table or no rules: no match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.llm.common import load

PREFIX_BYTES = 4
#: Rules of up to this many characters in all are broadcast; above, the join shuffles and adaptive execution splits hot prefixes.
BROADCAST_CHARS = 8_000_000
#: Fixed values of the production query: (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
DEFAULT_VERDICT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: str = "url") -> tuple:
    """Columns host and path of a url column."""
    rest = F.when(F.locate("://", url) > 0, F.expr(f"substring({url}, locate('://', {url}) + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules (verdict, host, path) with their digests; one per host and path, block before allow."""
    r = rules.groupBy("host", "path").agg(F.max(F.expr("int(verdict = 'block')")).alias("blocks"))
    r = r.select(F.concat("host", "path").alias("rule"), F.when(F.col("blocks") == 1, "block").otherwise("allow").alias("verdict"), F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"), F.sha2(F.concat("host", "path"), 256).alias("digest"))
    return r.withColumn("key", F.substring("digest", 1, 2 * PREFIX_BYTES))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judges each row: id, host, path, rule (null if none fits), verdict."""
    depth = rules.agg(
        F.count("*").alias("n"), F.sum(F.length("host") + F.length("path") + 100).alias("chars"), F.max(F.size(F.split("host", "\\."))).alias("labels"), F.max(F.expr("length(path) - length(replace(path, '/', ''))")).alias("slashes"),
        F.collect_set(F.expr("CASE WHEN path NOT LIKE '%/' THEN length(path) END")).alias("lengths"),
    ).first()
    host, path = split_url("`_url`")
    base = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"))
    base = base.select("_id", host.alias("_host"), path.alias("_path"))
    if not depth["n"]:
        return base.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels, slashes, lengths = depth["labels"], depth["slashes"], sorted(depth["lengths"])
    # a URL's verdict hangs on host and path alone: each distinct pair is judged once, which also defuses hot URLs
    cut = f"array_join(slice(split(_path, '/', {slashes + 1}), 1, i), '/') || '/'"
    suffixes = f"transform(sequence(1, least({labels}, size(split(_host, '[.]')))), i -> substring_index(_host, '.', -i))"
    prefixes = f"transform(sequence(1, least({slashes}, size(split(_path, '/', {slashes + 1})) - 1)), i -> {cut})" if slashes else "array()"
    prefixes = f"CASE WHEN instr(_path, '/') > 0 THEN {prefixes} ELSE cast(array() AS array<string>) END"
    own = ", ".join(f"left(_path, {n})" for n in lengths)
    prefixes = f"array_distinct(concat({prefixes}, array({own})))" if lengths else prefixes
    keyed = base.withColumn("_pair", F.sha2(F.concat(F.col("_host"), F.lit("\0"), F.col("_path")), 256))
    pairs = keyed.groupBy("_pair").agg(F.first("_host").alias("_host"), F.first("_path").alias("_path"))
    expr = pairs.select("_pair", F.explode(F.expr(f"flatten(transform({suffixes}, h -> transform({prefixes}, p -> sha2(h || p, 256))))")).alias("_digest"))
    expr = expr.withColumn("key", F.substring("_digest", 1, 2 * PREFIX_BYTES))
    table = rule_table(rules)
    table = F.broadcast(table) if depth["chars"] <= BROADCAST_CHARS else table
    hits = expr.join(table, "key").where("_digest = digest")
    best = hits.groupBy("_pair").agg(F.max(F.struct("size", "host_size", "rule", "verdict")).alias("best"))
    out = keyed.join(best, "_pair", "left")
    return out.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return filter_urls(load(spark, sf_dir, "pages"), rules)


ORACLE = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), m AS (
  SELECT page_id, host, path, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.k = 1
"""
