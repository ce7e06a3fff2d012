"""Metrics: counters, gauges, cumulative and log-linear histograms, load reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Default histogram bounds in seconds.
BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def requests(df: DataFrame) -> DataFrame:
    """Requests, errors, records and bytes by (api, protocol)."""
    return df.groupBy("api", "protocol").agg(F.count("*").alias("requests"), F.sum(F.col("failed").cast("long")).alias("errors"), F.sum("bytes").cast("long").alias("bytes"))


def gauge(df: DataFrame, on: list[str], value: str, order: str) -> DataFrame:
    """Last value of each gauge."""
    return df.groupBy(*on).agg(F.max(F.struct(F.col(order), F.col(value))).alias("_g")).select(*on, F.col(f"_g.{value}").alias(value))


def gauge_changes(df: DataFrame, on: list[str], op: str, n: str) -> DataFrame:
    """Value of each gauge that only inc and dec change; other operations change nothing."""
    step = F.when(F.col(op) == "inc", F.col(n)).when(F.col(op) == "dec", -F.col(n)).otherwise(0)
    return df.groupBy(*on).agg(F.sum(step).cast("long").alias("value"))


def histogram(df: DataFrame, on: list[str], value: str, bounds: list[float] = BOUNDS) -> DataFrame:
    """Cumulative buckets: a row per series and bound (le; the last is Infinity) with count and sum of the series.

    One aggregation with a conditional sum per bound; rows aren't multiplied by bounds.
    """
    sums = [F.sum((F.col(value) <= b).cast("long")).alias(f"_b{k}") for k, b in enumerate(bounds)]
    agg = df.groupBy(*on).agg(*sums, F.count(value).alias("count"), F.sum(value).alias("sum"))
    rows = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{k}").alias("bucket")) for k, b in enumerate(bounds)), F.struct(F.lit(float("inf")).alias("le"), F.col("count").alias("bucket")))
    return agg.select(*on, F.explode(rows).alias("_r"), "count", "sum").select(*on, "_r.le", "_r.bucket", "count", "sum")


def series(df: DataFrame, labels: str = "labels") -> DataFrame:
    """Sum of a counter by name and labels, whatever the labels' order: entries sorted by key."""
    return df.groupBy("name", F.array_sort(F.map_entries(labels)).alias(labels)).agg(F.sum("value").alias("value"))


def representative(v: str) -> Column:
    """Lower bound of a value's log-linear bucket: values below 64 themselves, then 64 buckets for each power of two."""
    octave = f"greatest(length(bin({v})) - 7, 0)"
    return F.expr(f"shiftleft(shiftright({v}, {octave}), {octave})")


def latency_buckets(df: DataFrame, on: list[str], value: str) -> DataFrame:
    """Mergeable histogram: bucket representatives and their counts."""
    return df.groupBy(*on, representative(value).alias("bucket")).agg(F.count("*").alias("n"))


def merge_buckets(parts: DataFrame, on: list[str]) -> DataFrame:
    return parts.groupBy(*on, "bucket").agg(F.sum("n").cast("long").alias("n"))


def percentiles(buckets: DataFrame, on: list[str], shares: list[float]) -> DataFrame:
    """Value at rank floor(share / 100 * n), at least 1: lower bound of the first bucket that reaches it. Runs on bucket rows."""
    w = Window.partitionBy(*on).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*on)
    b = buckets.withColumn("_cum", F.sum("n").over(w)).withColumn("_n", F.sum("n").over(whole))
    asked = F.explode(F.array(*map(F.lit, shares))).alias("p")
    b = b.select("*", asked).withColumn("_rank", F.least(F.greatest(F.floor(F.col("p") / 100 * F.col("_n")), F.lit(1)), F.col("_n")))
    return b.where("_cum >= _rank").groupBy(*on, "p").agg(F.min("bucket").alias("value"))


def load_report(results: DataFrame, on: list[str], warmup_micros: int = 0) -> DataFrame:
    """Merged workers (started, ended, latency, failed): rate of recorded results, errors left out of latency, warm-up dropped."""
    ok = ~F.col("failed")
    kept = results.withColumn("_from", F.min("started").over(Window.partitionBy(*on)) if warmup_micros else F.lit(0)).where(F.col("started") >= F.col("_from") + warmup_micros)
    agg = kept.groupBy(*on).agg(
        F.sum(ok.cast("long")).alias("recorded"), F.sum((~ok).cast("long")).alias("errors"), F.min("started").alias("_a"), F.max("ended").alias("_b"),
        F.min(F.when(ok, F.col("latency"))).alias("min_latency"), F.max(F.when(ok, F.col("latency"))).alias("max_latency"), F.sum(F.when(ok, F.col("latency"))).cast("long").alias("sum_latency"),
    )
    rate = F.when(F.col("_b") > F.col("_a"), F.col("recorded") * F.lit(1e6) / (F.col("_b") - F.col("_a"))).otherwise(F.lit(0.0))
    return agg.withColumn("rate", rate).drop("_a", "_b")


def intended(df: DataFrame, number: str, epoch_micros: int, rate: float) -> DataFrame:
    """Open-loop schedule: when each request should have been sent, and its latency from then."""
    out = df.withColumn("intended", (F.lit(epoch_micros) + F.floor(F.col(number) * F.lit(1e6 / rate))).cast("long"))
    return out.withColumn("corrected_latency", F.col("ended") - F.col("intended")) if "ended" in df.columns else out


def failure_ratio(df: DataFrame, on: list[str], order: str, failed: str, last: int = 20, least: int = 10) -> DataFrame:
    """Share of failures among each result and those before it, ``last`` in all; 0 below ``least`` samples."""
    w = Window.partitionBy(*on).orderBy(order).rowsBetween(-(last - 1), 0)
    n, bad = F.count("*").over(w), F.sum(F.col(failed).cast("long")).over(w)
    return df.withColumn("ratio", F.when(n >= least, bad / n).otherwise(F.lit(0.0)))


def render_prometheus(df: DataFrame) -> DataFrame:
    """Text lines of counters and gauges (name, type, labels map, value)."""
    from loglake.functions.text import escape_label

    pair = lambda e: F.concat(e["key"], F.lit('="'), escape_label(e["value"]), F.lit('"'))
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), pair), ",")
    return df.select("name", F.concat("name", F.when(F.size("labels") > 0, F.concat(F.lit("{"), labels, F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string")).alias("line"))


def format_double(v: Column) -> Column:
    """The shortest text of a number; whole ones without a point."""
    short = F.when((v == F.floor(v)) & (F.abs(v) < 1e15), F.floor(v).cast("string")).otherwise(v.cast("string"))
    return F.when(F.isnan(v), "NaN").when(v == float("inf"), "+Inf").when(v == float("-inf"), "-Inf").otherwise(short)


def render_histograms(series: DataFrame, help_text: dict[str, str] | None = None) -> DataFrame:
    """Text lines, with ``at`` to sort them by, of cumulative histograms (name, labels map, le, bucket, count, sum)."""
    from loglake.functions.text import escape_label

    pair = lambda e: F.concat(e["key"], F.lit('="'), escape_label(e["value"]), F.lit('"'))
    own = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), pair), ",")
    s = series.withColumn("_own", own)
    braces = F.when(F.col("_own") == "", "").otherwise(F.concat(F.lit("{"), "_own", F.lit("}")))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    le = text(F.when(F.col("_own") == "", "").otherwise(F.concat("_own", F.lit(","))), 'le="', format_double(F.col("le")), '"')
    at = lambda kind, *more: F.struct(F.col("name").alias("name"), F.lit(kind).alias("kind"), *more)
    buckets = s.select(at(1, F.col("_own").alias("labels"), F.col("le").alias("le")).alias("at"), text(F.col("name"), "_bucket{", le, "} ", F.col("bucket").cast("string")).alias("line"))
    once = s.where(F.col("le") == float("inf"))
    sums = once.select(at(1, F.col("_own").alias("labels"), F.lit(float("nan")).alias("le")).alias("at"), text(F.col("name"), "_sum", braces, " ", format_double(F.col("sum")), "\n", F.col("name"), "_count", braces, " ", F.col("count").cast("string")).alias("line"))
    sums = sums.select("at", F.explode(F.split("line", "\n")).alias("line"))
    told = F.create_map(*(F.lit(x) for kv in (help_text or {}).items() for x in kv)) if help_text else F.lit(None).cast("map<string,string>")
    head = s.select("name").distinct().withColumn("_help", F.element_at(told, F.col("name")))
    lines = F.array_compact(F.array(F.when(F.col("_help").isNotNull(), text("# HELP ", F.col("name"), " ", F.col("_help"))), text("# TYPE ", F.col("name"), " histogram")))
    head = head.select(at(0, F.lit("").alias("labels"), F.lit(0.0).alias("le")).alias("at"), F.explode(lines).alias("line"))
    return head.unionByName(buckets).unionByName(sums)
