"""Reading logs: by offset, under a byte budget, by segment; what each partition holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglake.model import PLACE, batches


def watermarks(log: DataFrame, committed: DataFrame | None = None) -> DataFrame:
    """log_start, log_end and high_watermark of each partition. ``committed`` (topic, partition, commit_end) bounds the last."""
    ends = log.groupBy(*PLACE).agg(F.min("offset").alias("log_start"), (F.max("offset") + 1).alias("log_end"))
    if committed is None:
        return ends.withColumn("high_watermark", F.col("log_end"))
    return ends.join(committed, PLACE, "left").withColumn("high_watermark", F.least("log_end", F.greatest("log_start", F.coalesce("commit_end", "log_start")))).drop("commit_end")


def read_from(log: DataFrame, offset: int | Column, upto: DataFrame | None = None, whole_batches: bool = False) -> DataFrame:
    """Records from ``offset`` on, of all partitions; with ``whole_batches`` also those before it in its batch.

    ``upto`` (topic, partition, high_watermark) cuts what isn't visible yet. An offset past the end gives no rows.
    """
    offset = F.lit(offset) if isinstance(offset, int) else offset
    if whole_batches:
        last = batches(log).select(*PLACE, "base_offset", "last_offset").where(F.col("last_offset") >= offset)
        out = log.join(last.drop("last_offset"), [*PLACE, "base_offset"], "left_semi")
    else:
        out = log.where(F.col("offset") >= offset)
    if upto is not None:
        out = out.join(upto.select(*PLACE, "high_watermark"), PLACE).where("offset < high_watermark").drop("high_watermark")
    return out


def out_of_range(requests: DataFrame, marks: DataFrame) -> DataFrame:
    """Fetch requests (topic, partition, fetch_offset) with error: OUT_OF_RANGE below the log's start, UNKNOWN for no such partition."""
    out = requests.join(marks, PLACE, "left")
    error = F.when(F.col("log_end").isNull(), "UNKNOWN_TOPIC_OR_PARTITION").when(F.col("fetch_offset") < F.col("log_start"), "OFFSET_OUT_OF_RANGE").otherwise("NONE")
    return out.withColumn("error", error)


def fetch_outcomes(requests: DataFrame, marks: DataFrame, protocol: str = "native") -> DataFrame:
    """Fetch requests (topic, partition, fetch_offset) with error_code, high_watermark and log_start (null if rejected). ``marks`` has the
    partitions' watermarks and the protocol that wrote them (null: none yet)."""
    out = requests.join(marks, PLACE, "left")
    error = F.when(F.col("log_end").isNull(), "UnknownTopicOrPartition").when(F.col("protocol") != protocol, "InvalidRequest").when(F.col("fetch_offset") < F.col("log_start"), "OffsetOutOfRange").otherwise("None")
    out = out.withColumn("error_code", error)
    seen = lambda c: F.when(F.col("error_code") == "None", F.col(c)).alias(c)
    return out.select(*requests.columns, "error_code", seen("high_watermark"), seen("log_start"))


def byte_budget(log: DataFrame, requests: DataFrame) -> DataFrame:
    """Batches that each request (topic, partition, fetch_offset, max_bytes) gets: those whose predecessors since the offset have
    fewer than max_bytes bytes, so the last one may overshoot. Batches are small rows; record payloads aren't shuffled."""
    found = batches(log).join(requests, PLACE).where("last_offset >= fetch_offset")
    before = Window.partitionBy(*PLACE, "fetch_offset", "max_bytes").orderBy("base_offset").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("bytes_before", F.coalesce(F.sum("bytes").over(before), F.lit(0)).cast("long")).where("bytes_before < max_bytes")


def floor_lookup(probes: DataFrame, anchors: DataFrame, on: list[str], probe: str, anchor: str) -> DataFrame:
    """As-of join: each probe with the greatest anchor at or below it (null if there is none). One union and one window, no range join."""
    a = anchors.select(*on, F.col(anchor).alias("_at"), F.lit(0).alias("_side"), F.col(anchor).alias("_anchor"))
    keep = [c for c in probes.columns if c not in on]
    a = a.select(*a.columns, F.lit(None).cast(probes.select(F.struct(*keep)).schema[0].dataType).alias("_row"))
    p = probes.select(*on, F.col(probe).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(anchors.schema[anchor].dataType).alias("_anchor"), F.struct(*keep).alias("_row"))
    w = Window.partitionBy(*on).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(p).withColumn(anchor, F.last("_anchor", ignorenulls=True).over(w))
    return both.where("_side = 1").select(*on, "_row.*", anchor)


def index_floor(probes: DataFrame, anchors: DataFrame, probe: str) -> DataFrame:
    """Sparse index lookup: the greatest anchor (anchor, position) at or below each probe, (0, 0) where there is none."""
    at = floor_lookup(probes, anchors.select(*PLACE, F.struct("anchor", "position").alias("_entry"), "anchor"), PLACE, probe, "anchor")
    found = at.join(anchors.select(*PLACE, "anchor", "position"), [*PLACE, "anchor"], "left")
    return found.withColumn("anchor", F.coalesce("anchor", F.lit(0)).cast("long")).withColumn("position", F.coalesce("position", F.lit(0)).cast("long"))


def list_offsets(marks: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (topic, partition, timestamp): -2 asks for the start, anything else for the high-watermark."""
    found = requests.join(marks, PLACE, "left")
    offset = F.when(F.col("timestamp") == -2, F.col("log_start")).otherwise(F.col("high_watermark"))
    return found.select(*PLACE, "timestamp", F.coalesce(offset, F.lit(-1)).cast("long").alias("offset"), F.when(F.col("log_end").isNull(), "UNKNOWN_TOPIC_OR_PARTITION").otherwise("NONE").alias("error"))


def poll(log: DataFrame, positions: DataFrame, max_bytes: int = 1 << 20) -> DataFrame:
    """One poll of each consumer (topic, partition, position): the batches it gets and its next position."""
    wanted = positions.select(*PLACE, F.col("position").alias("fetch_offset"), F.lit(max_bytes).cast("long").alias("max_bytes"))
    got = byte_budget(log, wanted).groupBy(*PLACE, "fetch_offset").agg(F.sum("record_count").cast("long").alias("records"), (F.max("last_offset") + 1).alias("next_position"))
    out = wanted.join(got, [*PLACE, "fetch_offset"], "left")
    return out.select(*PLACE, F.col("fetch_offset").alias("position"), F.coalesce("records", F.lit(0)).cast("long").alias("records"), F.coalesce("next_position", "fetch_offset").alias("next_position"))


def valid_prefix(parts: DataFrame, on: list[str], order: str, valid: str) -> DataFrame:
    """Torn-tail recovery: rows before the first invalid one."""
    first_bad = parts.where(~F.col(valid)).groupBy(*on).agg(F.min(order).alias("_bad"))
    return parts.join(first_bad, on, "left").where(F.col("_bad").isNull() | (F.col(order) < F.col("_bad"))).drop("_bad")


def cold_prefix(tier: DataFrame, local: DataFrame, on: list[str]) -> DataFrame:
    """Segments that only the tier holds, oldest first."""
    return tier.join(local, on, "left_anti").orderBy(*on)


def metadata(requested: DataFrame, topics: DataFrame) -> DataFrame:
    """Requested names with their topics; unknown names stay, with an error."""
    return requested.join(topics, "topic", "left").withColumn("error", F.when(F.col("partitions").isNull(), "UNKNOWN_TOPIC").otherwise("NONE"))


def correlate(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests with their responses by connection and correlation id: the first of repeated requests, unknown ids ignored."""
    first = requests.groupBy("conn", "correlation_id").agg(F.min("sent").alias("sent"))
    return first.join(responses, ["conn", "correlation_id"], "left")


def entries_from(entries: DataFrame, next_index: int, most: int = 64) -> DataFrame:
    """At most ``most`` entries of each partition from an index on; indexes have no gaps, so no sort is needed."""
    return entries.where(F.col("index").between(next_index, next_index + most - 1))
