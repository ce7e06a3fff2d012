"""Writing: batches, segments, dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField

from loglake.model import PLACE, assign_offsets
from loglake.operators.folds import scan

#: Header names of dead letters, in order.
DEAD_LETTER_HEADERS = ["x-dlq-topic", "x-dlq-partition", "x-dlq-offset", "x-dlq-error", "x-dlq-attempts"]


def append(df: DataFrame, arrival: str, ends: DataFrame | None = None) -> DataFrame:
    """Assigns offsets to new records in arrival order, after each partition's ``log_end`` (ends: topic, partition, log_end)."""
    if ends is None:
        return assign_offsets(df, arrival)
    out = df.join(ends.select(*PLACE, F.col("log_end").alias("_end")), PLACE, "left")
    return assign_offsets(out, arrival, start=F.coalesce(F.col("_end"), F.lit(0))).drop("_end")


def greedy_segments(parts: DataFrame, limit: int, on: list[str] = PLACE, order: str = "base_offset", size: str = "bytes") -> DataFrame:
    """Segment number of each part in order: a new segment begins where the current one has ``limit`` bytes or more.

    The running size restarts with each segment, which no window frame can express: an ordered fold over batch headers.
    """

    def step(state, bytes_):
        n, used = state or (0, 0)
        n, used = (n + 1, bytes_) if used >= limit else (n, used + bytes_)
        return (n, used), (n,)

    heads = parts.select(*on, order, F.col(size).cast("long").alias("_size"))
    return scan(heads, on, [order], ["_size"], step, [StructField("segment", LongType())]).drop("_size")


def index_anchors(parts: DataFrame, interval: int, on: list[str] = PLACE, order: str = "base_offset", size: str = "bytes") -> DataFrame:
    """Sparse index: an anchor at each batch that comes after ``interval`` bytes or more since the last anchor (with 0, at every batch)."""

    def step(since, bytes_):
        hit = since >= interval if since is not None else interval == 0
        return (bytes_ if hit else (since or 0) + bytes_), (hit,)

    heads = parts.select(*on, F.col(order).alias("anchor"), F.col(size).cast("long").alias("_size"))
    return scan(heads, on, ["anchor"], ["_size"], step, [StructField("_hit", BooleanType())]).where("_hit").select(*on, "anchor")


def dead_letters(failed: DataFrame, target: str, error: Column, attempts: Column) -> DataFrame:
    """Failed records for topic ``target``: key, value and headers stay, five headers say where they came from."""
    values = [F.col("topic"), F.col("partition"), F.col("offset"), error, attempts]
    new = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").cast("binary").alias("value")) for k, v in zip(DEAD_LETTER_HEADERS, values, strict=True)))
    return failed.withColumn("headers", F.concat("headers", new)).withColumn("topic", F.lit(target))


def produce_outcomes(requests: DataFrame, catalog: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Produce requests (topic, partition, ``arrival``, valid, protocol, record_count) with error_code and base_offset (null if rejected).

    In this order: a partition that ``catalog`` (topic, partition, log_end) doesn't have, a batch that doesn't decode, and one whose protocol isn't
    the one that the partition's first valid write claimed. Accepted batches follow one another from log_end on.
    """
    before = Window.partitionBy(*PLACE).orderBy(arrival).rowsBetween(Window.unboundedPreceding, 0)
    known = catalog.select(*PLACE, F.col("log_end").alias("_end"))
    out = requests.join(known, PLACE, "left").withColumn("_owner", F.first(F.when(F.col("valid"), F.col("protocol")), ignorenulls=True).over(before))
    error = F.when(F.col("_end").isNull(), "UnknownTopicOrPartition").when(~F.col("valid"), "CorruptMessage").when(F.col("protocol") != F.col("_owner"), "InvalidRequest").otherwise("None")
    out = out.withColumn("error_code", error)
    size = F.when(F.col("error_code") == "None", F.col("record_count")).otherwise(0)
    end = F.col("_end") + F.sum(size).over(before)
    return out.withColumn("base_offset", F.when(F.col("error_code") == "None", end - F.col("record_count")).cast("long")).drop("_end", "_owner")


def records(df: DataFrame, key: str | None = None, value: str | None = None) -> DataFrame:
    """Records to send from rows: a plain one has no key, a tombstone no value; headers are empty."""
    given = lambda c: (F.col(c).cast("string").cast("binary") if c else F.lit(None).cast("binary"))
    return df.withColumn("key", given(key)).withColumn("value", given(value)).withColumn("headers", F.expr("cast(array() AS array<struct<key:string,value:binary>>)"))


def batch_deltas(df: DataFrame, batch: list[str], order: str) -> DataFrame:
    """Offset deltas of a batch's records: their places in the order of insertion."""
    return df.withColumn("delta", (F.row_number().over(Window.partitionBy(*batch).orderBy(order)) - 1).cast("long"))


def reset(log: DataFrame, marks: DataFrame, resets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Empties the partitions of ``resets`` (topic, partition, base): the log that is left, and watermarks that begin and end at the base."""
    to = resets.select(*PLACE, F.col("base").alias("_base"))
    out = marks.join(to, PLACE, "left")
    for c in ("log_start", "log_end", "high_watermark"):
        out = out.withColumn(c, F.coalesce("_base", c))
    return log.join(to, PLACE, "left_anti"), out.drop("_base")


def truncate_suffix(log: DataFrame, offset: int) -> DataFrame:
    """Drops batches that begin at or after ``offset``."""
    return log.where(F.col("base_offset") < offset)


def recovery_point(parts: DataFrame, interval: int) -> DataFrame:
    """Offset up to which each partition is synced, if a sync comes after every ``interval`` bytes."""
    segments = greedy_segments(parts, interval)
    last = segments.groupBy(*PLACE).agg(F.max("segment").alias("_last"))
    done = segments.join(last, PLACE).where("segment < _last")
    ends = parts.join(done, [*PLACE, "base_offset"])
    return ends.groupBy(*PLACE).agg((F.max("last_offset") + 1).alias("recovery_point"))
