"""The log envelope, and logs derived from relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, ShortType, StringType, StructField, StructType, TimestampType

#: Where a record lies.
PLACE = ["topic", "partition"]

HEADERS = ArrayType(StructType([StructField("key", StringType()), StructField("value", BinaryType())]))
ENVELOPE = StructType(
    [
        StructField("topic", StringType()),
        StructField("partition", IntegerType()),
        StructField("offset", LongType()),
        StructField("base_offset", LongType()),
        StructField("record_count", IntegerType()),
        StructField("key", BinaryType()),
        StructField("value", BinaryType()),
        StructField("headers", HEADERS),
        StructField("ts", TimestampType()),
        StructField("codec", StringType()),
        StructField("is_txn", BooleanType()),
        StructField("is_control", BooleanType()),
        StructField("decision", StringType()),
        StructField("producer_id", LongType()),
        StructField("producer_epoch", ShortType()),
        StructField("base_sequence", IntegerType()),
        StructField("encoded_size", LongType()),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def assign_offsets(df: DataFrame, arrival: str, place: list[str] = PLACE, start: Column | int = 0, run: int = 1 << 22) -> DataFrame:
    """Consecutive offsets in arrival order within each partition.

    Arrivals are numbered within runs of ``run`` consecutive values, and each run begins where the runs before it end. So a
    partition's log is sorted by many tasks; only a row per partition and run is summed up in one.
    """
    cut = df.withColumn("_run", F.floor(F.col(arrival) / run).cast("long"))
    counts = cut.groupBy(*place, "_run").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*place).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy(*place, "_run").orderBy(arrival)) - 1
    numbered = cut.withColumn("_local", local).join(counts, [*place, "_run"])
    start = F.lit(start) if isinstance(start, int) else start
    return numbered.withColumn("offset", (start + F.col("_base") + F.col("_local")).cast("long")).drop("_run", "_local", "_base")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as a log of one topic with four partitions.

    Errors are tombstones; signups are control records that commit (value of 25 or more) or abort their producer's
    transaction; batches hold ten records.
    """
    e = table(spark, sf_dir, "events")
    log = e.select(
        F.lit("events").alias("topic"),
        F.pmod("user_id", F.lit(4)).cast("int").alias("partition"),
        F.col("event_id").alias("arrival"),
        F.col("user_id").cast("string").alias("key"),
        F.when(F.col("event_type") != "error", F.col("props")).alias("value"),
        F.pmod("user_id", F.lit(16)).cast("long").alias("producer_id"),
        (F.col("event_type") == "signup").alias("is_control"),
        F.when(F.col("event_type") == "signup", F.when(F.col("value") >= 25, "COMMIT").otherwise("ABORT")).alias("decision"),
        (F.lit(36) + F.length("props")).cast("long").alias("encoded_size"),
        "ts",
        "user_id",
        "event_type",
        F.col("value").alias("amount"),
    )
    log = assign_offsets(log, "arrival")
    return log.withColumn("base_offset", F.col("offset") - F.col("offset") % 10)


#: The same log in SQL, for oracles.
LOG_SQL = """
log AS (
  SELECT 'events' AS topic, CAST(user_id % 4 AS INTEGER) AS "partition", event_id AS arrival, CAST(user_id AS VARCHAR) AS key,
         CASE WHEN event_type <> 'error' THEN props END AS value, user_id % 16 AS producer_id, event_type = 'signup' AS is_control,
         CASE WHEN event_type = 'signup' THEN CASE WHEN value >= 25 THEN 'COMMIT' ELSE 'ABORT' END END AS decision,
         CAST(36 + length(props) AS BIGINT) AS encoded_size, ts, user_id, event_type, value AS amount,
         CAST(row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS BIGINT) AS "offset",
         CAST((row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1) // 10 * 10 AS BIGINT) AS base_offset
  FROM events
)"""


def batches(log: DataFrame) -> DataFrame:
    """A row per batch: base_offset, last_offset, record_count, bytes."""
    return log.groupBy(*PLACE, "base_offset").agg(F.max("offset").alias("last_offset"), F.count("*").cast("int").alias("record_count"), F.sum("encoded_size").alias("bytes"))


BATCH_SQL = """
batch AS (
  SELECT topic, "partition", base_offset, max("offset") AS last_offset, CAST(count(*) AS INTEGER) AS record_count, CAST(sum(encoded_size) AS BIGINT) AS bytes
  FROM log GROUP BY ALL
)"""
