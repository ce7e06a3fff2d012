"""Topics: names, creation, alteration, description; error codes; readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Longest topic name, and what one may hold.
NAME = "^[A-Za-z0-9._-]{1,249}$"
#: Wire errors, whether a client may retry, and the core error they stand for.
WIRE_ERRORS = [
    ("None", False, "InvalidArgument"),
    ("UnknownTopicOrPartition", False, "NotFound"),
    ("OffsetOutOfRange", False, "OutOfRange"),
    ("CorruptMessage", False, "Corrupt"),
    ("MessageTooLarge", False, "InvalidArgument"),
    ("OutOfOrderSequence", False, "OutOfRange"),
    ("DuplicateSequence", False, "OutOfRange"),
    ("UnsupportedVersion", False, "Unsupported"),
    ("Unauthorized", False, "InvalidArgument"),
    ("InvalidRequest", False, "InvalidArgument"),
    ("InvalidProducerEpoch", False, "Fenced"),
    ("NotLeaderForPartition", True, "IoError"),
    ("LeaderNotAvailable", True, "IoError"),
    ("RequestTimedOut", True, "IoError"),
    ("NotEnoughReplicas", True, "IoError"),
    ("Throttled", True, "IoError"),
    ("RebalanceInProgress", True, "IoError"),
]
#: Core errors, the wire error that reports them, and their HTTP status.
CORE_ERRORS = [
    ("InvalidArgument", "InvalidRequest", 400),
    ("OutOfRange", "OffsetOutOfRange", 400),
    ("NotFound", "UnknownTopicOrPartition", 404),
    ("Unsupported", "UnsupportedVersion", 501),
    ("OutOfSpace", "LeaderNotAvailable", 507),
    ("Shutdown", "LeaderNotAvailable", 503),
    ("Fenced", "InvalidProducerEpoch", 409),
    ("Corrupt", "CorruptMessage", 500),
    ("IoError", "LeaderNotAvailable", 500),
]


def valid_name(name: str) -> Column:
    return F.coalesce(F.col(name).rlike(NAME) & ~F.col(name).isin(".", ".."), F.lit(False))


def create_topics(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """Outcome of each wanted topic (topic, partitions, retention_ms, retention_bytes): OK, or what is wrong."""
    known = catalog.select(F.col("topic").alias("_known"))
    out = wanted.join(known, F.col("topic") == F.col("_known"), "left")
    error = F.when(~valid_name("topic"), "INVALID_NAME").when(F.col("partitions") < 1, "INVALID_PARTITIONS").when(F.col("_known").isNotNull(), "ALREADY_EXISTS").otherwise("OK")
    return out.withColumn("outcome", error).drop("_known")


def alter_retention(catalog: DataFrame, changes: DataFrame) -> DataFrame:
    """New limits where given; an absent one keeps its value."""
    c = changes.select("topic", F.col("retention_ms").alias("_ms"), F.col("retention_bytes").alias("_bytes"))
    out = catalog.join(c, "topic", "left")
    return out.withColumn("retention_ms", F.coalesce("_ms", "retention_ms")).withColumn("retention_bytes", F.coalesce("_bytes", "retention_bytes")).drop("_ms", "_bytes")


def delete_topic(catalog: DataFrame, log: DataFrame, topic: str) -> tuple[DataFrame, DataFrame]:
    return catalog.where(F.col("topic") != topic), log.where(F.col("topic") != topic)


def describe(catalog: DataFrame, marks: DataFrame) -> DataFrame:
    """Topics with their partitions' watermarks, by name and partition."""
    return catalog.join(marks, "topic", "left").orderBy("topic", "partition")


def describe_cluster(replicated: DataFrame, marks: DataFrame) -> DataFrame:
    """Replicated partitions as they are, and single-node ones as their own leader in term 0."""
    alone = marks.join(replicated, ["topic", "partition"], "left_anti").select(
        "topic", "partition", F.lit("leader").alias("role"), F.lit(0).cast("long").alias("term"), F.col("high_watermark").alias("commit_index"), F.col("high_watermark").alias("last_index")
    )
    return replicated.select(*alone.columns).unionByName(alone).orderBy("topic", "partition")


def ready(probes: DataFrame) -> DataFrame:
    """Ready if every probe is healthy."""
    return probes.groupBy("node").agg(F.bool_and("healthy").alias("ready"))


def wire_errors(spark: SparkSession) -> DataFrame:
    """Wire errors with their core error and its HTTP status."""
    wire = spark.createDataFrame(WIRE_ERRORS, "error string, retryable boolean, core string")
    return wire.join(core_errors(spark).select("core", "http"), "core").select("error", "retryable", "core", "http")


def core_errors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CORE_ERRORS, "core string, wire string, http int")


def negotiate(df: DataFrame, low: int, high: int, asked: str = "max_version") -> DataFrame:
    """Version both sides know: the smaller maximum, 0 if that is below the server's least."""
    return df.withColumn("version", F.when(F.least(F.col(asked), F.lit(high)) >= low, F.least(F.col(asked), F.lit(high))).otherwise(0).cast("int"))
