"""Log compaction: the last record per key; keyless records stay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglake.model import PLACE


def compact(log: DataFrame, retain_tombstones: bool = False) -> DataFrame:
    """Keeps each key's last record by offset, without it if it is a tombstone (null value); keyless records all stay.

    Keyless records bypass the window: their null keys would be one group. A window with row_number() = 1 is cut before
    the shuffle by Spark's group limit, so a hot key sends a row per task.
    """
    last = Window.partitionBy(*PLACE, "key").orderBy(F.col("offset").desc())
    keyed = log.where("key is not null").withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")
    if not retain_tombstones:
        keyed = keyed.where("value is not null")
    return keyed.unionByName(log.where("key is null"))


def compaction_stats(log: DataFrame) -> DataFrame:
    """records_in, kept, superseded, tombstones_dropped of each partition, in two small aggregations."""
    keys = log.where("key is not null").groupBy(*PLACE, "key").agg(F.count("*").alias("n"), F.max(F.struct("offset", F.col("value").isNull().alias("dead"))).alias("last"))
    keyed = keys.groupBy(*PLACE).agg(F.sum("n").alias("n"), F.count("*").alias("keys"), F.sum(F.col("last.dead").cast("long")).alias("dead"))
    bare = log.where("key is null").groupBy(*PLACE).agg(F.count("*").alias("bare"))
    out = keyed.join(bare, PLACE, "full").na.fill(0)
    return out.select(*PLACE, (F.col("n") + F.col("bare")).alias("records_in"), (F.col("keys") - F.col("dead") + F.col("bare")).alias("kept"), (F.col("n") - F.col("keys")).alias("superseded"), F.col("dead").alias("tombstones_dropped"))
