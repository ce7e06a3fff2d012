"""Retention over segments: oldest first, whole segments, never the active one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglake.model import PLACE


def retain(segments: DataFrame, retention_bytes: int = -1, retention_micros: int = -1, now_micros: int | None = None) -> DataFrame:
    """Segments (base_offset, bytes, mtime) that stay. A segment goes while what is left exceeds ``retention_bytes`` (negative: no
    limit), or it is older than ``retention_micros``; the first that may stay ends it."""
    order = Window.partitionBy(*PLACE).orderBy("base_offset")
    s = segments.withColumn("_left", F.sum("bytes").over(Window.partitionBy(*PLACE).orderBy(F.col("base_offset").desc()).rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("_active", F.lead("base_offset").over(order).isNull())
    may = F.lit(False)
    if retention_bytes >= 0:
        may = may | (F.col("_left") > retention_bytes)
    if retention_micros >= 0:
        may = may | (F.lit(now_micros) - F.col("mtime") > retention_micros)
    s = s.withColumn("_go", may & ~F.col("_active"))
    gone = F.min(F.col("_go").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1
    return s.withColumn("_gone", gone).where(~F.col("_gone")).drop("_left", "_active", "_go", "_gone")


def retain_by_topic(segments: DataFrame, policies: DataFrame, now_micros: int) -> DataFrame:
    """Like ``retain`` with each topic's own limits (topic, retention_bytes, retention_micros; null: no limit)."""
    order = Window.partitionBy(*PLACE).orderBy("base_offset")
    s = segments.join(policies, "topic", "left")
    s = s.withColumn("_left", F.sum("bytes").over(Window.partitionBy(*PLACE).orderBy(F.col("base_offset").desc()).rowsBetween(Window.unboundedPreceding, 0)))
    active = F.lead("base_offset").over(order).isNull()
    may = F.coalesce(F.col("_left") > F.col("retention_bytes"), F.lit(False)) | F.coalesce(F.lit(now_micros) - F.col("mtime") > F.col("retention_micros"), F.lit(False))
    s = s.withColumn("_active", active).withColumn("_go", may & ~F.col("_active"))
    s = s.withColumn("_gone", F.min(F.col("_go").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    return s.where(~F.col("_gone")).select(*segments.columns)


def truncate_prefix(segments: DataFrame, offset: int) -> DataFrame:
    """Drops whole sealed segments below ``offset``: those whose successor begins at or below it."""
    order = Window.partitionBy(*PLACE).orderBy("base_offset")
    return segments.withColumn("_next", F.lead("base_offset").over(order)).where(F.col("_next").isNull() | (F.col("_next") > offset)).drop("_next")


def offload(segments: DataFrame) -> DataFrame:
    """Labels sealed segments ``cold`` and each partition's last one ``hot``."""
    order = Window.partitionBy(*PLACE).orderBy("base_offset")
    return segments.withColumn("tier", F.when(F.lead("base_offset").over(order).isNull(), "hot").otherwise("cold"))
