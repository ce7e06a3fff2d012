"""Idempotent produce: sequence checks per producer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from loglake.model import PLACE
from loglake.operators.folds import scan

_OWNER = [*PLACE, "producer_id"]


def classify(batches: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Adds ``verdict`` (Accept, Duplicate, Gap, Fenced) to batches (producer_epoch, base_sequence, record_count).

    A rejected batch changes nothing for those after it, so no window frame can tell: an ordered fold per partition and producer that
    carries two numbers. The first batch's epoch is known before it is checked. Batches that arrive at once are taken by epoch, sequence
    and count.
    """

    def step(state, epoch, first, count):
        known, last = state or (epoch, -1)
        verdict = judge(known, last, epoch, first, count)
        return ((epoch, first + count - 1) if verdict == "Accept" else (known, last)), (verdict,)

    rest = ["producer_epoch", "base_sequence", "record_count"]
    checked = scan(batches.where("producer_id >= 0"), _OWNER, [arrival, *rest], rest, step, [StructField("verdict", StringType())])
    return checked.unionByName(batches.where("producer_id < 0 or producer_id is null").withColumn("verdict", F.lit("Accept")))


def judge(known: int, last: int, epoch: int, first: int, count: int) -> str:
    """A batch of an epoch, from sequence ``first`` on, against a producer's known epoch and last accepted sequence."""
    if epoch != known:
        return "Fenced" if epoch < known else "Accept" if first == 0 else "Gap"
    if first == last + 1:
        return "Accept"
    return "Duplicate" if first + count - 1 <= last else "Gap"


def produce(batches: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Verdicts, and for accepted batches their last offset; a duplicate of the last accepted batch gets that one's."""
    from pyspark.sql import Window

    checked = classify(batches, arrival)
    order = Window.partitionBy(*PLACE).orderBy(arrival).rowsBetween(Window.unboundedPreceding, 0)
    size = F.when(F.col("verdict") == "Accept", F.col("record_count")).otherwise(0)
    checked = checked.withColumn("_end", F.sum(size).over(order) - 1)
    own = Window.partitionBy(*_OWNER).orderBy(arrival).rowsBetween(Window.unboundedPreceding, 0)
    kept = F.last(F.when(F.col("verdict") == "Accept", F.struct(F.col("base_sequence").alias("s"), F.col("_end").alias("o"))), ignorenulls=True).over(own)
    checked = checked.withColumn("_kept", kept)
    again = F.when(F.col("_kept.s") == F.col("base_sequence"), F.col("_kept.o")).otherwise(F.col("_end"))
    last = F.when(F.col("verdict") == "Accept", F.col("_end")).when(F.col("verdict") == "Duplicate", again)
    return checked.withColumn("last_offset", last.cast("long")).drop("_end", "_kept")


def dedup(batches: DataFrame) -> DataFrame:
    """First copy of each (producer, epoch, sequence): enough where producers leave no gaps."""
    first = batches.groupBy(*_OWNER, "producer_epoch", "base_sequence").agg(F.min("arrival").alias("arrival"))
    return batches.join(first, [*_OWNER, "producer_epoch", "base_sequence", "arrival"], "left_semi")


def fenced(batches: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Batches of an epoch older than one that their producer used before."""
    from pyspark.sql import Window

    w = Window.partitionBy(*_OWNER).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    return batches.withColumn("known_epoch", F.max("producer_epoch").over(w)).where("producer_epoch < known_epoch")


def check(state: dict | None, row: dict) -> tuple[dict, str]:
    """One batch (epoch, base_sequence, count) against its producer's state: the step form of ``classify``, for streams."""
    s = dict(state or {"epoch": row["epoch"], "last": -1})
    verdict = judge(s["epoch"], s["last"], row["epoch"], row["base_sequence"], row["count"])
    return ({"epoch": row["epoch"], "last": row["base_sequence"] + row["count"] - 1} if verdict == "Accept" else s), verdict


def resend_step(state: dict | None, row: dict) -> tuple[dict, str]:
    """Batches that each come twice, even arrival numbers first: sequences count the producer's distinct batches."""
    s = dict(state or {"sent": -1, "session": None})
    s["sent"] += row["event_id"] % 2 == 0
    s["sent"] = int(s["sent"])
    s["session"], verdict = check(s["session"], {"epoch": 0, "base_sequence": s["sent"], "count": 1})
    return s, verdict
