"""Live logs: Structured Streaming forms of the batch operators, over the same step functions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tail(spark: SparkSession, sf_dir: str, table: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of a table's files; ``files_per_trigger`` is the back-pressure limit."""
    path = f"{sf_dir}/{table}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        # a stream reads folders: that of the file, and of its files that one
        path, reader = sf_dir, reader.option("pathGlobFilter", f"{table}.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def window_counts(events: DataFrame, ts: str = "ts", width: str = "1 day", late: str = "1 hour", on: tuple[str, ...] = ("event_type",), slide: str | None = None) -> DataFrame:
    """Counts per window (tumbling, or sliding by ``slide``) and key; events later than the watermark are dropped."""
    e = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    out = e.groupBy(F.window("_ts", width, slide), *on).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), *on, "n")


def latest(log: DataFrame) -> DataFrame:
    """Compaction as a stream: each key's newest record, in complete or update mode."""
    best = log.where("key is not null").groupBy("topic", "partition", "key").agg(F.max(F.struct("offset", "value")).alias("_l"))
    return best.select("topic", "partition", "key", F.col("_l.offset").alias("offset"), F.col("_l.value").alias("value"))


def sessions(beats: DataFrame, member: str, ts: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Members' sessions by event time; a gap ends one."""
    b = beats.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    out = b.groupBy(member, F.session_window("_ts", gap)).agg(F.count("*").alias("heartbeats"))
    return out.select(member, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("expires"), "heartbeats")


def dedup(batches: DataFrame, ts: str, late: str, on: list[str]) -> DataFrame:
    """Drops repeated batches that arrive within the watermark."""
    return batches.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark(on).drop("_ts")


def stateful(stream: DataFrame, on: list[str], order: str, step: Callable, result: str) -> DataFrame:
    """Runs a step function (state, row) -> (state, result) per key over a stream, in order within each micro-batch. The state is kept
    in the checkpointed state store, so it outlives restarts."""
    import json

    types = dict(stream.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*on, order]) + f", result {result}"

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else None
        rows = pd.concat(list(frames)).sort_values(order)
        out = []
        for row in rows.to_dict("records"):
            now, got = step(now, row)
            out.append((*key, row[order], got))
        state.update((json.dumps(now),))
        yield pd.DataFrame(out, columns=[*on, order, "result"])

    return stream.groupBy(*on).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns what it emitted, as a table in the shared folder."""
    from loglake.sources.shared import shared_dir

    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{root}/out")

    def put(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{root}/out/{number}")

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{root}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    last = max(int(p["batchId"]) for p in q.recentProgress)
    return spark.read.schema(stream.schema).parquet(f"{root}/out/{last}")
