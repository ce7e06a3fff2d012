"""Segments as files: written by a Python data source sink, read through Spark's own binary reader (so from any store).

A batch's header has its attribute bits and producer fields; records that differ in one of them are batches of their own, each
with its first record's offset as base. The format has no time stamp of a batch, so of times only the records' deltas are kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from loglake.functions.records import CODEC_BITS, CODECS, CONTROL_BIT, TXN_BIT, decode_records, decompress, encode_batch, encode_record, scan_batches

SCHEMA = "topic string, partition int, offset bigint, base_offset bigint, record_count int, key binary, value binary, headers array<struct<key:string,value:binary>>, codec string, is_txn boolean, is_control boolean, producer_id bigint, producer_epoch smallint, base_sequence int, ts_delta bigint"
_HEADERS = pa.list_(pa.struct([("key", pa.string()), ("value", pa.binary())]))
_ARROW = pa.schema(
    [
        ("topic", pa.string()), ("partition", pa.int32()), ("offset", pa.int64()), ("base_offset", pa.int64()), ("record_count", pa.int32()), ("key", pa.binary()), ("value", pa.binary()),
        ("headers", _HEADERS), ("codec", pa.string()), ("is_txn", pa.bool_()), ("is_control", pa.bool_()), ("producer_id", pa.int64()), ("producer_epoch", pa.int16()), ("base_sequence", pa.int32()), ("ts_delta", pa.int64()),
    ]
)


def decode_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            *_, topic, partition, _ = path.split("/")
            rows = []
            for h, payload in scan_batches(content):
                codec = CODECS[h["attrs"] & CODEC_BITS]
                for ts, off, key, value, headers in decode_records(decompress(payload, codec), h["record_count"]):
                    rows.append((topic, int(partition), h["base_offset"] + off, h["base_offset"], h["record_count"], key, value, [{"key": k, "value": v} for k, v in headers], codec, bool(h["attrs"] & TXN_BIT), bool(h["attrs"] & CONTROL_BIT), h["producer_id"], h["producer_epoch"], h["base_sequence"], ts))
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _ARROW, strict=True)], schema=_ARROW)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Records of ``path/<topic>/<partition>/<base>.log``: each segment's longest valid prefix. A segment is one task's unit, as it
    is bounded by the segment size it was written with."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.log").load(path)
    return files.select("path", "content").mapInArrow(decode_files, SCHEMA)


class SegmentSink(DataSource):
    """``df.write.format("loglake_segments")``: rows (topic, partition, base_offset, content) become files."""

    @classmethod
    def name(cls) -> str:
        return "loglake_segments"

    def schema(self) -> str:
        return "topic string, partition int, base_offset bigint, content binary"

    def writer(self, schema, overwrite: bool) -> SegmentWriter:
        return SegmentWriter(self.options["path"])


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: where each stands, and its place in the log."""

    files: list[tuple[str, str]]


class SegmentWriter(DataSourceArrowWriter):
    """Tasks write below a folder of the job that readers pass over; its files move into place when all tasks are done, and go if the
    job fails. Each attempt has names of its own, so that of a repeated task only the committed one counts."""

    def __init__(self, path: str):
        self.path, self.job = path, f"_job-{uuid.uuid4().hex}"

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = self._store()
        folder, files = f"{root}/{self.job}/{uuid.uuid4().hex}", []
        store.create_dir(folder, recursive=True)
        for batch in iterator:
            for topic, partition, base, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files.append((f"{folder}/{len(files)}", f"{topic}/{partition}/{base:020d}.log"))
                with store.open_output_stream(files[-1][0]) as f:
                    f.write(content)
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = self._store()
        files = [pair for m in messages if m for pair in m.files]
        for folder in {place.rsplit("/", 1)[0] for _, place in files}:
            store.create_dir(f"{root}/{folder}", recursive=True)
        for own, place in files:
            store.move(own, f"{root}/{place}")
        self._clean(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*self._store())

    def _clean(self, store, root: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.job}")


def _encode(batches: Iterator[pa.RecordBatch], codec: str, segment_bytes: int) -> Iterator[pa.RecordBatch]:
    out_schema = pa.schema([("topic", pa.string()), ("partition", pa.int32()), ("base_offset", pa.int64()), ("content", pa.binary())])
    place, given, base, head, rows, first, content = None, None, None, None, [], None, bytearray()

    def seal() -> None:
        nonlocal rows
        if rows:
            attrs, *producer = head
            content.extend(encode_batch(base, rows, codec, attrs, *producer))
            rows = []

    def roll() -> pa.RecordBatch:
        nonlocal first, content
        got = pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((*place, first, bytes(content)), out_schema, strict=True)], schema=out_schema)
        first, content = None, bytearray()
        return got

    for batch in batches:
        for r in batch.to_pylist():
            here = (r["topic"], r["partition"])
            now = ((TXN_BIT if r["is_txn"] else 0) | (CONTROL_BIT if r["is_control"] else 0), r["producer_id"], r["producer_epoch"], r["base_sequence"])
            if (here, r["base_offset"]) != (place, given) or now != head:
                seal()
                if content and (here != place or len(content) >= segment_bytes):
                    yield roll()
                # the rest of a batch that is cut begins at its own first record
                base = r["offset"] if (here, r["base_offset"]) == (place, given) else r["base_offset"]
                place, given, head = here, r["base_offset"], now
                first = base if first is None else first
            headers = [(h["key"], h["value"]) for h in r["headers"] or []]
            rows.append(encode_record(r["key"], r["value"], headers, r["ts_delta"], r["offset"] - base))
    seal()
    if content:
        yield roll()


def encode_segments(log: DataFrame, codec: str = "zstd", segment_bytes: int = 64 << 20) -> DataFrame:
    """Segments (topic, partition, base_offset, content) of a log; each partition's records are sorted by offset and streamed. Of the
    envelope's columns after ``value``, those that the log has are kept; base_sequence is that of a record's batch."""
    cols = ["topic", "partition", "offset", "base_offset", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value")]
    empty = F.expr("cast(array() AS array<struct<key:string,value:binary>>)")
    more = {"is_txn": ("boolean", False), "is_control": ("boolean", False), "producer_id": ("long", -1), "producer_epoch": ("short", -1), "base_sequence": ("int", -1), "ts_delta": ("long", 0)}
    kept = [(F.coalesce(F.col(c).cast(t), F.lit(v).cast(t)) if c in log.columns else F.lit(v).cast(t)).alias(c) for c, (t, v) in more.items()]
    rows = log.select(*cols, (F.col("headers") if "headers" in log.columns else empty).alias("headers"), *kept)
    rows = rows.repartition("topic", "partition").sortWithinPartitions("topic", "partition", "offset")
    return rows.mapInArrow(lambda b: _encode(b, codec, segment_bytes), "topic string, partition int, base_offset bigint, content binary")


def write_segments(log: DataFrame, path: str, codec: str = "zstd", segment_bytes: int = 64 << 20) -> None:
    spark = log.sparkSession
    spark.dataSource.register(SegmentSink)
    encode_segments(log, codec, segment_bytes).write.format("loglake_segments").option("path", path).mode("append").save()
