"""Packing: documents into training sequences by bounded-space online best fit.

Each partition keeps ``open_windows`` windows open. A piece goes to the open window that it fills best; when none
has room, the fullest window is topped up with the piece's head and emitted, and the rest of the piece is placed
again. At a partition's end its open windows are merged into full ones and at most one partial window is left
over. These leftovers are merged in groups of ``merge_fanin``, again and again, until one is left; that one is
cut into sequences whose lengths are powers of two, which need no padding. No task ever holds more than the open
windows, or ``merge_fanin`` leftovers.

Results for odd input: a null or empty text is packed as its terminator alone; a document longer than a window
is cut; rows that repeat are packed once each; an empty table gives no pieces; a null ``doc_id`` is kept as null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.llm.common import Scratch, load, map_batches
from loglake.llm.encoding import VOCABULARY, encoder

WINDOW = 1024
OPEN_WINDOWS = 32
MERGE_FANIN = 64
TERMINATOR = (0).to_bytes(4, "little")

_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("left_in", pa.int64())]
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, ids binary, doc_tokens long, sequence_id long, offset long, left_in long"

#: A piece while it waits: (doc_id, start, ids, doc_tokens)
Piece = tuple


class Packer:
    """The open windows of one partition. ``out`` gets rows; sequence ids are ``base`` and the following numbers."""

    def __init__(self, base: int, window: int, open_windows: int, with_ids: bool):
        self.base, self.window, self.most, self.with_ids = base, window, open_windows, with_ids
        self.windows: list[list] = []  # [tokens used, pieces]
        self.out: list[tuple] = []

    def emit(self, pieces: list[Piece], left_in: int | None = None) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc, start, n, zlib.crc32(ids), ids if self.with_ids or left_in is not None else None, total, self.base, offset, left_in))
            offset += n
        self.base += 1

    def add(self, piece: Piece) -> None:
        doc, start, ids, total = piece
        w, whole = self.window, len(ids) // 4 // self.window * self.window
        for lo in range(0, whole, w):
            self.emit([(doc, start + lo, ids[4 * lo : 4 * (lo + w)], total)])
        start, ids = start + whole, ids[4 * whole :]
        n = len(ids) // 4
        while n:
            best = None
            for x in self.windows:
                if x[0] + n <= w and (best is None or x[0] > best[0]):
                    best = x
            if best is None and len(self.windows) < self.most:
                self.windows.append(best := [0, []])
            if best is not None:
                best[0] += n
                best[1].append((doc, start, ids, total))
                if best[0] == w:
                    self.windows.remove(best)
                    self.emit(best[1])
                return
            full = max(self.windows, key=lambda x: x[0])
            room = w - full[0]
            full[1].append((doc, start, ids[: 4 * room], total))
            self.windows.remove(full)
            self.emit(full[1])
            start, ids, n = start + room, ids[4 * room :], n - room

    def close(self) -> list[Piece]:
        """Merges the open windows; emits those that get full and returns the pieces of the one that stays partial."""
        self.windows.sort(key=lambda x: -x[0])
        pieces = [p for x in self.windows for p in x[1]]
        self.windows, now, used = [], [], 0
        for doc, start, ids, total in pieces:
            while used + len(ids) // 4 >= self.window:
                room = self.window - used
                self.emit([*now, (doc, start, ids[: 4 * room], total)])
                start, ids, now, used = start + room, ids[4 * room :], [], 0
            if ids:
                now.append((doc, start, ids, total))
                used += len(ids) // 4
        return now

    def finish(self, pieces: list[Piece]) -> None:
        """The very last partial window, as sequences whose lengths are powers of two."""
        left = sum(len(p[2]) // 4 for p in pieces)
        queue = list(pieces)
        while left:
            size, now = 1 << (left.bit_length() - 1), []
            left -= size
            while size:
                doc, start, ids, total = queue.pop(0)
                n = min(size, len(ids) // 4)
                now.append((doc, start, ids[: 4 * n], total))
                if len(ids) > 4 * n:
                    queue.insert(0, (doc, start + n, ids[4 * n :], total))
                size -= n
            self.emit(now)

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.out, strict=True)) if self.out else [()] * len(_FIELDS)
        self.out = []
        return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(cols, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])


def _pack(batches: Iterator[pa.RecordBatch], window: int, open_windows: int, with_ids: bool, vocabulary: str) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    packer = Packer(part << 32, window, open_windows, with_ids)
    enc = encoder(vocabulary)
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            rows = batch.slice(lo, 200)
            docs = rows.column(0).to_pylist()
            for doc, ids in zip(docs, enc.encode([t or "" for t in rows.column(1).to_pylist()]), strict=True):
                packer.add((doc, 0, ids + TERMINATOR, len(ids) // 4 + 1))
            if packer.out:
                yield packer.batch()
    if left := packer.close():
        packer.emit(left, part)
    if packer.out:
        yield packer.batch()


def _merge(batches: Iterator[pa.RecordBatch], level: int, fanin: int, window: int, with_ids: bool, last: bool) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (group, left_in, offset); each group's leftovers become full sequences and one leftover."""
    group, packer = None, None

    def done() -> None:
        left = packer.close()
        if left and last:
            packer.finish(left)
        elif left:
            packer.emit(left, group)

    for batch in batches:
        for r in batch.to_pylist():
            if r["left_in"] // fanin != group:
                if packer:
                    done()
                    yield packer.batch()
                group = r["left_in"] // fanin
                packer = Packer(level << 58 | group << 32, window, 1 << 30, with_ids)
                packer.windows = [[0, []]]
            packer.windows[0][1].append((r["doc_id"], r["start"], r["ids"], r["doc_tokens"]))
    if packer:
        done()
        yield packer.batch()


def pack(docs: DataFrame, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, merge_fanin: int = MERGE_FANIN, with_ids: bool = True, vocabulary: str = VOCABULARY) -> DataFrame:
    """Packs ``docs`` (doc_id, text) into sequences of ``window`` tokens.

    Returns a row per piece: doc_id, start (tokens of the document before it), length, ids_crc32, ids (binary, little
    endian; null without ``with_ids``), doc_tokens (with the terminator), sequence_id, offset in the sequence.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    now = scratch.write(map_batches(rows, lambda b: _pack(b, window, open_windows, with_ids, vocabulary), _SCHEMA), "pieces")
    done, level = [], 0
    while True:
        done.append(now.where("left_in is null"))
        left = now.where("left_in is not null")
        groups = left.agg(F.max("left_in"), F.count("*")).first()
        if not groups[1]:
            break
        level += 1
        last = groups[0] < merge_fanin
        part = F.floor(F.col("left_in") / merge_fanin).cast("long")
        dealt = left.repartition(part).sortWithinPartitions("left_in", "offset")
        now = scratch.write(map_batches(dealt, lambda b, n=level, z=last: _merge(b, n, merge_fanin, window, with_ids, z), _SCHEMA), f"merged{level}")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.drop("left_in")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"), with_ids=False).drop("ids")
