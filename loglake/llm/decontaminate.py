"""Benchmark decontamination by spaced seeds.

Words are lower-cased and stripped of punctuation. Each mask hashes the words at its 1s and ignores those at its 0s, so a
substituted word at an ignored position doesn't lose the hit: ``MASKS`` for items of ``WINDOW`` words or more; for a shorter
item, masks of its own length that leave out every set of words that may differ. Training and test hashes are tables that are
joined, hot hashes split by adaptive execution. Either side brings the words around its seed, so a hit is verified where it
was joined: item and document are compared word by word on the hit's diagonal, and the document is contaminated where some
``WINDOW`` consecutive words of the item (the whole item, if it is shorter) agree in at least ``SIMILARITY`` of the positions.

Before the join, a document's seeds go through a filter of the test hashes (two bits each of ``2 ** FILTER_BITS``), which is
put together by an aggregation and broadcast: its size is fixed, however large the benchmark is. It loses no hit; the larger
the benchmark, the more seeds pass it and are left to the join.

Results for odd input: null or empty texts and items are in no pair; rows that repeat the same doc_id and text, or the same
item_id and text, are one document or item; of several places of an item in a document (ties too), the one with the most words
in agreement counts, then the longest, then the first; empty tables: no pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.llm.common import Scratch, WordHash, hash_words, load, map_batches, mix

MASKS = ("11101011", "1101100111", "111010010111")
WINDOW = 13
SIMILARITY = 0.8
FILTER_BITS = 26
_STRIP = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "«»“”„‘’¿¡…–—"
_SEED = "h long, id long, th long, pos int, own int, size int, words array<long>"


def _norm(word: str) -> str:
    return word.lower().strip(_STRIP)


def words_of(text: str | None, table: WordHash) -> np.ndarray:
    """Hashes of a text's words; those without a letter or digit are left out."""
    h = hash_words((text or "").split(), table)
    return h[h != 0]


def least_matches(size: int, similarity: float) -> int:
    return math.ceil(similarity * size - 1e-9)


def short_masks(size: int, similarity: float) -> list[str]:
    """Masks of a whole item of ``size`` words, one of which ignores any set of positions that may differ: of 2 n + 1 groups of
    neighbouring positions each leaves out n, if n words may differ."""
    n = size - least_matches(size, similarity)
    group = [k * (2 * n + 1) // size for k in range(size)]
    return ["".join("0" if g in out else "1" for g in group) for out in itertools.combinations(sorted(set(group)), n)]


def _seeds(w: np.ndarray, mask: str) -> np.ndarray:
    n = len(w) - len(mask) + 1
    h = np.full(max(n, 0), int(mask, 2) * 64 + len(mask), np.uint64)
    if n > 0:
        for k, c in enumerate(mask):
            if c == "1":
                h *= np.uint64(0x9E3779B97F4A7C15)
                h += w[k : k + n]
    return mix(h)


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return h >> np.uint64(64 - bits), (h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - bits)


def _rows(h: np.ndarray, pos: np.ndarray, mask: str, w: np.ndarray, bounds: np.ndarray, ids: pa.Array, ths: pa.Array, window: int) -> pa.RecordBatch:
    """Seeds at ``pos`` of texts that stand one after another in ``w``, each with the words of every window that holds it."""
    doc = np.searchsorted(bounds, pos, "right") - 1
    lo, hi = np.maximum(pos - max(0, window - len(mask)), bounds[doc]), np.minimum(pos + max(window, len(mask)), bounds[doc + 1])
    offsets = np.concatenate([[0], np.cumsum(hi - lo)])
    at = np.arange(offsets[-1]) + np.repeat(lo - offsets[:-1], hi - lo)
    words = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(w[at].view(np.int64)))
    take, i32 = pa.array(doc), pa.int32()
    size = (bounds[doc + 1] - bounds[doc]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), ids.take(take), ths.take(take), pa.array((pos - bounds[doc]).astype(np.int32), i32), pa.array((pos - lo).astype(np.int32), i32), pa.array(size, i32), words], names=["h", "id", "th", "pos", "own", "size", "words"])


def _item_seeds(batches: Iterator[pa.RecordBatch], window: int, similarity: float, masks: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    table = WordHash(_norm)
    for batch in batches:
        for k, text in enumerate(batch.column(1).to_pylist()):
            w = words_of(text, table)
            if not len(w):
                continue
            for mask in masks if len(w) >= window else short_masks(len(w), similarity):
                h = _seeds(w, mask)
                yield _rows(h, np.arange(len(h)), mask, w, np.array([0, len(w)]), batch.column(0).slice(k, 1), batch.column(2).slice(k, 1), window)


def _filter_words(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The filter's words (64 bits each) that a partition's hashes set bits of."""
    filled = np.zeros(max(1, 1 << bits >> 6), np.uint64)
    for batch in batches:
        h = batch.column(0).to_numpy().view(np.uint64)
        for slot in _slots(h, bits):
            np.bitwise_or.at(filled, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
    used = np.flatnonzero(filled)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(filled[used].view(np.int64))], names=["word", "bits"])


def _doc_seeds(batches: Iterator[pa.RecordBatch], known, bits: int, masks: list[str], window: int) -> Iterator[pa.RecordBatch]:
    table, filled = WordHash(_norm), np.unpackbits(known.value.view(np.uint8), bitorder="little").view(bool)
    for batch in batches:
        for lo in range(0, batch.num_rows, 100):
            rows = batch.slice(lo, 100)
            words = [words_of(t, table) for t in rows.column(1).to_pylist()]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in words])]).astype(np.int64)
            w = np.concatenate(words)
            for mask in masks:
                h = _seeds(w, mask)
                if not len(h):
                    continue
                pos = np.flatnonzero(filled[(h >> np.uint64(64 - bits)).astype(np.int64)])
                pos = pos[filled[_slots(h[pos], bits)[1].astype(np.int64)]]
                pos = pos[pos + len(mask) <= bounds[np.searchsorted(bounds, pos, "right")]]
                if len(pos):
                    yield _rows(h[pos], pos, mask, w, bounds, rows.column(0), rows.column(2), window)


def _verify(batches: Iterator[pa.RecordBatch], window: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Hits in which some window agrees well enough: document, item, diagonal, first and last word (exclusive) of such windows, and the
    most words in agreement in one of them."""
    for batch in batches:
        keep, cols = [], ([], [], [], [], [])
        c = {n: batch.column(n).to_pylist() for n in ("pos", "own", "ipos", "iown", "isize")}
        docs, items = batch.column("words"), batch.column("iwords")
        for k, (pos, own, ipos, iown, isize) in enumerate(zip(*c.values(), strict=True)):
            d, x = docs[k].values.to_numpy(), items[k].values.to_numpy()
            before, after = min(own, iown), min(len(d) - own, len(x) - iown)
            same = d[own - before : own + after] == x[iown - before : iown + after]
            size = min(window, isize)
            if len(same) < size:
                continue
            total = np.concatenate([[0], np.cumsum(same)])
            got = total[size:] - total[:-size]
            good = np.flatnonzero(got >= least_matches(size, similarity))
            if len(good):
                keep.append(k)
                for col, v in zip(cols, (pos - ipos, pos - before + int(good[0]), pos - before + int(good[-1]) + size, int(got.max()), size), strict=True):
                    col.append(v)
        take = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(n).take(take) for n in ("id", "th", "item_id", "ith")] + [pa.array(x, pa.int32()) for x in cols], names=["doc_id", "th", "item_id", "ith", "diagonal", "first", "last", "matched", "compared"])


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY, masks: tuple[str, ...] = MASKS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Pairs of a document (doc_id, text) and a benchmark item (item_id, text) it contains: doc_id, item_id, first_word, last_word (of
    the document's words, in windows that agree), matched and compared (words in agreement in the best window, and its words)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    items = items.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("length(text) > 0").distinct()
    tests = scratch.write(map_batches(items.select("id", "text", F.xxhash64("text").alias("th")), lambda b: _item_seeds(b, window, similarity, masks), _SEED), "items")
    filled = np.zeros(max(1, 1 << filter_bits >> 6), np.uint64)
    words = map_batches(tests.select("h"), lambda b: _filter_words(b, filter_bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    filled[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    sizes = sorted(r["size"] for r in tests.where(F.col("size") < window).select("size").distinct().collect())  # fewer than a window's words
    every = [*masks, *(m for n in sizes for m in short_masks(n, similarity))]
    known = spark.sparkContext.broadcast(filled)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("th")).where("length(text) > 0")
    train = scratch.write(map_batches(rows, lambda b: _doc_seeds(b, known, filter_bits, every, window), _SEED), "documents")
    test = tests.select("h", F.col("id").alias("item_id"), F.col("th").alias("ith"), F.col("pos").alias("ipos"), F.col("own").alias("iown"), F.col("size").alias("isize"), F.col("words").alias("iwords"))
    hits = train.join(test, "h").select("id", "th", "pos", "own", "words", "item_id", "ith", "ipos", "iown", "isize", "iwords")
    found = map_batches(hits, lambda b: _verify(b, window, similarity), "doc_id long, th long, item_id long, ith long, diagonal int, first int, last int, matched int, compared int")
    pair = ["doc_id", "th", "item_id", "ith"]
    lines = found.groupBy(*pair, "diagonal").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("matched").alias("matched"), F.max("compared").alias("compared"))
    best = lines.groupBy(*pair).agg(F.max(F.struct("matched", (F.col("last") - F.col("first")).alias("length"), (-F.col("first")).alias("before"), "compared")).alias("x"))
    return best.select("doc_id", "item_id", (-F.col("x.before")).alias("first_word"), (F.col("x.length") - F.col("x.before") - 1).alias("last_word"), "x.matched", "x.compared")


def remove_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents in which no benchmark item was found, with all their columns. A null ``doc_id`` row is kept."""
    bad = contaminated(docs, items, **options).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["_bad"], "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
