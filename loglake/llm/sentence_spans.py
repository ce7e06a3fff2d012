"""Substring dedup by sliding sentence spans.

A text is cut into sentences: after ``.``, ``!`` or ``?`` and white space, at line breaks, and a sentence of more than
``LONGEST`` words also where the hash of two neighbouring words is the least (or one of the least) of the ``REACH`` gaps before and after. Such
a cut depends on the words around it alone, so a passage is cut alike wherever it stands in whatever sentence; there is no
greatest length, as that would count from the sentence's start. From each sentence on, and up to each sentence, the shortest run of consecutive sentences with
at least ``SENTENCES`` sentences and ``WORDS`` words is hashed (surrounding white space ignored). These runs cover every
longer one. Runs are joined by two independent 64-bit hashes over the
whole corpus (of a million million different runs, two share both with a probability of 1e-15); the first is the one with
the smallest (doc_id, place), and every sentence that a later one covers is removed.

Results for odd input: null text stays null, empty text stays empty; a text with too few sentences or words has no run;
rows with the same doc_id and text are one document and get the same result; rows with a null ``doc_id`` count as
first of all; a hash in many documents is counted before it is joined, and its later places are split over tasks by
adaptive execution; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.llm.common import Scratch, WordHash, hash_words, load, map_batches, mix, slices

SENTENCES = 3
WORDS = 25
LONGEST = 20
REACH = 3
#: Words whose hashes a worker remembers.
KNOWN = 50_000
_CUT = re.compile(r"(?<=[.!?])[^\S\n]+|\n+\s*")
_WORDS = re.compile(r"\S+\s*")


def _places(sentences: list[list[str]], table: WordHash) -> list[list[int]]:
    """Where each of some long sentences is cut: numbers of the words that begin a piece. Gaps next to an end have too few neighbours to
    tell. All are looked at together: a window that crosses from one sentence into the next is never asked."""
    sizes = np.fromiter(map(len, sentences), np.int64, len(sentences))
    h = hash_words([w for s in sentences for w in s], table)
    gap = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    least = gap.copy()
    for k in range(1, REACH + 1):
        np.minimum(least[k:], gap[:-k], out=least[k:])
        np.minimum(least[:-k], gap[k:], out=least[:-k])
    first = np.cumsum(sizes) - sizes
    own = np.repeat(np.arange(len(sizes)), sizes)[:-1]
    place = np.arange(len(gap)) - first[own]
    at = np.flatnonzero((gap == least) & (place >= REACH) & (place < sizes[own] - 1 - REACH))
    out: list[list[int]] = [[] for _ in sentences]
    for k, p in zip(own[at].tolist(), (place[at] + 1).tolist(), strict=True):
        out[k].append(p)
    return out


def cut(texts: list[str], longest: int = LONGEST, table: WordHash | None = None) -> list[list[str]]:
    """Each text in pieces with the white space after them; joined they give the text."""
    out, where, long = [], [], []
    for k, text in enumerate(texts):
        own, at = [], 0
        for m in _CUT.finditer(text):
            own.append(text[at : m.end()])
            at = m.end()
        if at < len(text):
            own.append(text[at:])
        for j, s in enumerate(own):
            if len(s) > 2 * longest and len(bare := s.split()) > longest:
                where.append((k, j))
                long.append(bare)
        out.append(own)
    if long:
        pieces: dict[int, dict[int, list[str]]] = {}
        for (k, j), places in zip(where, _places(long, WordHash() if table is None else table), strict=True):
            if places:
                s = out[k][j]
                words = _WORDS.findall(s)
                words[0] = s[: len(s) - sum(map(len, words))] + words[0]
                pieces.setdefault(k, {})[j] = ["".join(words[a:b]) for a, b in itertools.pairwise([0, *places, len(words)])]
        for k, by in pieces.items():
            out[k] = [p for j, s in enumerate(out[k]) for p in by.get(j, (s,))]
    return out


def sentences(text: str, longest: int = LONGEST) -> list[str]:
    return cut([text], longest)[0]


def runs(parts: list[list[str]], n: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The shortest runs from each sentence on and up to each sentence of some texts: two hashes, first sentence, length in sentences;
    and how many runs each text has."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    last = np.cumsum(sizes)
    first = last - sizes
    count = int(sizes.sum())
    h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.strip()) for p in parts for s in p), np.uint64).reshape(count, 2)
    total = np.concatenate([[0], np.cumsum(np.fromiter((len(s.split()) for p in parts for s in p), np.int64, count))])
    at = np.arange(count)
    own = np.repeat(np.arange(len(parts)), sizes)
    end = np.maximum(np.searchsorted(total, total[:-1] + words, "left"), at + n)
    start = np.minimum(np.searchsorted(total, total[1:] - words, "right") - 1, at + 1 - n)
    both = np.unique(np.concatenate([(at * (count + 1) + end)[end <= last[own]], (start * (count + 1) + at + 1)[start >= first[own]]]))
    at, length = both // (count + 1), both % (count + 1) - both // (count + 1)
    out = np.zeros((len(at), 2), np.uint64)
    for k in range(int(length.max(initial=0))):
        live = length > k
        out[live] = mix(out[live] * np.uint64(0x9E3779B97F4A7C15) + h[at[live] + k])
    own = own[at]
    out = np.ascontiguousarray(out.T).view(np.int64)
    return out[0], out[1], (at - first[own]).astype(np.int32), length.astype(np.int32), np.bincount(own, minlength=len(parts))


def _hashes(batches: Iterator[pa.RecordBatch], n: int, words: int, longest: int) -> Iterator[pa.RecordBatch]:
    table = WordHash(most=KNOWN)
    for batch in batches:
        for rows in slices(batch, 1):
            *got, sizes = runs(cut([t or "" for t in rows.column(1).to_pylist()], longest, table), n, words)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(g)) for g in got]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), *lists], names=["doc_id", "th", "h", "h2", "at", "n"])


def _remove(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[pa.RecordBatch]:
    table = WordHash(most=KNOWN)
    for batch in (rows for b in batches for rows in slices(b, 1)):
        texts, cuts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        out, sizes = [], []
        pieces = iter(cut([t for t, spans in zip(texts, cuts, strict=True) if spans], longest, table))
        for text, spans in zip(texts, cuts, strict=True):
            if not spans:
                out.append(text)
                sizes.append(0)
                continue
            parts = next(pieces)
            gone = np.zeros(len(parts) + 1, np.int64)
            for s in spans:
                gone[s["at"]] += 1
                gone[s["at"] + s["n"]] -= 1
            gone = np.cumsum(gone)[:-1] > 0
            out.append("".join(p for p, g in zip(parts, gone.tolist(), strict=True) if not g))
            sizes.append(int(gone.sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(sizes, pa.int32())], names=["doc_id", "text", "n_removed"])


def repeated_spans(docs: DataFrame, n: int = SENTENCES, words: int = WORDS, longest: int = LONGEST, scratch: Scratch | None = None) -> DataFrame:
    """Non-first repeated runs: doc_id, th (hash of the text), at (sentence), n (sentences), first_doc."""
    scratch = scratch or Scratch(docs.sparkSession, "spans")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    hashed = scratch.write(map_batches(rows, lambda b: _hashes(b, n, words, longest), "doc_id long, th long, h array<long>, h2 array<long>, at array<int>, n array<int>"), "hashes")
    flat = hashed.select("doc_id", "th", F.explode(F.arrays_zip("h", "h2", "at", "n")).alias("x")).select("doc_id", "th", "x.h", "x.h2", "x.at", "x.n")
    place = F.struct(F.col("doc_id"), F.col("th"), F.col("at"))
    # a table joined with a table: only then does adaptive execution split a hash that many documents share
    first = scratch.write(flat.groupBy("h", "h2").agg(F.count("*").alias("_n")).where("_n > 1").select("h", "h2"), "repeated")
    # only places of hashes that occur twice go on, a small part of all
    again = scratch.write(flat.join(first, ["h", "h2"]), "again")
    first = scratch.write(again.groupBy("h", "h2").agg(F.min(place).alias("first")), "first")
    return scratch.write(again.join(first, ["h", "h2"]).where(place != F.col("first")).select("doc_id", "th", "at", "n", F.col("first.doc_id").alias("first_doc")), "later")


def dedup_spans(docs: DataFrame, n: int = SENTENCES, words: int = WORDS, longest: int = LONGEST) -> DataFrame:
    """Each document without the sentences that later copies cover: doc_id, text, n_removed."""
    scratch = Scratch(docs.sparkSession, "spans")
    later = repeated_spans(docs, n, words, longest, scratch)
    cuts = later.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("at", "n"))).alias("spans"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts = cuts.withColumnsRenamed({"doc_id": "_d", "th": "_t"})
    cut = rows.join(cuts, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_t")), "left").select("doc_id", "text", "spans")
    return map_batches(cut, lambda b: _remove(b, longest), "doc_id long, text string, n_removed int")


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_spans(load(spark, sf_dir, "documents"))
