"""Token counts by section: whole documents are encoded once and their tokens attributed to sections by position.

A document's sections are intervals of code points that cover it (by default its lines, each with its line break).
Token character spans, from the encoding's byte offsets, are interval-joined with the sections. A token belongs to
the section that holds most of its characters, and to the earlier section on a tie; tokens that cross a boundary are
also counted on their own. A character whose bytes are spread over several tokens counts as held by each of them.

Results for odd input: a null or empty text has one empty section with no tokens; rows that repeat are counted
once each; an empty table gives no rows; a null ``doc_id`` is kept as null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.llm.common import load, map_batches
from loglake.llm.encoding import VOCABULARY, encoder

#: A section ends after each match.
SECTION_END = r"\n"
_SCHEMA = "doc_id long, section int, start int, end int, n_tokens int, n_crossing int"
_ARROW = pa.schema([("doc_id", pa.int64()), ("section", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("n_tokens", pa.int32()), ("n_crossing", pa.int32())])


def token_spans(text: str, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points at which each token begins and ends (exclusive)."""
    last = np.cumsum(lengths[ids])
    if text.isascii():
        return last - lengths[ids], last
    lead = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
    return lead[last - lengths[ids]] - 1, lead[last - 1]


def attribute(ends: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens, and boundary-crossing tokens, of each section; ``ends`` are the sections' ends."""
    first = np.searchsorted(ends, start, "right")
    last = np.searchsorted(ends, stop - 1, "right")
    owner = first.copy()
    crossing = np.flatnonzero(first != last)
    for k in crossing.tolist():
        edges = np.concatenate([[start[k]], ends[first[k] : last[k]], [stop[k]]])
        owner[k] = first[k] + int(np.argmax(np.diff(edges)))
    return np.bincount(owner, minlength=len(ends)), np.bincount(owner[crossing], minlength=len(ends))


def _count(batches: Iterator[pa.RecordBatch], section_end: str, vocabulary: str) -> Iterator[pa.RecordBatch]:
    enc, cut = encoder(vocabulary), re.compile(section_end)
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            rows = batch.slice(lo, 200)
            docs, texts = rows.column(0), [t or "" for t in rows.column(1).to_pylist()]
            cols: list[list] = [[], [], [], [], []]
            sizes = []
            for text, raw in zip(texts, enc.encode(texts), strict=True):
                ends = [m.end() for m in cut.finditer(text) if m.end() > 0]
                if not ends or ends[-1] < len(text):
                    ends.append(len(text))
                ends = np.unique(np.array(ends, np.int64))
                ids = np.frombuffer(raw, "<u4")
                n, crossing = attribute(ends, *token_spans(text, ids, enc.length)) if len(ids) else (np.zeros(len(ends), int),) * 2
                sizes.append(len(ends))
                for c, x in zip(cols, (np.arange(len(ends)), np.concatenate([[0], ends[:-1]]), ends, n, crossing), strict=True):
                    c.append(x)
            if texts:
                doc = docs.take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                yield pa.RecordBatch.from_arrays([doc, *(pa.array(np.concatenate(c).astype(np.int32)) for c in cols)], schema=_ARROW)


def count_tokens(docs: DataFrame, section_end: str = SECTION_END, vocabulary: str = VOCABULARY) -> DataFrame:
    """A row per document and section: doc_id, section, start, end, n_tokens, n_crossing."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, lambda b: _count(b, section_end, vocabulary), _SCHEMA)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(load(spark, sf_dir, "documents"))
