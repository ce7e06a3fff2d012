"""Quality classifier: supervised subword embeddings, trained by stochastic gradient descent in numpy.

A document is the average of learned vectors of its hashed word 1- and 2-grams and character 2- to 4-grams, put through
a linear layer and softmax. A word bigram of two equal words has a bucket of its own. As the average is linear, scoring
needs one number per bucket (its vector's part of the logit), a table of 4 bytes x 2 ** ``BITS`` that is broadcast; the
table's size doesn't depend on the corpus.

Training takes at most ``TRAIN_ROWS`` labelled documents (those with the smallest hash of their id, none longer than
``TRAIN_CHARS``), gathered on the driver: a bound of rows x features; each is gone over ``EPOCHS`` times, or until there were
``LEAST_STEPS`` steps. Scores cover all documents and whole texts.

Results for odd input: null and empty texts have no n-grams and get the score of the bias alone; rows that repeat are
scored once each; with no label to learn from, every score is 0.5; of several labels of one document, each counts; an
empty table gives no rows; a null ``doc_id`` is scored, is never labelled and is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.llm.common import WordHash, hash_words, load, map_batches

BITS = 18
DIM = 8
EPOCHS = 3
#: Steps of training at least; few rows are gone over more often.
LEAST_STEPS = 2000
RATE = 0.5
CHAR_NGRAMS = (2, 3, 4)
TRAIN_ROWS = 2000
TRAIN_CHARS = 50_000
#: Characters whose n-grams are hashed at once; a longer text is taken in overlapping blocks.
BLOCK = 1 << 15
_P, _Q = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
_REPEAT = np.uint32(0x51ED270B)


def buckets(text: str, table: WordHash, bits: int = BITS) -> Iterator[np.ndarray]:
    """The bucket of each of a text's n-grams, in blocks."""
    shift = np.uint32(32 - bits)
    text = text.lower()
    w = hash_words(text.split(), table).astype(np.uint32)
    if len(w):
        yield (w * _P) >> shift
    if len(w) > 1:
        pair = (w[:-1] * _Q + w[1:]) * _P
        pair ^= pair >> np.uint32(15)
        pair[w[:-1] == w[1:]] = _REPEAT
        yield (pair * _Q) >> shift
    for lo in range(0, len(text), BLOCK):
        c = np.frombuffer(text[lo : lo + BLOCK + max(CHAR_NGRAMS) - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        h = c
        for n in range(2, max(CHAR_NGRAMS) + 1):
            if len(h) < 2:
                break
            h = h[:-1] * _Q
            h += c[n - 1 :]
            if n in CHAR_NGRAMS:
                own = (h[:BLOCK] + np.uint32(n)) * _P
                own >>= shift
                yield own


def features(text: str, table: WordHash, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    got = list(buckets(text, table, bits))
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    ids, n = np.unique(np.concatenate(got), return_counts=True)
    return ids, (n / n.sum()).astype(np.float32)


def train(texts: list[str], labels: list[int], bits: int = BITS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> tuple[np.ndarray, float]:
    """Learns vectors and the softmax layer; returns each bucket's part of the logit, and the bias."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    layer, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    table = WordHash()
    rows = [(*features(t, table, bits), y) for t, y in zip(texts, labels, strict=True)]
    share = np.bincount(labels, minlength=2) / max(1, len(labels)) if labels else np.zeros(2)
    weight = np.where(share > 0, 0.5 / np.maximum(share, 1e-9), 0) ** 0.5
    epochs = max(epochs, -(-LEAST_STEPS // max(1, len(rows))))
    step, steps = 0, max(1, epochs * len(rows))
    for _ in range(epochs):
        for k in rng.permutation(len(rows)).tolist():
            ids, x, y = rows[k]
            now = rate * (1 - step / steps) * weight[y]
            step += 1
            own = vectors[ids]
            mean = x @ own
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            grad = p @ layer
            layer -= now * np.outer(p, mean)
            bias -= now * p * 0.1
            # each vector moves by its own share of the document, scaled up so that rare n-grams learn too
            vectors[ids] = own - now * np.outer(np.minimum(1, x * 100), grad)
    return (vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0])


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    logit, bias, bits = model.value
    table = WordHash()
    for batch in batches:
        out = np.zeros(batch.num_rows)
        for k, text in enumerate(batch.column(1).to_pylist()):
            total, n = 0.0, 0
            for b in buckets(text or "", table, bits):
                total += float(logit[b].sum(dtype=np.float64))
                n += len(b)
            out[k] = bias + (total / n if n else 0.0)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(out, -50, 50))))], names=["doc_id", "score"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS, **options) -> tuple[np.ndarray, float]:
    """The model, learned from the labelled documents that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").where(~held_out(F.col("_id")))
    known = known.orderBy(F.xxhash64("_id"), "_id", "_y").limit(rows)  # rows without a document or with a long one are lost below
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text").between(1, chars))
    got = texts.join(F.broadcast(known), texts["doc_id"] == known["_id"]).select("doc_id", "text", "_y")
    # repeated documents may make more rows; which of them train doesn't depend on their order
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "_y").limit(rows).collect()
    got.sort(key=lambda r: (r["doc_id"], r["text"], r["_y"]))
    return train([r["text"] for r in got], [r["_y"] for r in got], **options)


def score(docs: DataFrame, model: tuple[np.ndarray, float], bits: int = BITS) -> DataFrame:
    """doc_id, score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast((*model, bits))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, lambda b: _score(b, shared), "doc_id long, score double")


def _keep(batches: Iterator[pa.RecordBatch], model, text: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _score([pa.RecordBatch.from_arrays([batch.column(text), batch.column(text)], names=["doc_id", "text"])], model):
            yield batch.filter(pa.array(np.asarray(part.column(1)) >= 0.5))


def keep_good(docs: DataFrame, model: tuple[np.ndarray, float], bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` whose score is 0.5 or more, with all their columns."""
    shared, at = docs.sparkSession.sparkContext.broadcast((*model, bits)), docs.columns.index("text")
    return map_batches(docs, lambda b: _keep(b, shared, at), docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    out = score(docs, fit(docs, load(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.expr("int(score >= 0.5)").alias("predicted"))
