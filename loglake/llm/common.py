"""Shared pieces of the training-data operators: scratch tables, Arrow batch plumbing, word hashing.

Conventions that every operator of this subpackage follows:

* null text is the empty text;
* rows with a null ``doc_id`` keep their row in the result, but take no part in links between documents;
* two rows with the same ``doc_id`` and text are one document given twice: both get that document's result;
* extra columns are never read, so their names and types can't clash.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes in an Arrow batch handed to a Python worker; they bound a worker's memory.
ARROW_ROWS = 1000
ARROW_BYTES = 16 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def arrow_bounds(spark: SparkSession) -> None:
    """Keeps Arrow batches small enough for workers that hold a few batches of long texts. Spark reads these settings when a plan
    runs, so they are the session's; smaller ones of the caller's stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(key, None)
        if not (now or "").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only a session on one machine (master local) that has
    none gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        got = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
        path = got or _own_dir(spark)
    return path.rstrip("/")


_OWN: dict[str, str] = {}


def _own_dir(spark: SparkSession) -> str:
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        _OWN[key] = "file://" + tempfile.mkdtemp(prefix="loglake-")
        spark.sparkContext.setCheckpointDir(_OWN[key])
        atexit.register(_remove_local, _OWN[key])
    return _OWN[key]


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


class Scratch:
    """Tables written once to the shared folder, so that a lost executor costs no recomputation of what came before.

    ``write`` returns the table reread. ``drop`` deletes what is no longer needed; what is still there when the
    session ends goes then (a result that is read lazily may depend on it until then).
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self._delete, self.root)

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{tag}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(getattr(t, "_scratch_path", None))

    def _delete(self, path: str | None) -> None:
        if not path:
            return
        try:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit; the folder is the cluster's to clean then
            pass


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    arrow_bounds(df.sparkSession)
    return df.mapInArrow(fn, schema)


def slices(batch: pa.RecordBatch, text: int, rows: int = 200, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``rows`` rows and ``most`` bytes of the text column numbered ``text`` (a longer text is alone)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).tolist()
    lo = held = 0
    for k, n in enumerate(sizes):
        if k > lo and (k - lo == rows or held + n > most):
            yield batch.slice(lo, k - lo)
            lo, held = k, 0
        held += n
    if lo < len(sizes):
        yield batch.slice(lo)


class WordHash(dict):
    """word (bytes or str) -> int64; bounded, so that a worker's memory doesn't grow with the corpus."""

    def __init__(self, norm: Callable | None = None, most: int = 400_000):
        super().__init__()
        self.norm, self.most = norm, most

    def __missing__(self, word):
        w = self.norm(word) if self.norm else word
        v = xxhash.xxh3_64_intdigest(w) if w else 0
        v = v - (1 << 64) if v >= 1 << 63 else v
        if len(self) < self.most:
            self[word] = v
        return v


def hash_words(words: list, table: WordHash) -> np.ndarray:
    return np.fromiter(map(table.__getitem__, words), np.int64, len(words)).view(np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits (in place where it can be)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the tokenizers installed on every machine; LOGLAKE_TOKENIZERS names another folder."""
    own = os.environ.get("LOGLAKE_TOKENIZERS")
    if own:
        return os.path.join(own, name)
    import public_tokenizers

    return public_tokenizers.path(name)
