"""MinHash near-dedup with circulant permutations, banding and exact Jaccard verification.

A document's set is its distinct ``SHINGLE``-word shingles (words between ASCII white space, A-Z lower-cased; a shorter
document's whole sequence is its one shingle). Two permutations make all signature coordinates: the first spreads
shingles over ``UNIVERSE`` places; the second, shifted circularly by k, gives coordinate k, so a shingle's values for all
coordinates are one contiguous slice of the second. Bands of some coordinates each make buckets (``BANDING``).

Documents with equal sets are one class from the start, whatever their number. Candidates are pairs of classes that share a
band's bucket, and they are confirmed on their full sets:

* ``STARS`` times, each bucket draws a pivot and its other members are compared with it; links merge components. This
  joins a group of near copies at a cost of one pair per member and bucket.
* Then only buckets that still hold several components go on. Their members meet in blocks of about ``BLOCK``; of pairs
  that are in different components, each is looked at in the first bucket it shares, and goes to verification if
  ``SKETCH`` one-bit coordinates (a longer slice of the same second permutation) don't rule it out. They rule out a
  pair of just the least similarity with a probability of 1e-6, as bands do.

So every pair that shares a band is linked already, or compared, or ruled out by its sketches; no bucket's pairs are
emitted, and no partner is dropped for its bucket's size. A bucket in which m members stay in different components costs
m * m / 2 sketch comparisons of 512 bytes, spread over tasks by blocks; that is the price of losing no link. Full sets
go to a task once per pair, a pivot's once per ``HUB`` of its pairs.

Results for odd input: null and empty texts, and white space, have no shingle, are linked with nothing and kept; ties between equal texts go to the smallest doc_id; rows with
the same doc_id and text are one document; with the same doc_id but other texts, the document's texts are linked;
a null ``doc_id`` is linked with nothing, has a null component and is kept; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.llm.common import Scratch, WordHash, hash_words, load, map_batches, mix

SHINGLE = 5
PERCENT = 80
#: Bands and rows by the least similarity in percent: a pair just that similar shares no band with a probability of 1e-6, and one
#: that merely holds the same passage hardly ever shares one.
BANDING = {85: (64, 10), 80: (76, 8), 0: (128, 4)}
UNIVERSE = 1 << 18
#: Rounds of pivots before blocks; members of a bucket that are compared at once; coordinates of a sketch.
STARS = 2
BLOCK = 1024
SKETCH = 4096
#: Pairs of one pivot that go to a task together.
HUB = 2000
#: Ids that are broadcast at most (some 40 bytes each) to pick their texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(text: str | None, n: int, table: WordHash) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles."""
    w = hash_words((text or "").encode("utf-8", "surrogatepass").lower().split(), table)
    if not len(w):
        return w
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h *= _A
        h += w[i : i + len(h)]
        h ^= h >> np.uint64(29)
    return np.unique(mix(h))


class Circulant:
    """The two permutations: of shingle places (a bijection of 64 bits, then the top bits) and of the universe."""

    def __init__(self, coordinates: int, universe: int = UNIVERSE, seed: int = 7):
        second = np.random.default_rng(seed).permutation(universe).astype(np.uint32)
        self.slices = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[:coordinates]]), coordinates)
        self.shift = np.uint64(64 - universe.bit_length() + 1)

    def signature(self, sorted_hashes: np.ndarray) -> np.ndarray:
        place = np.unique((sorted_hashes * _B) >> self.shift).astype(np.int64)
        out = self.slices[place[0]].copy()
        for k in range(0, len(place), 256):
            np.minimum(out, self.slices[place[k : k + 256]].min(0), out=out)
        return out


def bands_of(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    s = signature[: bands * rows].reshape(bands, rows).astype(np.uint64)
    h = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        h = mix(h * _A + s[:, k])
    return h.view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch], n: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    table, perm = WordHash(), Circulant(bands * rows)
    for batch in batches:
        sizes, digests, got = [], [], []
        for text in batch.column(1).to_pylist():
            s = shingles(text, n, table)
            sizes.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            got.append(bands_of(perm.signature(s), bands, rows) if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(got, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Rows id, digest, text: the text's set, as bytes, if it is the one with that digest."""
    table = WordHash()
    for batch in batches:
        got = [shingles(t, n, table).tobytes() for t in batch.column(2).to_pylist()]
        own = pa.array([xxhash.xxh3_128_digest(s) == d for s, d in zip(got, batch.column(1).to_pylist(), strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], names=["id", "set"]).filter(own)


def _sketches(batches: Iterator[pa.RecordBatch], bands: int, rows: int, bits: int) -> Iterator[pa.RecordBatch]:
    """One bit of each of ``bits`` coordinates, and 32 bits of each band."""
    perm = Circulant(max(bits, bands * rows))
    for batch in batches:
        sketch, own = [], []
        for s in batch.column(1).to_pylist():
            sig = perm.signature(np.frombuffer(s, np.uint64))
            sketch.append(np.packbits((sig[:bits] & 1).astype(bool)).tobytes())
            own.append((bands_of(sig, bands, rows).view(np.uint64) >> np.uint64(32)).astype(np.uint32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sketch, pa.binary()), pa.array(own, pa.binary())], names=["id", "sketch", "bands"])


def _meet(batches: Iterator[pa.RecordBatch], percent: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Candidates of each block pair. Rows: bucket, lo, hi, block, id, n, comp, sketch, bands; those of a block pair stand together."""
    t = percent / 100
    # least similarity that a sketch may show: 4.75 deviations below what is asked for
    most = bits * (1 - (t - 4.75 * 2 * math.sqrt((1 + t) / 2 * (1 - t) / 2 / bits))) / 2
    key, held = None, []

    def done() -> pa.RecordBatch | None:
        if len(held) < 2:
            return None
        bucket, lo, hi, block, ids, n, comp, sketch, own = zip(*held, strict=True)
        block, ids, n, comp = (np.array(x, np.int64) for x in (block, ids, n, comp))
        sketch = np.frombuffer(b"".join(sketch), np.uint8).reshape(len(ids), -1).view(np.uint64)
        own = np.frombuffer(b"".join(own), np.uint32).reshape(len(ids), -1)
        band = int((own[0] == (bucket[0] >> 32) & 0xFFFFFFFF).argmax())  # whose bucket this is
        a, b = [], []
        for i in np.flatnonzero(block == lo[0]):
            others = np.flatnonzero((block == hi[0]) & (comp != comp[i]) & ((ids > ids[i]) | (lo[0] != hi[0])) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
            others = others[(own[others] == own[i]).argmax(1) == band]
            others = others[np.bitwise_count(sketch[others] ^ sketch[i]).sum(1, dtype=np.int64) <= most]
            a.append(np.full(len(others), ids[i]))
            b.append(ids[others])
        a, b = np.concatenate(a or [np.zeros(0, np.int64)]), np.concatenate(b or [np.zeros(0, np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["p", "x"])

    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (r[0], r[1], r[2]) != key:
                if (out := done()) is not None and len(out):
                    yield out
                key, held = (r[0], r[1], r[2]), []
            held.append(r)
    if (out := done()) is not None and len(out):
        yield out


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows p, part, x, set; those of (p, part) stand together, the pivot's own (x is null) first."""
    own = None
    for batch in batches:
        a, b = [], []
        for p, x, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            s = np.frombuffer(s.as_buffer(), np.uint64)
            if x is None:
                own = s.copy()
                continue
            both = len(np.intersect1d(own, s, assume_unique=True))
            if 100 * both >= percent * (len(own) + len(s) - both):
                a.append(p)
                b.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _links(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Of ``pairs`` (p, x), those whose sets are that similar, written. Sets move once per pair, a pivot's own once per ``HUB`` pairs."""
    hubs = pairs.groupBy("p").agg(F.count("*").alias("_n")).where(f"_n > {HUB}").select("p", F.expr(f"_n div {HUB} + 1").alias("_parts"))
    # written: the planner sees how few they are
    dealt = scratch.write(pairs.join(hubs, "p", "left").select("p", "x", F.expr("pmod(xxhash64(x), coalesce(_parts, 1))").alias("part")), "dealt")
    members = dealt.join(sets.withColumnRenamed("id", "x"), "x").select("p", "part", "x", "set")
    own = dealt.select("p", "part").distinct().join(sets.withColumnRenamed("id", "p"), "p").select("p", "part", F.lit(None).cast("long").alias("x"), "set")
    together = members.union(own).repartition("p", "part").sortWithinPartitions("p", "part", F.col("x").asc_nulls_first())
    out = scratch.write(map_batches(together, lambda b: _verify(b, percent), "a long, b long"), "links")
    scratch.drop(dealt)
    return out


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Each vertex of ``edges`` (a, b) and the smallest vertex it is connected with: (id, comp)."""
    both = scratch.write(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    labels = scratch.write(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp"), F.lit(True).alias("moved")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("comp").alias("near"))
        now = labels.join(near, labels["id"] == near["a"]).select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("id").alias("_id"), F.col("comp").alias("_up"))
        now = now.join(up, F.col("comp") == F.col("_id"), "left").select("id", F.least("comp", "_up").alias("comp"), (F.least("comp", "_up") < F.col("old")).alias("moved"))
        nxt = scratch.write(now, "labels")
        scratch.drop(labels)
        labels = nxt
        if labels.where("moved").isEmpty():
            scratch.drop(both)
            return labels.select("id", "comp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, banding: tuple[int, int] | None = None, block: int = BLOCK, stars: int = STARS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of ``docs`` (doc_id, text)."""
    bands, rows = banding or next(v for k, v in BANDING.items() if percent >= k)
    scratch = Scratch(docs.sparkSession, "near")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = scratch.write(map_batches(texts, lambda b: _signatures(b, shingle, bands, rows), "doc_id long, n_shingles long, digest binary, bands array<long>"), "signatures")
    known = every.where("digest is not null and doc_id is not null")
    # classes of equal sets; numbered, and written, so that the numbers hold for whoever reads them
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = scratch.write(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    flat = classes.select("id", F.explode("bands").alias("bucket"))
    # a table joined with a table: only then does adaptive execution split a bucket that many classes share
    shared = scratch.write(flat.groupBy("bucket").agg(F.count("*").alias("_n")).where("_n > 1").select("bucket"), "shared")
    members = scratch.write(flat.join(shared, "bucket").select("id", "bucket"), "members")
    scratch.drop(shared)
    comps = scratch.write(members.select("id").distinct().join(classes.select("id", "n"), "id").select("id", "n", F.col("id").alias("comp")), "comps")
    # documents that are given more than once, with the same text or another
    several = scratch.write(known.groupBy("doc_id").agg(F.count("*").alias("_n"), F.min("digest").alias("_lo"), F.max("digest").alias("_hi")).where("_n > 1"), "several")
    repeated = not several.isEmpty()
    sets = _involved_sets(texts, classes, comps, shingle, repeated, scratch)

    def merged(edges: DataFrame) -> DataFrame:
        side = lambda c: comps.select(F.col("id").alias(c), F.col("comp").alias(f"c{c}"))
        between = edges.join(side("a"), "a").join(side("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b").distinct()
        new = components(between, scratch)
        out = comps.join(new.select(F.col("id").alias("_c"), F.col("comp").alias("_new")), F.col("comp") == F.col("_c"), "left").select("id", "n", F.coalesce("_new", "comp").alias("comp"))
        out = scratch.write(out, "comps")
        scratch.drop(comps, new)
        return out

    for turn in range(stars):
        now = members.join(comps, "id")
        pivots = now.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("draw"), F.col("id").alias("p"), F.col("n").alias("pn"), F.col("comp").alias("pc"))).alias("_p"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi"))
        pivots = scratch.write(pivots.where("_lo < _hi").select("bucket", "_p.p", "_p.pn", "_p.pc"), "pivots")
        # sets whose sizes are too far apart can't be that similar
        pairs = now.join(pivots, "bucket").where(f"comp <> pc AND 100 * least(n, pn) >= {percent} * greatest(n, pn)").select("p", F.col("id").alias("x")).distinct()
        pairs = scratch.write(pairs, "pairs")
        links = _links(pairs, sets, percent, scratch)
        scratch.drop(pairs, pivots)
        if not links.isEmpty():
            comps = merged(links)
        scratch.drop(links)
    now = members.join(comps, "id")
    mixed = now.groupBy("bucket").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.count("*").alias("_m")).where("_lo < _hi")
    mixed = scratch.write(mixed.select("bucket", F.expr(f"(_m + {block - 1}) div {block}").alias("blocks")), "mixed")
    left = scratch.write(now.join(mixed, "bucket").select("bucket", "blocks", "id", "n", "comp"), "left")
    scratch.drop(mixed, members)
    if not left.isEmpty():
        ids = scratch.write(left.select("id").distinct(), "ids")
        sketches = sets.join(ids, "id", "left_semi").select("id", "set")
        sketches = scratch.write(map_batches(sketches, lambda b: _sketches(b, bands, rows, SKETCH), "id long, sketch binary, bands binary"), "sketches")
        dealt = left.withColumn("block", F.expr("pmod(xxhash64(id, bucket), blocks)")).withColumn("_o", F.explode(F.expr("sequence(0L, blocks - 1)")))
        dealt = dealt.select("bucket", F.least("block", "_o").alias("lo"), F.greatest("block", "_o").alias("hi"), "block", "id", "n", "comp").join(sketches, "id")
        dealt = dealt.select("bucket", "lo", "hi", "block", "id", "n", "comp", "sketch", "bands").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
        pairs = scratch.write(map_batches(dealt, lambda b: _meet(b, percent, SKETCH), "p long, x long"), "pairs")
        scratch.drop(sketches, ids)
        links = _links(pairs, sets, percent, scratch)
        if not links.isEmpty():
            comps = merged(links)
        scratch.drop(pairs, links)
    scratch.drop(left, sets)
    # a document's several texts belong together
    if repeated:
        texts_of = known.join(several.where("_lo < _hi").select("doc_id"), "doc_id").select("doc_id", "digest").distinct()
        own = scratch.write(texts_of.join(classes.select("digest", "id"), "digest").select("doc_id", "id"), "own")
        if not own.isEmpty():
            comps = scratch.write(classes.select("id", "n").join(comps.select("id", "comp"), "id", "left").select("id", "n", F.coalesce("comp", "id").alias("comp")), "comps")
            comps = merged(own.join(own.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").select("a", F.col("id").alias("b")).where("a <> b"))
        scratch.drop(own)
    found = comps.join(classes.select("id", "doc", "digest"), "id")
    least = found.groupBy("comp").agg(F.min("doc").alias("_least"))
    names = scratch.write(found.join(least, "comp").select("id", "_least"), "names")
    names = scratch.write(classes.select("id", "digest", "doc").join(names, "id", "left").select(F.col("digest").alias("_digest"), F.coalesce("_least", "doc").alias("_comp")), "names")
    out = every.select("doc_id", "n_shingles", "digest").join(names, F.col("digest") == F.col("_digest"), "left")
    scratch.drop(classes, several, comps)
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("_comp", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _involved_sets(texts: DataFrame, classes: DataFrame, comps: DataFrame, shingle: int, repeated: bool, scratch: Scratch) -> DataFrame:
    """id, set of the classes in ``comps``, from the text of one document each."""
    some = scratch.write(classes.select("id", F.col("doc").alias("_doc"), "digest").join(comps.select("id"), "id"), "some")
    few = some.count() <= BROADCAST_IDS
    got = texts.join(F.broadcast(some) if few else some, F.col("doc_id") == F.col("_doc")).select("id", "digest", "text")
    got = map_batches(got, lambda b: _sets(b, shingle), "id long, set binary")
    out = scratch.write(got.dropDuplicates(["id"]) if repeated else got, "sets")
    scratch.drop(some)
    return out


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row of each group of near duplicates, with all its columns: that of the smallest doc_id (of rows that repeat it,
    the first text). Rows with a null doc_id stay."""
    found = near_duplicates(docs, **options)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    out = docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
    twice = found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if twice.isEmpty():
        return out
    known, unknown = out.where(F.col("doc_id").isNotNull()), out.where(F.col("doc_id").isNull())
    return known.dropDuplicates(["doc_id"]).unionByName(unknown)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"), shingle=3, percent=85)
