"""Document fingerprints from closed syncmers, in DataFrame functions only.

Word anchors: of all runs of ``K`` words, those whose smallest hashed ``S``-word part lies at an edge. A text that yields fewer
than ``LEAST`` word anchors, or fewer than one in ``SPARSE`` code points (it is short, or has few spaces), also gets character
anchors, runs of ``CHAR_K`` characters chosen the same way by their ``CHAR_S``-character parts; a text with no run at all is
its own anchor. Whether a run is chosen depends on the run alone, so equal passages give equal anchors wherever they stand.

A fingerprint is the sorted set of all 32-bit anchors as hexadecimal words: first the kind (``c`` or ``w``: with character
anchors or without), then the anchors. The likeness of two is the share of common anchors in their union, over word
anchors alone if just one of the texts has character anchors. For positional matching, ``places`` has each occurrence of an
anchor with the number, from 0, of the word (even anchors) or the character (odd ones) at which its run begins.

Results for odd input: null and empty texts have the fingerprint ``c``; two without anchors have likeness 1, one without
and one with, 0; rows that repeat stand next to each other in the order (doc_id, hash of text) and are fingerprinted once
each; rows with a null doc_id come first in the order; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loglake.llm.common import load

K, S = 5, 2
LEAST, SPARSE = 40, 64
CHAR_K, CHAR_S = 10, 4
#: Characters of text in a bucket of ``with_next``, and the least and the greatest number of buckets: their limits are all that
#: the driver gathers, whatever the corpus' size, and a larger bucket is sorted with spills.
BUCKET_CHARS = 16_000_000
LEAST_BUCKETS = 64
MOST_BUCKETS = 8192


def _syncmers(parts: str, span: int, mark: int) -> str:
    """SQL: anchors of an array of hashed parts, each with its place, where a run is ``span`` parts in a row. Word anchors are
    even, others odd."""
    n = f"size({parts})"
    shifted = ", ".join(f"slice({parts}, {k + 1}, {n} - {span - 1})" for k in range(span))
    inner = ", ".join(f"z.`{k}`" for k in range(1, span - 1))
    inner = f"least({inner})" if span > 3 else inner
    chosen = f"filter(arrays_zip({shifted}, sequence(0, {n} - {span})), z -> least(z.`0`, z.`{span - 1}`) <= {inner})"
    run = ", ".join(f"z.`{k}`" for k in range(span))
    return f"CASE WHEN {n} >= {span} THEN transform({chosen}, z -> struct(z.`{span}` AS at, (xxhash64({run}) & 4294967294) | {mark} AS anchor)) ELSE array() END"


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: array<long>, the sorted set of a text column's anchors; ``out``_at: array<struct<at, anchor>>, each of their
    occurrences; and ``out``_c: whether it has character anchors."""
    words, parts, runs, chars, every = (f"_{out}{k}" for k in range(5))
    # a step each, so that no array is computed again for every element of another
    df = df.withColumn(words, F.expr(f"transform(filter(split({text}, '[\\\\s]+'), w -> w <> ''), w -> xxhash64(w))"))
    df = df.withColumn(parts, F.expr(f"CASE WHEN size({words}) >= {S} THEN transform(arrays_zip(slice({words}, 1, size({words}) - 1), slice({words}, 2, size({words}) - 1)), z -> xxhash64(z)) ELSE array() END"))
    df = df.withColumn(runs, F.expr(_syncmers(parts, K - S + 1, 0)))
    df = df.withColumn(f"{out}_c", F.expr(f"size({runs}) < {LEAST} OR size({runs}) * {SPARSE}L < length({text})"))
    df = df.withColumn(chars, F.expr(f"CASE WHEN {out}_c THEN transform(regexp_extract_all({text}, '(?s)(?=(.{{{CHAR_S}}}))', 1), c -> xxhash64(c)) ELSE array() END"))
    df = df.withColumn(every, F.concat(F.col(runs), F.expr(_syncmers(chars, CHAR_K - CHAR_S + 1, 1))))
    own = f"CASE WHEN length({text}) = 0 THEN array() ELSE array(struct(0 AS at, xxhash64({text}) & 4294967294 AS anchor)) END"
    df = df.withColumn(f"{out}_at", F.expr(f"CASE WHEN size({every}) > 0 THEN {every} ELSE {own} END"))
    df = df.withColumn(out, F.expr(f"sort_array(array_distinct({out}_at.anchor))"))
    return df.drop(words, parts, runs, chars, every)


def fingerprint(anchors: str) -> Column:
    return F.expr(f"concat(CASE WHEN {anchors}_c THEN 'c' ELSE 'w' END, array_join(transform({anchors}, x -> lower(lpad(hex(x), 8, '0'))), ''))")


def likeness(a: str, b: str) -> Column:
    """Likeness of two sets of anchors."""
    own = lambda x: f"CASE WHEN {a}_c = {b}_c THEN {x} ELSE filter({x}, y -> y % 2 = 0) END"
    x, y = own(a), own(b)
    return F.expr(f"CASE WHEN size({x}) = 0 AND size({y}) = 0 THEN 1D WHEN size({x}) = 0 OR size({y}) = 0 THEN 0D ELSE size(array_intersect({x}, {y})) / cast(size(array_union({x}, {y})) AS double) END")


def with_next(docs: DataFrame, bucket_chars: int = BUCKET_CHARS, least_buckets: int = LEAST_BUCKETS) -> DataFrame:
    """Adds ``next``: the text of the following row of ``docs`` (doc_id, text) in the order (doc_id, hash of text); the last row's
    is the first row's. Texts move once: to the bucket of their range of ids, and the first rows of a bucket also to the one
    before it. Only the ranges' limits, some thousands of ids, are gathered."""
    seen = docs.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.min("doc_id").alias("lo"), F.count("doc_id").alias("known")).first()
    count = min(MOST_BUCKETS, max(least_buckets, (seen["chars"] or 0) // bucket_chars))
    shares = ", ".join(f"{k / count:.8f}D" for k in range(1, count))
    limits = docs.agg(F.expr(f"percentile_approx(doc_id, array({shares}), {20 * count})")).first()[0] or []
    limits = sorted({x for x in limits if x > seen["lo"]})
    step = max(1, math.isqrt(len(limits)))
    groups = [limits[k : k + step] for k in range(0, len(limits), step)]
    longs = lambda xs: f"array({', '.join(f'{x}L' for x in xs)})"
    if groups:
        group = F.expr(f"size(filter({longs(g[0] for g in groups)}, x -> x <= doc_id))")
        near = f"element_at(array({', '.join(map(longs, groups))}), greatest(1, _group))"
        docs = docs.withColumn("_group", group).withColumn("_near", F.expr(near))
        docs = docs.withColumn("_bucket", F.expr(f"CASE WHEN _group = 0 THEN 0 ELSE (_group - 1) * {step} + size(filter(_near, x -> x <= doc_id)) END"))
        docs = docs.withColumn("_opens", F.expr("coalesce(array_contains(_near, doc_id), false)"))
    else:
        docs = docs.withColumn("_bucket", F.lit(0)).withColumn("_opens", F.lit(False))
    # null ids come first of all; so the row after the last one is one of theirs, if there are any
    opening = "doc_id is null" if seen["known"] < seen["n"] else f"doc_id = {seen['lo']}L" if seen["n"] else "false"
    places = F.expr(f"""concat(array(struct(_bucket AS b, 0 AS guest)),
        CASE WHEN _opens THEN array(struct(_bucket - 1 AS b, 1 AS guest)) ELSE array() END,
        CASE WHEN {opening} THEN array(struct({len(limits)} AS b, 2 AS guest)) ELSE array() END)""")
    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("_th"), F.explode(places).alias("_place"))
    order = Window.partitionBy("_place.b").orderBy("_place.guest", F.col("doc_id").asc_nulls_first(), "_th")
    return dealt.withColumn("next", F.lead("text").over(order)).where("_place.guest = 0").select("doc_id", "text", "next")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, anchors, anchors_c, fingerprint, places of each row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return with_anchors(rows, "text", "anchors").select("doc_id", F.length("text").cast("long").alias("n_chars"), "anchors", "anchors_c", fingerprint("anchors").alias("fingerprint"), F.col("anchors_at").alias("places"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    both = with_next(rows).withColumn("n_chars", F.length("text").cast("long"))
    both = both.withColumn("edited", F.expr("concat(left(text, cast(n_chars - n_chars div 2 AS int)), left(next, cast(n_chars div 2 AS int)))"))
    for text, name in (("text", "a"), ("edited", "e"), ("next", "n")):
        both = with_anchors(both, text, name)
    return both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("a").alias("fingerprint"), fingerprint("e").alias("edited_fingerprint"), likeness("a", "e").alias("near_edited"), likeness("a", "n").alias("near_next"), F.col("a_at").alias("places"))
