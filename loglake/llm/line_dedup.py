"""Line dedup by a suffix array over line-ID sequences, in DataFrame functions only.

Lines become IDs by hash; lines that occur once can't be in a repeated run and break the sequences. The suffixes of
what is left are sorted by distributed prefix doubling: a suffix's rank among the first 2k lines is the order of the pair
(its rank among the first k, the rank of the suffix k lines on). Ranks come from a range-partitioned sort of the
distinct pairs, so a line that fills a third of the corpus is one row there; pairs that occur once leave at once.
Suffixes that agree in their first m lines form an interval of common prefix in the suffix array. For the m that matter at a
place (the fewest lines from there on, and the fewest up to there, that have ``WORDS`` words), that interval is named by two
ranks: that of the first 2^j <= m lines, and that of the last 2^j of the m. In each such interval the suffix at the smallest
(doc_id, line) is kept, and the m lines of every other are deleted. A longer repeat is covered by such blocks, forward ones
from each of its lines and a backward one from its last. So this deletes every later copy of each maximal repeated run of at
least ``WORDS`` words, and nothing else.

A line's words stand between ASCII white space, a carriage return at its end included.

Results for odd input: null text stays null, empty text stays empty; blank lines are kept and don't break or extend a run; a
run within one document may overlap itself (its first copy stays); rows with the same doc_id and text are one document and
get the same result; rows with a null doc_id come first of all; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loglake.llm.common import Scratch, load

WORDS = 20


def _ranked(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) that occur more than once, and their rank in order."""
    several = pairs.groupBy("a", "b").agg(F.count("*").alias("_n")).where("_n > 1").select("a", "b")
    # ids that rise over range partitions and rows are ranks; written, so that they hold for whoever reads them
    return scratch.write(several.orderBy("a", "b").withColumn("rank", F.monotonically_increasing_id()), "ranks")


def repeated_runs(docs: DataFrame, words: int = WORDS, scratch: Scratch | None = None) -> DataFrame:
    """Later copies: doc_id, th (hash of the text), line (its number, blank lines included), of every line to delete."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the place counts lines that aren't blank
    numbered = F.expr("filter(transform(split(text, '\n'), (l, i) -> struct(i AS line, l AS l)), x -> x.l RLIKE '[^\\\\s]')")
    lines = rows.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(numbered).alias("pos", "x"))
    lines = lines.select("doc_id", "th", "pos", "x.line", F.xxhash64("x.l").alias("a"), F.xxhash64(F.lit("second"), F.col("x.l")).alias("b"), F.regexp_count("x.l", F.lit("[^\\s]+")).alias("w"))
    lines = scratch.write(lines, "lines")
    first = _ranked(lines.select("a", "b"), scratch)
    # ids of repeated lines only, the ranks that doubling begins with
    base = scratch.write(lines.join(first, ["a", "b"]).select("doc_id", "th", "line", "pos", "w", "rank").distinct(), "repeated")
    scratch.drop(lines, first)
    # the fewest lines from here on, and up to here, all repeated and next to each other, with enough words; no more than that many are looked at
    beside = Window.partitionBy("doc_id", "th", "island").orderBy("pos")
    island = F.col("pos") - F.row_number().over(Window.partitionBy("doc_id", "th").orderBy("pos"))
    reach = base.withColumn("island", island).withColumn("_on", F.collect_list("w").over(beside.rowsBetween(0, words - 1)))
    reach = reach.withColumn("_back", F.reverse(F.collect_list("w").over(beside.rowsBetween(1 - words, 0))))
    enough = lambda ws: f"aggregate({ws}, struct(0 AS t, 0 AS m), (s, x) -> CASE WHEN s.t >= {words} THEN s ELSE struct(s.t + x AS t, s.m + 1 AS m) END, s -> CASE WHEN s.t >= {words} THEN s.m END)"
    blocks = F.expr(f"filter(array(struct(pos AS pos, {enough('_on')} AS m), struct(pos + 1 - {enough('_back')} AS pos, {enough('_back')} AS m)), x -> x.m is not null)")
    runs = reach.select("doc_id", "th", F.explode(F.array_distinct(blocks)).alias("_x")).select("doc_id", "th", "_x.pos", "_x.m").distinct()
    runs = scratch.write(runs, "runs")
    longest = runs.agg(F.max("m")).first()[0]
    if longest is None:
        return base.select("doc_id", "th", "line").where("false")
    level, ranks, found, levels = 0, base.select("doc_id", "th", "pos", "rank"), None, []
    while True:
        step = 1 << level
        own = runs.where(f"m >= {step} and m < {2 * step}")
        tail = ranks.select("doc_id", "th", F.col("pos").alias("_p"), F.col("rank").alias("tail"))
        key = ranks.withColumnsRenamed({"doc_id": "_d", "th": "_t", "pos": "_q", "rank": "head"})
        same = lambda x, y: x["doc_id"].eqNullSafe(y) & (F.col("th") == F.col("_t"))
        named = own.join(key, same(own, key["_d"]) & (F.col("pos") == F.col("_q"))).drop("_d", "_t", "_q")
        tail = tail.withColumnsRenamed({"doc_id": "_d", "th": "_t"})
        named = named.join(tail, same(named, tail["_d"]) & (F.col("pos") + F.col("m") - step == F.col("_p"))).select("doc_id", "th", "pos", "m", "head", "tail")
        named = scratch.write(named, "intervals")
        levels.append(named)
        found = named if found is None else found.union(named)
        if 2 * step > longest:
            scratch.drop(ranks)
            break
        later = ranks.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), F.col("pos").alias("_p"), F.col("rank").alias("b"))
        pairs = ranks.withColumnRenamed("rank", "a").join(later, same(ranks, later["_d"]) & (F.col("pos") + step == F.col("_p"))).select("doc_id", "th", "pos", "a", "b")
        pairs = scratch.write(pairs, "pairs")
        scratch.drop(ranks)
        order = _ranked(pairs.select("a", "b"), scratch)
        ranks = scratch.write(pairs.join(order, ["a", "b"]).select("doc_id", "th", "pos", "rank"), "suffixes")
        scratch.drop(pairs, order)
        level += 1
    place = F.struct("doc_id", "th", "pos")
    first = found.groupBy("m", "head", "tail").agg(F.min(place).alias("first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    first = scratch.write(first, "first")
    copies = found.join(first, ["m", "head", "tail"]).where(place != F.col("first"))
    covered = copies.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), F.explode(F.expr("sequence(pos, pos + m - 1)")).alias("_p")).distinct()
    gone = base.join(covered, base["doc_id"].eqNullSafe(covered["_d"]) & (base["th"] == covered["_t"]) & (base["pos"] == covered["_p"])).select("doc_id", "th", "line")
    out = scratch.write(gone, "gone")
    scratch.drop(base, runs, first, *levels)
    return out


def dedup_lines(docs: DataFrame, words: int = WORDS, count: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text and other columns) without the later copies of repeated line runs in text; ``count`` names a
    column for the number of lines that went."""
    gone = repeated_runs(docs, words).groupBy("doc_id", "th").agg(F.collect_set("line").alias("gone"))
    gone = gone.select(F.col("doc_id").alias("_line_dedup_doc"), F.col("th").alias("_line_dedup_th"), F.col("gone").alias("_line_dedup_gone"))
    on = docs["doc_id"].cast("long").eqNullSafe(gone["_line_dedup_doc"]) & (F.xxhash64(docs["text"].cast("string")) == gone["_line_dedup_th"])
    out, cut = docs.join(gone, on, "left"), gone["_line_dedup_gone"]
    lines = F.split(docs["text"], "\n")
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), cut)
    text = F.when(cut.isNull(), docs["text"]).otherwise(F.array_join(F.transform(keep, lambda i: F.element_at(lines, i + 1)), "\n"))
    columns = [text.alias("text") if c == "text" else docs[c] for c in docs.columns]
    return out.select(*columns, *([F.coalesce(F.size(cut), F.lit(0)).alias(count)] if count else []))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"), count="n_deleted")
