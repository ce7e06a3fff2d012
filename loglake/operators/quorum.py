"""What a replicated log's members agree on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglake.model import PLACE


def commit_index(replicas: DataFrame) -> DataFrame:
    """The greatest index that a majority of voters has (match_index), if its entry is of the current term; learners don't vote.

    Columns entry_term and current_term are optional; so is known_commit, the index so far, which never falls.
    """
    checked = {"entry_term", "current_term"} <= set(replicas.columns)
    item = F.struct("match_index", *(["entry_term", "current_term"] if checked else []))
    known = "known_commit" in replicas.columns
    kept = [F.max("known_commit").alias("_known")] if known else []
    out = replicas.where("is_voter").groupBy(*PLACE).agg(F.sort_array(F.collect_list(item), asc=False).alias("_m"), *kept)
    out = out.withColumn("_q", F.expr("_m[size(_m) div 2]"))
    index = F.col("_q.match_index")
    index = F.when(F.col("_q.entry_term") == F.col("_q.current_term"), index) if checked else index
    return out.select(*PLACE, (F.greatest(index, "_known") if known else index).cast("long").alias("commit_index"))


def follower_lag(replicas: DataFrame) -> DataFrame:
    """How far each replica is behind the most advanced one of its partition."""
    last = replicas.groupBy(*PLACE).agg(F.max("match_index").alias("last_index"))
    return replicas.join(last, PLACE).withColumn("lag", F.greatest(F.col("last_index") - F.col("match_index"), F.lit(0)).cast("long"))


def high_watermark(commits: DataFrame, entries: DataFrame, starts: DataFrame) -> DataFrame:
    """Offset up to which records are committed: last_offset + 1 of the entry at commit_index, or the log's start."""
    out = commits.join(entries.select(*PLACE, F.col("index").alias("commit_index"), "last_offset"), [*PLACE, "commit_index"], "left").join(starts, PLACE)
    return out.select(*PLACE, "commit_index", F.coalesce(F.col("last_offset") + 1, F.col("log_start")).cast("long").alias("high_watermark"))


def commit_latency(proposed: DataFrame, commits: DataFrame) -> DataFrame:
    """Time from a proposal (index, at) to the first commit (commit_index, at) that covers it: a ceiling as-of over one union.

    Commit indexes never fall, so the first commit that covers an index is the one with the smallest index at or above it.
    """
    first = commits.groupBy(*PLACE, "commit_index").agg(F.min("at").alias("at"))
    both = proposed.select(*PLACE, "index", F.lit(0).alias("_side"), F.col("at").alias("proposed_at"), F.lit(None).cast("long").alias("_c")).unionByName(
        first.select(*PLACE, F.col("commit_index").alias("index"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("proposed_at"), F.col("at").cast("long").alias("_c"))
    )
    # running the other way keeps the frame growing, which one pass computes
    back = Window.partitionBy(*PLACE).orderBy(F.col("index").desc(), F.col("_side").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("committed_at", F.last("_c", ignorenulls=True).over(back)).where("_side = 0 and committed_at is not null")
    return out.select(*PLACE, "index", "proposed_at", "committed_at", (F.col("committed_at") - F.col("proposed_at")).alias("latency"))


def conflict(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """First index of each partition at which the incoming entry's term differs from the local one's; null if none does."""
    both = incoming.select(*PLACE, "index", F.col("term").alias("_new")).join(local.select(*PLACE, "index", "term"), [*PLACE, "index"], "left")
    return both.groupBy(*PLACE).agg(F.min(F.when(F.col("term") != F.col("_new"), F.col("index"))).alias("conflict_index"))


def may_vote(candidates: DataFrame) -> DataFrame:
    """Whether a candidate's log (last_term, last_index) is as new as the voter's (own_term, own_index)."""
    return candidates.withColumn("granted", F.expr("last_term > own_term OR (last_term = own_term AND last_index >= own_index)"))


def backlog(state: DataFrame) -> DataFrame:
    """Entries (last_index, commit_index) that aren't committed yet."""
    return state.withColumn("uncommitted", F.greatest(F.col("last_index") - F.col("commit_index"), F.lit(0)).cast("long"))


def compact_entries(entries: DataFrame, state: DataFrame, threshold: int) -> DataFrame:
    """Entries (index, term) after the snapshot; it moves up to the commit index where that is ``threshold`` or more ahead (0: never)."""
    ahead = (F.col("commit_index") > F.col("snapshot_index")) & (F.col("commit_index") - F.col("snapshot_index") >= threshold)
    upto = F.when(ahead, F.col("commit_index")).otherwise(F.col("snapshot_index")) if threshold else F.col("snapshot_index")
    return entries.join(state.select(*PLACE, upto.alias("_upto")), PLACE).where(F.col("index") > F.col("_upto")).drop("_upto")


def append_entries(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """The log after incoming entries (index, term): from the first that is new or of another term on, it is theirs."""
    both = incoming.join(local.select(*PLACE, "index", F.col("term").alias("_own")), [*PLACE, "index"], "left")
    cut = both.where(F.col("_own").isNull() | (F.col("_own") != F.col("term"))).groupBy(*PLACE).agg(F.min("index").alias("_cut"))
    kept = local.join(cut, PLACE, "left").where(F.col("_cut").isNull() | (F.col("index") < F.col("_cut"))).select(*PLACE, "index", "term")
    new = incoming.join(cut, PLACE).where(F.col("index") >= F.col("_cut")).select(*PLACE, "index", "term")
    return kept.unionByName(new)
