"""Transactions: ranges, last stable offset, aborted lists, read-committed visibility, coordinator decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglake.model import PLACE

_OWNER = [*PLACE, "producer_id"]


def transactions(log: DataFrame) -> DataFrame:
    """A row per transaction: first_offset (its first data record), marker_offset and decision (null while open).

    A record's transaction number counts its producer's markers before it. Markers with nothing open make no row.
    """
    before = Window.partitionBy(*_OWNER).orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    numbered = log.withColumn("txn_no", F.coalesce(F.sum(F.col("is_control").cast("long")).over(before), F.lit(0)))
    t = numbered.groupBy(*_OWNER, "txn_no").agg(
        F.min(F.when(~F.col("is_control"), F.col("offset"))).alias("first_offset"), F.max(F.when(F.col("is_control"), F.col("offset"))).alias("marker_offset"), F.max(F.when(F.col("is_control"), F.col("decision"))).alias("decision")
    )
    return t.where("first_offset is not null")


def last_stable_offset(txns: DataFrame, marks: DataFrame) -> DataFrame:
    """The high-watermark, or the first offset of the earliest open transaction below it."""
    opened = txns.where("marker_offset is null").groupBy(*PLACE).agg(F.min("first_offset").alias("_open"))
    return marks.join(opened, PLACE, "left").select(*PLACE, "high_watermark", F.least("high_watermark", "_open").alias("lso"))


def aborted(txns: DataFrame, fetch_offset: int = 0, log_start: int = 0) -> DataFrame:
    """Aborted ranges that a fetch from ``fetch_offset`` must know, without those wholly below ``log_start``."""
    return txns.where((F.col("decision") == "ABORT") & (F.col("marker_offset") > fetch_offset) & (F.col("marker_offset") >= log_start))


def read_committed(log: DataFrame, lso: DataFrame) -> DataFrame:
    """Data records below the last stable offset, without those of aborted transactions. All of ``log`` is transactional but
    where a column ``is_txn`` says otherwise."""
    before = Window.partitionBy(*_OWNER).orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*_OWNER, "_no")
    d = log.withColumn("_no", F.coalesce(F.sum(F.col("is_control").cast("long")).over(before), F.lit(0)))
    d = d.withColumn("_committed", F.max(F.coalesce(F.col("decision") == "COMMIT", F.lit(False))).over(whole))
    seen = F.col("_committed") | ~F.col("is_txn") if "is_txn" in log.columns else F.col("_committed")
    d = d.where(~F.col("is_control") & seen).join(lso.select(*PLACE, "lso"), PLACE).where("offset < lso")
    return d.drop("_no", "_committed", "lso")


def visible(log: DataFrame, marks: DataFrame, isolation: str = "read_uncommitted") -> DataFrame:
    """Data records as a reader of an isolation level sees them; no level delivers control records."""
    if isolation == "read_committed":
        return read_committed(log, last_stable_offset(transactions(log), marks))
    if isolation != "read_uncommitted":
        raise ValueError(isolation)
    return log.where(~F.col("is_control"))


def with_bit(attrs: str, bit: int, on: bool) -> Column:
    """Attributes with a bit set or cleared."""
    a = F.col(attrs).cast("int")
    return a.bitwiseOR(bit) if on else a.bitwiseAND(~bit & 0xFFFF)


def with_codec(attrs: str, codec: int) -> Column:
    return F.col(attrs).cast("int").bitwiseAND(0xFFFC).bitwiseOR(codec)


def drop_aborted(batches: DataFrame, ranges: DataFrame) -> DataFrame:
    """Batches outside every aborted range of their producer; ranges may overlap. One union and one window, no range join: a batch
    is aborted if the greatest marker of the ranges begun up to it lies above it. Nulls match no range."""
    r = ranges.select(*_OWNER, F.col("first_offset").alias("_at"), F.col("marker_offset").alias("_until")).dropna()
    b = batches.where(~F.col("is_control")).withColumn("_at", F.col("base_offset"))
    begun = Window.partitionBy(*_OWNER).orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = b.unionByName(r, allowMissingColumns=True).withColumn("_until", F.max("_until").over(begun))
    # a range has no is_control, so it goes as well
    return both.where(~F.col("is_control") & F.coalesce(F.col("_until") <= F.col("base_offset"), F.lit(True))).select(*batches.columns)


def timed_out(activity: DataFrame, on: list[str], ts_micros: str, limit_micros: int, now_micros: int | None = None) -> DataFrame:
    """Transactions idle for longer than the limit before their next activity, or until now for the last one: ``idle_micros``."""
    w = Window.partitionBy(*on).orderBy(ts_micros, *[c for c in activity.columns if c not in (*on, ts_micros)])
    until = F.coalesce(F.lead(ts_micros).over(w), F.lit(now_micros).cast("long"))
    return activity.withColumn("idle_micros", until - F.col(ts_micros)).where(F.col("idle_micros") > limit_micros)


def participants(added: DataFrame) -> DataFrame:
    """Distinct sorted partitions of each transaction (transactional_id, txn_no, topic, partition)."""
    return added.groupBy("transactional_id", "txn_no").agg(F.array_sort(F.collect_set(F.struct("topic", "partition"))).alias("participants"))


def pending_markers(decided: DataFrame, acked: DataFrame) -> DataFrame:
    """Participants of decided transactions whose marker isn't acknowledged yet: what a new coordinator writes again."""
    want = decided.select("transactional_id", "txn_no", "decision", F.explode("participants").alias("p")).select("transactional_id", "txn_no", "decision", "p.topic", "p.partition")
    return want.join(acked, ["transactional_id", "txn_no", "topic", "partition"], "left_anti")


def control_batches(decided: DataFrame) -> DataFrame:
    """A control batch for each participant of decided transactions (producer_id, producer_epoch, decision, coordinator_epoch, participants):
    topic, partition, attrs, record_count, and the marker's key (version, type) and value (version, coordinator epoch), big endian."""
    out = decided.select("producer_id", "producer_epoch", "decision", "coordinator_epoch", F.explode("participants").alias("_p"))
    word = lambda c, n: F.unhex(F.substring(F.lpad(F.hex(c.cast("long")), 16, "0"), 17 - 2 * n, 2 * n))
    kind = (F.col("decision") == "COMMIT").cast("int")
    return out.select(
        "_p.topic", "_p.partition", "producer_id", "producer_epoch", F.lit(TRANSACTIONAL | CONTROL).alias("attrs"), F.lit(1).alias("record_count"),
        F.concat(word(F.lit(MARKER_VERSION), 2), word(kind, 2)).alias("key"), F.concat(word(F.lit(MARKER_VERSION), 2), word(F.col("coordinator_epoch"), 4)).alias("value"),
    )


def parse_markers(batches: DataFrame) -> DataFrame:
    """Adds decision, coordinator_epoch and error (null, InvalidArgument, Corrupt or Unsupported) to batches (attrs, record_count, key, value)."""
    number = lambda c, at, n: F.conv(F.hex(F.substring(c, at, n)), 16, 10).cast("long")
    is_control = (F.col("attrs").bitwiseAND(CONTROL) != 0) & (F.col("record_count") == 1) & F.col("key").isNotNull() & F.col("value").isNotNull()
    whole = (F.length("key") == 4) & (F.length("value") == 6)
    known = (number("key", 1, 2) == MARKER_VERSION) & (number("value", 1, 2) == MARKER_VERSION)
    kind = number("key", 3, 2)
    error = F.when(~is_control, "InvalidArgument").when(~whole, "Corrupt").when(~known, "Unsupported").when(kind > 1, "Corrupt")
    out = batches.withColumn("error", error)
    seen = lambda c: F.when(F.col("error").isNull(), c)
    epoch = number("value", 3, 4)
    epoch = F.when(epoch >= 1 << 31, epoch - (1 << 32)).otherwise(epoch)
    return out.withColumn("decision", seen(F.when(kind == 1, "COMMIT").otherwise("ABORT"))).withColumn("coordinator_epoch", seen(epoch).cast("int"))


def fence(markers: DataFrame, on: list[str], order: str, epoch: str = "coordinator_epoch") -> DataFrame:
    """Markers not older than the newest coordinator seen before them."""
    w = Window.partitionBy(*on).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return markers.withColumn("_seen", F.max(epoch).over(w)).where(F.col("_seen").isNull() | (F.col(epoch) >= F.col("_seen"))).drop("_seen")


#: States and the largest producer epoch.
ONGOING, PREPARE_COMMIT, PREPARE_ABORT, COMPLETE_COMMIT, COMPLETE_ABORT, EMPTY = "Ongoing", "PrepareCommit", "PrepareAbort", "CompleteCommit", "CompleteAbort", "Empty"
MAX_EPOCH = 32767
#: Attribute bits of transactional and control batches, version of markers.
TRANSACTIONAL, CONTROL, MARKER_VERSION = 0x0010, 0x0020, 0


def coordinate(state: dict | None, op: dict) -> tuple[dict, str]:
    """One request of a transactional id against its state; returns the new state and the reply.

    Pure, so batch folds and streaming state processors share it. Requests: init, begin, add, commit, abort, ack, tick.
    """
    s = dict(state or {"producer_id": -1, "epoch": -1, "txn_epoch": None, "state": EMPTY, "parts": [], "unacked": [], "seen": 0})
    kind, epoch = op["op"], op.get("epoch")

    def decide(commit: bool) -> None:
        names = (PREPARE_COMMIT, COMPLETE_COMMIT) if commit else (PREPARE_ABORT, COMPLETE_ABORT)
        s.update(state=names[0] if s["parts"] else names[1], unacked=list(s["parts"]))

    if kind == "init":
        if s["state"] == ONGOING:
            decide(commit=False)
        if s["producer_id"] < 0 or s["epoch"] >= MAX_EPOCH:
            s.update(producer_id=op["new_id"], epoch=0)
        else:
            s["epoch"] += 1
        return s, f"ok:{s['producer_id']}:{s['epoch']}"
    if kind == "tick":
        if s["state"] != ONGOING or op["now"] - s["seen"] <= op["timeout"]:
            return s, "ok"
        decide(commit=False)
        return s, "aborted"
    if kind == "ack":
        if epoch != s["txn_epoch"] or s["state"] not in (PREPARE_COMMIT, PREPARE_ABORT):
            return s, "ignored"
        s["unacked"] = [p for p in s["unacked"] if tuple(p) != tuple(op["part"])]
        if not s["unacked"]:
            s["state"] = COMPLETE_COMMIT if s["state"] == PREPARE_COMMIT else COMPLETE_ABORT
        return s, "ok"
    if epoch < s["epoch"]:
        return s, "fenced"
    if kind == "begin":
        if epoch == s["txn_epoch"] and s["state"] in (ONGOING, PREPARE_COMMIT, PREPARE_ABORT):
            return s, "invalid"
        s.update(state=ONGOING, epoch=epoch, txn_epoch=epoch, parts=[], unacked=[], seen=op["now"])
        return s, "ok"
    if s["txn_epoch"] is None:
        return s, "unknown"
    if s["state"] != ONGOING or epoch != s["txn_epoch"]:
        return s, "invalid"
    s["seen"] = op["now"]
    if kind == "add":
        s["parts"] = sorted({*map(tuple, s["parts"]), tuple(op["part"])})
    else:
        decide(commit=kind == "commit")
    return s, "ok"
