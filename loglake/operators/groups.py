"""Consumer groups: committed offsets, lag, membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglake.model import PLACE


def committed(commits: DataFrame) -> DataFrame:
    """Last commit of each (group, topic, partition) by commit_seq: it may move backwards."""
    return commits.groupBy("group", *PLACE).agg(F.max(F.struct("commit_seq", "offset")).alias("_c")).select("group", *PLACE, F.col("_c.offset").alias("offset"))


def fetch_committed(requests: DataFrame, offsets: DataFrame) -> DataFrame:
    """Committed offsets asked for; -1 where there is none."""
    return requests.join(offsets, ["group", *PLACE], "left").withColumn("offset", F.coalesce("offset", F.lit(-1)).cast("long"))


def lag(offsets: DataFrame, marks: DataFrame) -> DataFrame:
    """high_watermark (0 for an unknown partition) and lag, never below 0."""
    out = offsets.join(marks.select(*PLACE, "high_watermark"), PLACE, "left").withColumn("high_watermark", F.coalesce("high_watermark", F.lit(0)).cast("long"))
    return out.withColumn("lag", F.greatest(F.col("high_watermark") - F.col("offset"), F.lit(0)).cast("long"))


def sessions(beats: DataFrame, on: list[str], ts_micros: str, timeout_micros: int) -> DataFrame:
    """A member's sessions: heartbeats with gaps of at most the timeout (a longer one expires the session)."""
    order = Window.partitionBy(*on).orderBy(ts_micros)
    b = beats.withColumn("_new", F.coalesce((F.col(ts_micros) - F.lag(ts_micros).over(order) > timeout_micros).cast("long"), F.lit(1)))
    b = b.withColumn("session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return b.groupBy(*on, "session").agg(F.min(ts_micros).alias("started"), F.max(ts_micros).alias("last_seen"), F.count("*").alias("heartbeats"))


def page(df: DataFrame, order: list[str], number: int = 1, size: int = 20) -> DataFrame:
    """Page ``number`` (from 1) of at most 100 rows a page; one past the end is empty. Other numbers and sizes are refused."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("page from 1 on, size from 1 to 100")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


#: Group states.
EMPTY, PREPARING, COMPLETING, STABLE, DEAD = "Empty", "PreparingRebalance", "CompletingRebalance", "Stable", "Dead"


def join_group(state: dict | None, op: dict) -> tuple[dict, str]:
    """One request against a group's state; returns the new state and the reply. Requests: join, sync, heartbeat, leave, tick.

    Pure, so batch folds and streaming state processors share it. Members are {id: {"seen", "timeout", "rejoined", "assignment"}}.
    """
    s = dict(state or {"name": op["group"], "state": EMPTY, "generation": 0, "leader": None, "members": {}, "next": 1})
    s["members"] = {k: dict(v) for k, v in s["members"].items()}
    m, kind, who, now = s["members"], op["op"], op.get("member"), op["now"]

    def rebalance() -> None:
        s["state"], s["leader"] = (PREPARING if m else EMPTY), None
        for x in m.values():
            x["rejoined"] = False

    if kind == "join":
        if not who:
            who = f"{s['name']}-{s['next']}"
            s["next"] += 1
        if s["state"] in (STABLE, EMPTY):
            rebalance()
            s["state"] = PREPARING
        m.setdefault(who, {"assignment": None}).update(seen=now, timeout=op["timeout"], rejoined=True)
        if s["leader"] not in m:
            s["leader"] = who
        if s["state"] == PREPARING and all(x["rejoined"] for x in m.values()):
            s["generation"] += 1
            s["state"] = COMPLETING
            for x in m.values():
                x["assignment"] = None
        return s, f"joined:{who}:{s['generation']}:{s['leader']}"
    if kind == "tick":
        late = [k for k, x in m.items() if now - x["seen"] > x["timeout"]]
        for k in late:
            del m[k]
        if late:
            rebalance()
        return s, f"expired:{len(late)}"
    if who not in m:
        return s, "unknown_member"
    if kind == "leave":
        del m[who]
        rebalance()
        return s, "left"
    if kind == "heartbeat":
        m[who]["seen"] = now
        if s["state"] in (PREPARING, COMPLETING):
            return s, "rebalance_in_progress"
        return s, "ok" if op["generation"] == s["generation"] else "illegal_generation"
    if op["generation"] != s["generation"]:
        return s, "illegal_generation"
    m[who]["seen"] = now
    if who == s["leader"] and s["state"] == COMPLETING:
        for k, v in (op.get("assignments") or {}).items():
            if k in m:
                m[k]["assignment"] = v
        s["state"] = STABLE
    return s, f"synced:{m[who]['assignment']}" if s["state"] == STABLE else "not_assigned"


def describe(offsets_with_lag: DataFrame, members: DataFrame) -> DataFrame:
    """A row per group: members, partitions with a committed offset, total lag."""
    m = members.groupBy("group").agg(F.countDistinct("member").alias("members"))
    o = offsets_with_lag.groupBy("group").agg(F.count("*").alias("partitions"), F.sum("lag").cast("long").alias("total_lag"))
    return m.join(o, "group", "full").select("group", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("members", "partitions", "total_lag")))


def distribute(assignments: DataFrame, members: DataFrame) -> DataFrame:
    """The leader's assignments (group, member, assignment) for members that are there; others are ignored."""
    return assignments.join(members.select("group", "member").distinct(), ["group", "member"])
