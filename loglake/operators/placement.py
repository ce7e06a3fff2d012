"""Placement: shards, round robin, consistent hashing, least connections."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from loglake.functions.hashes import fnv1a_64, fnv1a_64_int

VIRTUAL_NODES = 128


def shard(df: DataFrame, key: str, shards: int) -> DataFrame:
    """Shard of a name: unsigned FNV-1a of its bytes modulo ``shards``."""
    return df.withColumn("shard", (fnv1a_64(F.col(key).cast("binary")) % shards).cast("int"))


def owner_core(df: DataFrame, cores: int, partition: str = "partition") -> DataFrame:
    return df.withColumn("core", F.pmod(partition, F.lit(cores)).cast("int"))


def round_robin(df: DataFrame, nodes: list[str], order: str) -> DataFrame:
    """Nodes in sorted order, dealt in turn; numbering is distributed like offsets are."""
    from loglake.model import assign_offsets

    nodes = sorted(nodes)
    out = assign_offsets(df.withColumn("_all", F.lit(0)), order, ["_all"])
    turn = F.pmod("offset", F.lit(len(nodes))) + 1
    return out.withColumn("node", F.element_at(F.array(*map(F.lit, nodes)), turn.cast("int"))).drop("_all", "offset")


def ring(nodes: list[str], virtual: int = VIRTUAL_NODES) -> list[tuple[int, str]]:
    """Points of the hash ring in order; of two nodes at one point, the first in the list holds it."""
    points: dict[int, str] = {}
    for node in nodes:
        for k in range(virtual):
            points.setdefault(fnv1a_64_int(f"{node}#{k}".encode()), node)
    return sorted(points.items())


def consistent_hash(df: DataFrame, key: str, nodes: list[str], virtual: int = VIRTUAL_NODES) -> DataFrame:
    """Node of each key: the ring's first point at or after its hash, wrapping round. The ring is as small as the node list, and
    goes to the workers whole; rows aren't shuffled."""
    points = ring(nodes, virtual)
    at, who = np.array([p for p, _ in points], np.uint64), np.array([n for _, n in points], object)

    @pandas_udf("string")
    def owner(keys: pd.Series) -> pd.Series:
        h = np.array([fnv1a_64_int(str(k).encode()) for k in keys], np.uint64)
        return pd.Series(who[np.searchsorted(at, h, "left") % len(at)], dtype=object)

    return df.withColumn("node", owner(F.col(key).cast("string")))


def least_connections(active: DataFrame) -> DataFrame:
    """Node with the fewest connections for each service (service, node, connections); ties to the smallest name."""
    return active.groupBy("service").agg(F.min(F.struct("connections", "node")).alias("_m")).select("service", F.col("_m.node").alias("node"), F.col("_m.connections").alias("connections"))


def assign_least(nodes: dict[str, int], events: list[tuple[str, str | None]]) -> list[str]:
    """Least connections step by step: ("open", None) picks a node, ("close", node) frees one."""
    load, out = dict(nodes), []
    for op, node in events:
        if op == "open":
            node = min(sorted(load), key=lambda n: load[n])
            load[node] += 1
            out.append(node)
        else:
            load[node] = max(0, load[node] - 1)
    return out


def spread(df: DataFrame, key: str, node: str = "node") -> DataFrame:
    """Keys of each node, to see how even a placement is."""
    return df.groupBy(node).agg(F.countDistinct(key).alias("keys"))


def rank_nodes(df: DataFrame, on: str, load: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(on).orderBy(load, "node")))
