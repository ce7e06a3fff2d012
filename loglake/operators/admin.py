"""The administration facade: routes and commands answered with DataFrames, API versions, engine options."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.model import PLACE
from loglake.operators import catalog as K
from loglake.operators import groups as G

#: Requests of the native protocol, all in version 0; requests of the compatible one with their oldest and newest versions.
NATIVE_REQUESTS = ["ApiVersions", "Metadata", "Produce", "Fetch", "OffsetCommit", "OffsetFetch", "JoinGroup", "SyncGroup", "Heartbeat", "LeaveGroup", "CreateTopic", "DeleteTopic"]
COMPATIBLE_REQUESTS = [("Produce", 0, 9), ("Fetch", 0, 12), ("ListOffsets", 0, 7), ("Metadata", 0, 9), ("ApiVersions", 0, 3)]


def api_versions(spark: SparkSession) -> DataFrame:
    rows = [("native", k, 0, 0) for k in NATIVE_REQUESTS] + [("compatible", *r) for r in COMPATIBLE_REQUESTS]
    return spark.createDataFrame(rows, "protocol string, api string, oldest int, newest int")


@dataclass(frozen=True)
class Options:
    """What the engine is started with."""

    host: str = "127.0.0.1"
    port: int = 9092
    admin_port: int = 0
    data_dir: str = "data"
    tier_dir: str = ""
    node_id: int = 0
    jwt_secret: str = ""
    encryption_key: str = ""
    topics: tuple[tuple[str, int], ...] = field(default=())


def options(args: list[str]) -> Options:
    """Reads ``--name value`` pairs; numbers that aren't any keep the default; an unknown name, or one without a value, is refused."""

    def number(text: str, default: int) -> int:
        return int(text) if text.removeprefix("-").isascii() and text.removeprefix("-").isdigit() else default

    out = Options()
    if len(args) % 2:
        raise ValueError(f"{args[-1]} has no value")
    for name, value in zip(args[::2], args[1::2], strict=True):
        key = name.removeprefix("--").replace("-", "_")
        if name == "--topic":
            topic, _, rest = value.partition(":")
            out = replace(out, topics=(*out.topics, (topic, max(1, number(rest, 1)))))
        elif not name.startswith("--") or key == "topics" or not hasattr(out, key):
            raise ValueError(f"{name} isn't an option")
        else:
            old = getattr(out, key)
            out = replace(out, **{key: number(value, old) if isinstance(old, int) else value})
    return out


class Admin:
    """Answers over a catalog (topic, partitions), watermarks, committed offsets and members; nothing is computed before it is asked for."""

    def __init__(self, catalog: DataFrame, marks: DataFrame, committed: DataFrame, members: DataFrame, replicated: DataFrame):
        self.catalog, self.marks, self.committed, self.members, self.replicated = catalog, marks, committed, members, replicated

    def get(self, target: str) -> DataFrame:
        """A route: topics, topics/{name}, groups, groups/{id}, cluster, readyz; lists take page and size."""
        url = urlsplit(target)
        parts = [p for p in url.path.split("/") if p]
        asked = dict(reversed(parse_qsl(url.query, keep_blank_values=True)))
        page, size = (int(asked.get(k, d)) for k, d in (("page", 1), ("size", 20)))
        if parts == ["topics"]:
            return G.page(self.catalog, ["topic"], page, size)
        if parts[:1] == ["topics"] and len(parts) == 2:
            return K.describe(self.catalog.where(F.col("topic") == parts[1]), self.marks.select(*PLACE, "high_watermark"))
        if parts == ["groups"]:
            return G.page(self._groups(), ["group"], page, size)
        if parts[:1] == ["groups"] and len(parts) == 2:
            return G.lag(self.committed.where(F.col("group") == parts[1]), self.marks).select("group", *PLACE, "offset", "high_watermark", "lag").orderBy(*PLACE)
        if parts == ["cluster"]:
            return K.describe_cluster(self.replicated, self.marks)
        raise LookupError(target)

    def command(self, *words: str) -> DataFrame:
        """A command of the tool: topic list, topic describe NAME, group list, group describe ID, partitions TOPIC."""
        match words:
            case ("topic", "list"):
                return self.get("/topics")
            case ("topic", "describe", name):
                return self.get(f"/topics/{name}")
            case ("group", "list"):
                return self.get("/groups")
            case ("group", "describe", group):
                # the tool looks the group up in the first page of the list
                return self.get("/groups").where(F.col("group") == group)
            case ("partitions", name):
                return self.marks.where(F.col("topic") == name).select("partition", "log_start", "high_watermark").orderBy("partition")
        raise LookupError(" ".join(words))

    def _groups(self) -> DataFrame:
        return G.describe(G.lag(self.committed, self.marks), self.members)
