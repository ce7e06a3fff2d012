"""Token buckets, circuit breakers, credit windows and health checks: ordered folds per key.

Each is a pure step function that batch folds (``fold``) and streaming state processors (loglake.streaming) share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def token_bucket(state: dict | None, op: dict, rate: float, burst: float) -> tuple[dict, bool]:
    """Refill at ``rate`` a second up to ``burst``; a clock that goes back is ignored."""
    s = dict(state or {"tokens": burst, "at": op["now"]})
    if op["now"] > s["at"]:
        s["tokens"] = min(burst, s["tokens"] + (op["now"] - s["at"]) * rate / 1e6)
        s["at"] = op["now"]
    cost = op.get("cost", 1)
    if s["tokens"] >= cost:
        s["tokens"] -= cost
        return s, True
    return s, False


def circuit_breaker(state: dict | None, op: dict, window: int = 20, least: int = 10, ratio: float = 0.5, open_micros: int = 5_000_000, probes: int = 3) -> tuple[dict, str]:
    """Closed until a failure brings those among the last ``window`` results to ``ratio`` of ``least`` or more; open for a while; half-open for
    ``probes`` calls, closed if all succeed, open again at the first failure.

    An op is a call with its result at once; or, with ``kind``, ``allow`` (may a call begin?) and its ``result`` later, so that calls are in flight.
    """
    s = dict(state or {"state": "Closed", "last": [], "opened": 0, "issued": 0, "good": 0})
    s["last"] = list(s["last"])
    kind = op.get("kind", "call")
    if kind != "result":
        if s["state"] == "Open" and op["now"] - s["opened"] >= open_micros:
            s.update(state="HalfOpen", issued=0, good=0)
        if s["state"] == "Open" or (s["state"] == "HalfOpen" and s["issued"] >= probes):
            return s, "rejected"
        s["issued"] += s["state"] == "HalfOpen"
        if kind == "allow":
            return s, "allowed"
    if s["state"] == "HalfOpen" and not op["failed"]:
        s["good"] += 1
        if s["good"] >= probes:
            s.update(state="Closed", last=[])
    elif s["state"] == "Closed":
        s["last"] = [*s["last"], bool(op["failed"])][-window:]
    full = len(s["last"]) >= least and sum(s["last"]) / len(s["last"]) >= ratio
    if op["failed"] and (s["state"] == "HalfOpen" or (s["state"] == "Closed" and full)):
        s.update(state="Open", opened=op["now"])
    return s, s["state"]


def credit_window(state: dict | None, op: dict, capacity: int) -> tuple[dict, bool]:
    """``acquire`` takes credit if there is enough, ``grant`` returns it, up to ``capacity``."""
    s = dict(state or {"credit": capacity})
    if op["op"] == "grant":
        s["credit"] = min(capacity, s["credit"] + op["cost"])
        return s, True
    if s["credit"] < op["cost"]:
        return s, False
    s["credit"] -= op["cost"]
    return s, True


def health(state: dict | None, op: dict, down: int = 3, up: int = 2) -> tuple[dict, bool]:
    """Down after ``down`` failures in a row, up again after ``up`` successes; never observed is healthy."""
    s = dict(state or {"healthy": True, "run": 0, "last": None})
    s["run"] = s["run"] + 1 if s["last"] == op["failed"] else 1
    s["last"] = op["failed"]
    if op["failed"] and s["run"] >= down:
        s["healthy"] = False
    elif not op["failed"] and s["run"] >= up:
        s["healthy"] = True
    return s, s["healthy"]


def fold(df: DataFrame, on: list[str], order: str, step: Callable, result: str) -> DataFrame:
    """Runs a step function over each key's rows in order. Keys are sorted into Arrow batches and the state is carried from batch to
    batch, so a hot key is never held in memory at once."""
    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*on, order]) + f", result {result}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                now = tuple(row[c] for c in on)
                if now != key:
                    key, state = now, None
                state, got = step(state, row)
                out.append((*now, row[order], got))
            yield pd.DataFrame(out, columns=[*on, order, "result"])

    return df.repartition(*on).sortWithinPartitions(*on, order).mapInPandas(run, schema)
