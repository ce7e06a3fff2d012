"""Every query with SQL against DuckDB, on the smallest tables."""

import collections
import datetime

import pytest

from loglake.model import event_log
from loglake.operators import txn
from loglake.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr(tuple(plain(r[k]) for k in order)) for r in data)


@pytest.fixture(scope="module")
def duck(small):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, small, name):
    df = registry.QUERIES[name](spark, small)
    want = duck.execute(registry.ORACLES[name])
    columns = [x[0] for x in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, small, name):
    assert registry.QUERIES[name](spark, small).collect()  # every column is computed


def test_coordinator_fold_equals_replay(spark, small):
    """The distributed fold against a plain loop; every kind of reply comes up."""
    got = {(r.id, r.event_id): r.result for r in registry.QUERIES["txn_coordinator_fold"](spark, small).collect()}
    states, want, inits = {}, {}, collections.Counter()
    kinds = {0: "begin", 1: "begin", 5: "commit", 6: "ack", 7: "abort", 8: "tick"}
    events = spark.read.parquet(f"{small}/events.parquet").selectExpr("user_id", "event_id", "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) AS us").orderBy("event_id").collect()
    for r in events:
        kind = "init" if r.event_id < 40 or r.event_id % 90 == 0 else kinds.get(r.event_id % 9, "add")
        inits[r.user_id % 5] += kind == "init"
        op = {"op": kind, "now": r.us, "epoch": inits[r.user_id % 5] - 1 - (r.event_id % 23 == 0), "part": ["events", str(r.user_id % 2)], "new_id": r.event_id, "timeout": 3_600_000_000}
        states[r.user_id % 5], want[r.user_id % 5, r.event_id] = txn.coordinate(states.get(r.user_id % 5), op)
    assert got == want and {"ok", "aborted", "fenced", "invalid", "ignored"} <= {x.split(":")[0] for x in want.values()}


def test_segment_lookup_answers_every_offset(spark, small):
    got = [tuple(r) for r in registry.QUERIES["segment_lookup_every_offset"](spark, small).select("partition", "offset", "segment_base").collect()]
    places = sorted((r[0], r[1]) for r in event_log(spark, small).select("partition", "offset").collect())
    assert sorted(got) == [(p, o, max(b for q, b in places if q == p and b % 500 == 0 and b <= o)) for p, o in places]


def test_entry(spark, small):
    assert registry.flagship(spark, small).count() > 0
