"""Operators on small literal logs: each rule's cases, and step functions against literal replays."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from loglake.functions import hashes, records
from loglake.operators import admin, compact, groups, idempotent, metrics, placement, quorum, read, resilience, retention, txn, write

PLACE = "topic string, partition int"


def log(spark, rows):
    return spark.createDataFrame([("t", 0, k, None if v == "-" else v, o) for k, v, o in rows], f"{PLACE}, key string, value string, offset long")


@pytest.mark.parametrize(
    "rows, retain, want, stats",
    [
        ([("a", "1", 0), ("b", "1", 1), ("a", "2", 2), ("a", "3", 3), ("b", "2", 4)], False, [("a", "3", 3), ("b", "2", 4)], (5, 2, 3, 0)),
        ([("a", "1", 0), ("b", "1", 1), ("a", "-", 2)], False, [("b", "1", 1)], (3, 1, 1, 1)),
        ([("a", "1", 0), ("a", "-", 1)], True, [("a", None, 1)], None),
        ([(None, "x", 0), ("a", "1", 1), (None, "y", 2), ("a", "2", 3)], False, [(None, "x", 0), (None, "y", 2), ("a", "2", 3)], (4, 3, 1, 0)),
        ([("a", "", 0)], False, [("a", "", 0)], (1, 1, 0, 0)),
        ([], False, [], None),
    ],
)
def test_compaction(spark, rows, retain, want, stats):
    df = log(spark, rows)
    got = [(r.key, r.value, r.offset) for r in compact.compact(df, retain).orderBy("offset").collect()]
    assert got == want
    if stats:
        assert tuple(compact.compaction_stats(df).first())[2:] == stats


def batch(spark, rows):
    return spark.createDataFrame([("t", 0, p, o, c, d) for p, o, c, d in rows], f"{PLACE}, producer_id long, offset long, is_control boolean, decision string")


def test_transactions(spark):
    data, mark = (lambda p, o: (p, o, False, None)), (lambda p, o, d: (p, o, True, d))
    marks = spark.createDataFrame([("t", 0, 100)], f"{PLACE}, high_watermark long")
    lso = lambda rows: txn.last_stable_offset(txn.transactions(batch(spark, rows)), marks).first().lso
    assert lso([mark(9, 1, "COMMIT")]) == 100
    assert lso([data(7, 40), data(7, 45)]) == 40
    assert lso([data(7, 40), mark(7, 50, "ABORT")]) == 100
    assert lso([data(1, 60), data(2, 30), data(3, 90)]) == 30
    rows = [data(1, 10), data(2, 20), mark(1, 21, "ABORT"), mark(2, 22, "COMMIT"), data(1, 40), mark(1, 41, "COMMIT")]
    b = batch(spark, rows)
    t = txn.transactions(b)
    assert [(r.producer_id, r.first_offset, r.marker_offset) for r in txn.aborted(t).collect()] == [(1, 10, 21)]
    assert txn.aborted(t, 21).count() == 0 and txn.aborted(t, 0, 22).count() == 0
    got = txn.read_committed(b, txn.last_stable_offset(t, marks))
    assert sorted(r.offset for r in got.collect()) == [20, 40]
    got = txn.drop_aborted(b.withColumn("base_offset", F.col("offset")), txn.aborted(t))
    assert sorted(r.offset for r in got.collect()) == [20, 40]


def test_drop_aborted_has_no_range_join(spark):
    """Against brute force: overlapping, empty and repeated ranges, ties, nulls. A join would meet each batch of a producer with each of its ranges."""
    rng = random.Random(5)
    pick = lambda top: rng.choice([None, *range(top)] if rng.random() < 0.2 else range(top))
    b = [(rng.choice(["t", "t", "u", None]), pick(2), pick(3), pick(40), rng.choice([False, False, True, None]), i) for i in range(600)]
    r = [(rng.choice(["t", "t", "u", None]), pick(2), pick(3), (at := pick(40)), None if at is None else at + rng.choice([-1, 0, 1, 2, 9])) for _ in range(25)]
    r += [("t", 0, 1, 12, None), ("t", 0, 2, 5, 35), ("t", 0, 2, 7, 9), ("t", 0, 2, 7, 9)]
    hit = lambda x, y: None not in (*x[:4], *y) and x[:3] == y[:3] and y[3] <= x[3] < y[4]
    want = [x for x in b if x[4] is False and not any(hit(x, y) for y in r)]
    batches = spark.createDataFrame(b, "topic string, partition int, producer_id long, base_offset long, is_control boolean, id long")
    got = txn.drop_aborted(batches, spark.createDataFrame(r, "topic string, partition int, producer_id long, first_offset long, marker_offset long"))
    assert got.schema.names == batches.schema.names and sorted((tuple(x) for x in got.collect()), key=lambda x: x[5]) == want
    assert 100 < len(want) < sum(x[4] is False for x in b) - 30
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_circuit_breaker_rules():
    """A success never opens it; too few results don't; probes in flight are limited; a late failure opens it again."""
    step = lambda s, now, failed, **o: resilience.circuit_breaker(s, {"now": now, "failed": failed, **o})
    s = None
    for k in range(6):
        s, r = step(s, k, True)
    for k in range(4):
        s, r = step(s, 6 + k, False)
    assert r == "Closed"  # six of ten failed, but the tenth result is a success
    s, r = step(s, 10, True)
    assert r == "Open"
    got = []
    for k in range(4):
        s, r = step(s, 6_000_000 + k, None, kind="allow")
        got.append(r)
    assert got == ["allowed"] * 3 + ["rejected"]
    s, r = step(s, 6_000_100, False, kind="result")
    assert r == "HalfOpen"
    s, r = step(s, 6_000_200, True, kind="result")
    assert r == "Open" and step(s, 6_000_300, None, kind="allow")[1] == "rejected"


def test_admin_options_and_routes(spark):
    got = admin.options(["--port", "7000", "--topic", "a:3", "--topic", "b", "--topic", "c:x", "--node-id", "oops", "--data-dir", "/d"])
    assert (got.port, got.node_id, got.data_dir, got.topics) == (7000, 0, "/d", (("a", 3), ("b", 1), ("c", 1)))
    for wrong in (["--port"], ["--nothing", "1"], ["port", "1"], ["--topics", "x"]):
        with pytest.raises(ValueError):
            admin.options(wrong)
    with pytest.raises(LookupError):
        admin.Admin(None, None, None, None, None).get("/nowhere")


def test_histogram_text(spark):
    df = spark.createDataFrame([("a\"b", 0.5), ("a\"b", 3.0), ("a\"b", 20.0)], "k string, v double")
    h = metrics.histogram(df, ["k"], "v", [0.5, 10.0]).select(F.lit("h").alias("name"), F.create_map(F.lit("k"), F.col("k")).alias("labels"), "le", "bucket", "count", "sum")
    label = 'k="a\\"b"'
    want = ["# HELP h All.", "# TYPE h histogram", f'h_bucket{{{label},le="0.5"}} 1', f'h_bucket{{{label},le="10"}} 2', f'h_bucket{{{label},le="+Inf"}} 3', f"h_sum{{{label}}} 23.5", f"h_count{{{label}}} 3"]
    got = [r.line for r in metrics.render_histograms(h, {"h": "All."}).orderBy("at", "line").collect()]
    assert sorted(got) == sorted(want) and got[:2] == want[:2]


def test_folds_keep_rows_and_ties(spark):
    rows = [("t", 0, 7, 0, s, 1, 5, "x") for s in (0, 1, 1, 3)] + [("t", 0, -1, 0, 0, 1, 5, "y"), ("t", 0, None, 0, 0, 1, 5, "z")]
    df = spark.createDataFrame(rows, f"{PLACE}, producer_id long, producer_epoch int, base_sequence long, record_count int, arrival long, extra string")
    got = sorted((r.extra, r.base_sequence, r.verdict) for r in idempotent.classify(df).collect())
    assert got == [("x", 0, "Accept"), ("x", 1, "Accept"), ("x", 1, "Duplicate"), ("x", 3, "Gap"), ("y", 0, "Accept"), ("z", 0, "Accept")]
    assert idempotent.classify(df.where("false")).count() == 0
    parts = spark.createDataFrame([("t", 0, 10 * k, b) for k, b in enumerate((5, 5, 20, 1, 9, 10))], f"{PLACE}, base_offset long, bytes long")
    assert [r.segment for r in write.greedy_segments(parts, 10).orderBy("base_offset").collect()] == [0, 0, 1, 2, 2, 3]
    assert [r.anchor for r in write.index_anchors(parts, 10).orderBy("anchor").collect()] == [20, 30, 50]
    assert write.index_anchors(parts, 0).count() == 6
    act = spark.createDataFrame([(1, 0), (1, 50), (2, 0)], "id long, us long")
    assert sorted(tuple(r) for r in txn.timed_out(act, ["id"], "us", 30, 100).collect()) == [(1, 0, 50), (1, 50, 50), (2, 0, 100)]
    with pytest.raises(ValueError):
        groups.page(act, ["id"], 1, 101)


def test_idempotence_equals_replay(spark):
    rng = random.Random(4)
    rows = [("t", rng.randrange(2), rng.randrange(3), rng.randrange(3), rng.randrange(6), rng.randrange(1, 3), k) for k in range(600)]
    df = spark.createDataFrame(rows, f"{PLACE}, producer_id long, producer_epoch int, base_sequence long, record_count int, arrival long")
    state, want = {}, {}
    for _, p, pid, epoch, seq, n, k in rows:
        state[p, pid], want[k] = idempotent.check(state.get((p, pid)), {"epoch": epoch, "base_sequence": seq, "count": n})
    got = {r.arrival: r.verdict for r in idempotent.classify(df).collect()}
    assert got == want and len(set(want.values())) == 4


def test_produce_offsets(spark):
    rows = [(-1, -1, -1, 3), (-1, -1, -1, 2), (7, 0, 0, 2), (7, 0, 0, 2), (7, 0, 5, 1), (7, 1, 0, 1), (7, 0, 2, 1)]
    df = spark.createDataFrame([("t", 0, *r, k) for k, r in enumerate(rows)], f"{PLACE}, producer_id long, producer_epoch int, base_sequence long, record_count int, arrival long")
    got = [(r.verdict, r.last_offset) for r in idempotent.produce(df).orderBy("arrival").collect()]
    assert got == [("Accept", 2), ("Accept", 4), ("Accept", 6), ("Duplicate", 6), ("Gap", None), ("Accept", 7), ("Fenced", None)]


@pytest.mark.parametrize("size, age, want", [(350, -1, [2, 4]), (0, -1, [4]), (-1, 60_000, [2, 4]), (-1, -1, [0, 2, 4])])
def test_retention(spark, size, age, want):
    now = 10_000_000
    s = spark.createDataFrame([("t", 0, 0, 152, now - 3_600_000), ("t", 0, 2, 152, now), ("t", 0, 4, 152, now)], f"{PLACE}, base_offset long, bytes long, mtime long")
    assert [r.base_offset for r in retention.retain(s, size, age, now).orderBy("base_offset").collect()] == want


def test_segments_and_anchors(spark):
    rng = random.Random(1)
    sizes = [rng.randrange(1, 90) for _ in range(200)]
    b = spark.createDataFrame([("t", 0, k, s) for k, s in enumerate(sizes)], f"{PLACE}, base_offset long, bytes long")
    seg = used = since = 0
    want, anchors = {}, []
    for k, s in enumerate(sizes):
        if used and used >= 200:
            seg, used = seg + 1, 0
        used += s
        want[k] = seg
        if since >= 300:
            anchors.append(k)
            since = 0
        since += s
    assert {r.base_offset: r.segment for r in write.greedy_segments(b, 200).collect()} == want
    assert sorted(r.anchor for r in write.index_anchors(b, 300).collect()) == anchors
    assert write.index_anchors(b, 0).count() == len(sizes)


def test_byte_budget_overshoots_by_one_batch(spark):
    rows = [("t", 0, o, o - o % 2, 50) for o in range(12)]
    df = spark.createDataFrame(rows, f"{PLACE}, offset long, base_offset long, encoded_size long")
    ask = spark.createDataFrame([("t", 0, 3, 250)], f"{PLACE}, fetch_offset long, max_bytes long")
    assert sorted(r.base_offset for r in read.byte_budget(df, ask).collect()) == [2, 4, 6]
    at = spark.createDataFrame([("t", 0, 3), ], f"{PLACE}, position long")
    assert tuple(read.poll(df, at, 250).first())[2:] == (3, 6, 8)


def test_floor_lookup(spark):
    p = spark.createDataFrame([("t", 0, o) for o in (0, 5, 9, 100)], f"{PLACE}, offset long")
    a = spark.createDataFrame([("t", 0, s) for s in (5, 10)], f"{PLACE}, base long")
    assert {r.offset: r.base for r in read.floor_lookup(p, a, ["topic", "partition"], "offset", "base").collect()} == {0: None, 5: 5, 9: 5, 100: 10}


def test_percentiles_and_histogram(spark):
    df = spark.range(1, 101).select(F.lit("x").alias("s"), F.col("id").alias("v"))
    got = {r.p: r.value for r in metrics.percentiles(metrics.latency_buckets(df, ["s"], "v"), ["s"], [50.0, 99.0, 100.0]).collect()}
    assert got == {50.0: 50, 99.0: 99, 100.0: 100}
    big = spark.createDataFrame([("x", 1_000_000)] * 10, "s string, v long")
    low = metrics.percentiles(metrics.latency_buckets(big, ["s"], "v"), ["s"], [50.0]).first().value
    assert 1_000_000 * (1 - 1 / 64) <= low <= 1_000_000
    h = metrics.histogram(spark.createDataFrame([("x", v) for v in (0.5, 3.0, 7.0, 50.0)], "s string, v double"), ["s"], "v", [1.0, 5.0, 10.0])
    assert [(r.bucket, r["count"], r["sum"]) for r in h.orderBy("le").collect()] == [(1, 4, 60.5), (2, 4, 60.5), (3, 4, 60.5), (4, 4, 60.5)]


def test_groups():
    step = groups.join_group
    s, r = step(None, {"op": "join", "group": "grp", "now": 0, "timeout": 30})
    assert r == "joined:grp-1:1:grp-1" and s["state"] == groups.COMPLETING
    s, r = step(s, {"op": "sync", "member": "grp-1", "generation": 1, "now": 1, "assignments": {"grp-1": "a", "x": "b"}})
    assert r == "synced:a" and s["state"] == groups.STABLE
    s, r = step(s, {"op": "join", "now": 2, "timeout": 30})
    assert r.startswith("joined:grp-2:1") and s["state"] == groups.PREPARING
    s, r = step(s, {"op": "join", "member": "grp-1", "now": 3, "timeout": 30})
    assert s["generation"] == 2 and s["leader"] == "grp-2"
    s, r = step(s, {"op": "heartbeat", "member": "grp-1", "generation": 2, "now": 20})
    assert r == "rebalance_in_progress"
    s, r = step(s, {"op": "tick", "now": 33})
    assert r == "expired:1" and list(s["members"]) == ["grp-1"] and s["state"] == groups.PREPARING
    s, r = step(s, {"op": "leave", "member": "grp-1", "now": 34})
    assert s["state"] == groups.EMPTY
    assert step(s, {"op": "heartbeat", "member": "nobody", "generation": 1, "now": 35})[1] == "unknown_member"


def test_coordinator():
    step = txn.coordinate
    s, r = step(None, {"op": "init", "new_id": 10})
    assert r == "ok:10:0"
    s, _ = step(s, {"op": "begin", "epoch": 0, "now": 0})
    assert step(s, {"op": "begin", "epoch": 0, "now": 1})[1] == "invalid"
    for p in (("payments", 1), ("orders", 0), ("orders", 0)):
        s, _ = step(s, {"op": "add", "epoch": 0, "now": 2, "part": p})
    assert s["parts"] == [("orders", 0), ("payments", 1)]
    c, _ = step(s, {"op": "commit", "epoch": 0, "now": 3})
    assert c["state"] == txn.PREPARE_COMMIT and c["unacked"] == c["parts"]
    for p in (("orders", 0), ("orders", 0), ("payments", 1)):
        c, _ = step(c, {"op": "ack", "epoch": 0, "part": p})
    assert c["state"] == txn.COMPLETE_COMMIT
    assert step(s, {"op": "tick", "now": 62, "timeout": 60})[1] == "ok" and step(s, {"op": "tick", "now": 63, "timeout": 60})[1] == "aborted"
    z, r = step(s, {"op": "init", "new_id": 11})
    assert r == "ok:10:1" and z["state"] == txn.PREPARE_ABORT
    assert step(z, {"op": "commit", "epoch": 0, "now": 4})[1] == "fenced"
    assert step(z, {"op": "begin", "epoch": 1, "now": 4})[1] == "ok"
    assert step({**s, "epoch": txn.MAX_EPOCH}, {"op": "init", "new_id": 11})[1] == "ok:11:0"


def test_resilience(spark):
    s, out = None, []
    for now in (0, 0, 0, 500_000, 1_000_000):
        s, ok = resilience.token_bucket(s, {"now": now}, 1.0, 2)
        out.append(ok)
    assert out == [True, True, False, False, True]
    s = None
    for k in range(11):  # the tenth result is a success, which opens nothing
        s, r = resilience.circuit_breaker(s, {"now": k, "failed": k % 2 == 0})
    assert r == "Open" and resilience.circuit_breaker(s, {"now": 11, "failed": False})[1] == "rejected"
    for n, want in enumerate(("HalfOpen", "HalfOpen", "Closed")):
        t, r = resilience.circuit_breaker(s if n == 0 else t, {"now": 6_000_000 + n, "failed": False})
        assert r == want
    assert resilience.circuit_breaker(s, {"now": 6_000_000, "failed": True})[1] == "Open"
    s, seen = None, []
    for failed in (True, True, True, False, False):
        s, up = resilience.health(s, {"failed": failed})
        seen.append(up)
    assert seen == [True, True, False, False, True]
    df = spark.createDataFrame([("a", k, k % 3 == 0) for k in range(50)] + [("b", k, True) for k in range(3)], "k string, n long, failed boolean")
    got = resilience.fold(df.repartition(3), ["k"], "n", resilience.health, "boolean").where("k = 'b'").orderBy("n").collect()
    assert [r.result for r in got] == [True, True, False]
    assert resilience.credit_window({"credit": 3}, {"op": "acquire", "cost": 4}, 10)[1] is False


def test_quorum(spark):
    rows = [("t", 0, n, n < 3, m, 5, c) for n, m, c in ((0, 9, 5), (1, 7, 5), (2, 4, 5), (3, 99, 5))]
    df = spark.createDataFrame(rows, f"{PLACE}, node int, is_voter boolean, match_index long, entry_term long, current_term long")
    assert quorum.commit_index(df).first().commit_index == 7
    assert quorum.commit_index(df.withColumn("current_term", F.lit(6).cast("long"))).first().commit_index is None


def test_placement(spark):
    nodes = ["n1", "n2", "n3"]
    points = placement.ring(nodes)
    keys = [str(k) for k in range(300)]
    got = {r.k: r.node for r in placement.consistent_hash(spark.createDataFrame([(k,) for k in keys], "k string"), "k", nodes).collect()}
    for k in keys:
        h = hashes.fnv1a_64_int(k.encode())
        assert got[k] == next((n for p, n in points if p >= h), points[0][1])
    less = {r.k: r.node for r in placement.consistent_hash(spark.createDataFrame([(k,) for k in keys], "k string"), "k", nodes[:2]).collect()}
    assert all(less[k] == got[k] for k in keys if got[k] != "n3")
    assert placement.assign_least({"b": 0, "a": 0}, [("open", None), ("open", None), ("close", "a"), ("open", None)]) == ["a", "b", "a"]


def test_hashes(spark):
    df = spark.createDataFrame([("123456789",), ("",), (None,)], "s string")
    got = [tuple(r) for r in df.select(hashes.crc32c(F.col("s")), hashes.fnv1a_64(F.col("s"))).collect()]
    assert got[0][0] == 0xE3069283 and got[1] == (0, 0xCBF29CE484222325) and got[2] == (None, None)
    assert hashes.fnv1a_64_int(b"a") == 0xAF63DC4C8601EC8C
    okm = hashes.hkdf_sha256(b"\x0b" * 22, bytes(range(13)), bytes(range(0xF0, 0xFA)), 42)
    assert okm.hex().startswith("3cb25f25faacd57a90434f64d0362f2a")


def test_jwt():
    import base64
    import hashlib
    import hmac
    import json

    def make(claims, alg="HS256", key=b"k"):
        part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).rstrip(b"=").decode()
        head = f"{part({'alg': alg})}.{part(claims)}"
        return head + "." + base64.urlsafe_b64encode(hmac.new(key, head.encode(), hashlib.sha256).digest()).rstrip(b"=").decode()

    good = {"sub": "me", "exp": 100, "roles": ["admin"], "iss": "i", "aud": ["a", "b"]}
    assert hashes.verify_jwt(make(good), b"k", 50, issuer="i", audience="b") == {"error": None, "subject": "me", "roles": ["admin"]}
    why = lambda t, now=50, **o: hashes.verify_jwt(t, b"k", now, **o)["error"]
    assert why(make(good), 101) == "expired" and why(make({"sub": "x"})) == "expired"
    assert why(make(good, key=b"other")) == "signature" and why(make(good, alg="none")) == "algorithm" and why("a.b") == "malformed" and why(None) == "malformed"
    assert why(make({**good, "nbf": 60})) == "not_yet_valid" and why(make({**good, "iat": 60})) == "issued_later"
    assert why(make(good), issuer="j") == "issuer" and why(make(good), audience="c") == "audience"


def test_records_round_trip_and_tampering():
    rng = random.Random(3)
    for n in (0, 1, -1, 63, -64, 64, 2**31, -(2**63), 2**63 - 1):
        assert records.get_varint(records.put_varint(n), 0)[0] == n
    rows = [(None if rng.random() < 0.2 else rng.randbytes(rng.randrange(20)), None if rng.random() < 0.2 else rng.randbytes(rng.randrange(60)), [("h", None), ("h", b"x")][: rng.randrange(3)]) for _ in range(50)]
    encoded = [records.encode_record(k, v, h, ts_delta=-5, offset_delta=j) for j, (k, v, h) in enumerate(rows)]
    for codec in ("none", "lz4", "zstd"):
        raw = records.encode_batch(7, encoded, codec) + records.encode_batch(57, encoded, codec)
        found = records.scan_batches(raw)
        assert [h["base_offset"] for h, _ in found] == [7, 57]
        head, payload = found[0]
        got = records.decode_records(records.decompress(payload, records.CODECS[head["attrs"] & 3]), head["record_count"])
        assert [(k, v, h) for _, _, k, v, h in got] == rows and [o for _, o, *_ in got] == list(range(50))
        assert len(records.scan_batches(raw[:-3])) == 1
        for at in range(16, len(raw) // 2, 97):
            bad = bytearray(raw)
            bad[at] ^= 1
            assert len(records.scan_batches(bytes(bad))) == 0
    with pytest.raises(ValueError):
        records.decode_records(b"".join(encoded)[:-1], 50)


def test_segments_as_files(spark, small, tmp_path):
    from loglake.model import event_log
    from loglake.sources.logfile import read_segments, write_segments

    own = event_log(spark, small).select("topic", "partition", "offset", "base_offset", "key", "value")
    write_segments(own, str(tmp_path / "log"), segment_bytes=4096)
    back = read_segments(spark, str(tmp_path / "log"))
    want = sorted(map(tuple, own.collect()), key=lambda r: r[1:3])
    got = sorted(((r.topic, r.partition, r.offset, r.base_offset, r.key.decode(), r.value and r.value.decode()) for r in back.collect()), key=lambda r: r[1:3])
    assert got == want


def test_compressed_blocks():
    data = b"abcd" * 5000 + random.Random(5).randbytes(300)
    for codec in ("lz4", "zstd"):
        for plain in (b"", b"x", data):
            packed = records.compress(plain, codec)
            assert packed[:4] == len(plain).to_bytes(4, "little") and records.decompress(packed, codec) == plain
        packed = records.compress(data, codec)
        size = len(data)
        for bad in (packed[:3], packed[:-5], (size + 9).to_bytes(4, "little") + packed[4:], (size - 1).to_bytes(4, "little") + packed[4:], (records.MAX_BYTES + 1).to_bytes(4, "little") + packed[4:]):
            with pytest.raises(ValueError):
                records.decompress(bad, codec)
    # a block written by hand: four literals, then a match of eight at a distance of four, then five literals
    block = bytes([0x44]) + b"abcd" + bytes([4, 0, 0x50]) + b"vwxyz"
    assert records.decompress(struct.pack("<I", 17) + block, "lz4") == b"abcdabcdabcdvwxyz"
    with pytest.raises(ValueError):
        records.decompress(data, "gzip")


def test_segments_keep_the_envelope(spark, tmp_path):
    from loglake.sources.logfile import read_segments, write_segments

    schema = f"{PLACE}, offset long, base_offset long, key binary, value binary, is_txn boolean, is_control boolean, producer_id long, producer_epoch short, base_sequence int, ts_delta long"
    rows = [("t", 0, 0, 0, b"a", b"x", True, False, 7, 1, 0, 0), ("t", 0, 1, 0, b"b", None, True, False, 7, 1, 0, 5), ("t", 0, 2, 2, None, b"m", True, True, 7, 1, -1, 0)]
    rows += [("t", 0, 3, 3, b"c", b"y", None, None, None, None, None, None), ("t", 0, 4, 3, b"d", b"z", False, False, 8, 0, 4, 2), ("t", 1, 0, 0, b"a", b"x", False, False, 9, 2, 0, 0)]
    path = str(tmp_path / "log")
    write_segments(spark.createDataFrame(rows, schema), path, codec="lz4")
    got = read_segments(spark, path).select("topic", "partition", "offset", "base_offset", "key", "value", "is_txn", "is_control", "producer_id", "producer_epoch", "base_sequence", "ts_delta")
    want = [*rows[:3], (*rows[3][:6], False, False, -1, -1, -1, 0), (*rows[4][:3], 4, *rows[4][4:]), rows[5]]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1:3]) == want
    assert sorted(p.name for p in (tmp_path / "log").iterdir()) == ["t"]  # nothing of the job is left


def test_a_failed_job_leaves_no_segment(tmp_path):
    import pyarrow as pa

    from loglake.sources.logfile import SegmentWriter

    writer = SegmentWriter(str(tmp_path))
    batch = pa.RecordBatch.from_pylist([{"topic": "t", "partition": 0, "base_offset": 5, "content": b"x"}])
    one, two = writer.write(iter([batch])), writer.write(iter([batch]))
    writer.abort([one, None])
    assert list(tmp_path.iterdir()) == []
    one, two = writer.write(iter([batch])), writer.write(iter([batch]))  # two attempts; the second is committed
    writer.commit([two])
    assert [str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()] == ["t/0/00000000000000000005.log"]


def test_dead_letters(spark):
    df = spark.createDataFrame([("orders", 3, 7, b"order-42", b"payload", [("orig", b"h")])], f"{PLACE}, offset long, key binary, value binary, headers array<struct<key:string,value:binary>>")
    r = write.dead_letters(df, "orders-dlq", F.lit("boom"), F.lit(5)).first()
    assert r.topic == "orders-dlq" and bytes(r.key) == b"order-42"
    assert [(h.key, bytes(h.value)) for h in r.headers] == [("orig", b"h"), ("x-dlq-topic", b"orders"), ("x-dlq-partition", b"3"), ("x-dlq-offset", b"7"), ("x-dlq-error", b"boom"), ("x-dlq-attempts", b"5")]


def test_offsets_over_many_runs(spark):
    from loglake.model import assign_offsets

    df = spark.range(1000).select(F.lit("t").alias("topic"), (F.col("id") % 3).cast("int").alias("partition"), (F.col("id") * 7).alias("arrival")).repartition(5)
    got = assign_offsets(df, "arrival", run=100).orderBy("arrival").collect()
    seen = {}
    for r in got:
        assert r.offset == seen.get(r.partition, 0)
        seen[r.partition] = r.offset + 1
