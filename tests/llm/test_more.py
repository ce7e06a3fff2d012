"""Independent arithmetic of fingerprints and scores, and every pipeline stage on odd input."""

import collections
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from loglake.llm import fingerprints, near_dedup, quality
from tests.llm.test_operators import WORDS, prose

MASK = (1 << 64) - 1


def hash64(*values):
    """The engine's 64-bit hash of some values: each one's hash is the next one's seed."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v & MASK).to_bytes(8, "little"), h)
    return h - (1 << 64) if h >> 63 else h


def syncmers(parts, span, mark):
    out = []
    for k in range(len(parts) - span + 1):
        run = parts[k : k + span]
        if min(run[0], run[-1]) <= min(run[1:-1]):
            out.append((k, hash64(*run) & 0xFFFFFFFE | mark))
    return out


def brute_fingerprint(text):
    words = [hash64(w) for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]
    own = syncmers([hash64(*words[k : k + 2]) for k in range(len(words) - 1)], 4, 0)
    chars = len(own) < 40 or len(own) * 64 < len(text)
    if chars:
        own += syncmers([hash64(text[k : k + 4]) for k in range(len(text) - 3)], 7, 1)
    return chars, own or ([(0, hash64(text) & 0xFFFFFFFE)] if text else [])


def brute_likeness(a, b):
    (ca, x), (cb, y) = a, b
    x, y = ({h for _, h in s if ca == cb or h % 2 == 0} for s in (x, y))
    return 1.0 if not x and not y else len(x & y) / len(x | y) if x and y else 0.0


def test_fingerprints_against_brute_force(spark):
    rng = np.random.default_rng(41)
    texts = ["", "one", "two words", "a b c d e", "\tTabs and\r\nlines \x0b here  ", "日本語の文章はあいだに空白がない。" * 60, "x" * 700, "same " * 300, "é" * 5]
    texts += [prose(rng, int(n)) for n in (10, 60, 90, 200, 900)]
    texts += [texts[-1], " ".join(w if k % 90 else "edit" for k, w in enumerate(texts[-1].split()))]
    df = spark.createDataFrame([*enumerate(texts), (100, None), (None, texts[9])], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in fingerprints.fingerprints(df).collect()}
    want = {k: brute_fingerprint(t) for k, t in enumerate(texts)} | {100: brute_fingerprint(""), None: brute_fingerprint(texts[9])}
    assert got.keys() == want.keys()
    for k, (chars, places) in want.items():
        anchors = sorted({h for _, h in places})
        assert [tuple(p) for p in got[k].places] == places and got[k].anchors == anchors and got[k].anchors_c == chars, k
        assert got[k].fingerprint == ("c" if chars else "w") + "".join(f"{h:08x}" for h in anchors)
    pairs = [(i, j) for i in want for j in want if i is not None and j is not None]
    a, b = (fingerprints.fingerprints(df).where("doc_id is not null").select(F.col("doc_id").alias(n), F.col("anchors").alias(f"{n}x"), F.col("anchors_c").alias(f"{n}x_c")) for n in "ab")
    near = {(r.a, r.b): r.n for r in a.join(b, a["a"] * 0 == b["b"] * 0).select("a", "b", fingerprints.likeness("ax", "bx").alias("n")).collect()}
    assert near.keys() == set(pairs) and all(abs(near[i, j] - brute_likeness(want[i], want[j])) < 1e-12 for i, j in pairs)


def test_op4_on_odd_tables(spark, tmp_path):
    """The query itself: nulls, repeated ids and texts, a very long text, one row, no row."""
    rng = np.random.default_rng(43)
    rows = [(3, "b " * 20000), (1, None), (2, ""), (2, ""), (5, prose(rng, 30)), (5, prose(rng, 40)), (4, "tie"), (6, "tie")]
    for name, own in (("many", rows), ("one", rows[:1]), ("none", [])):
        spark.createDataFrame(own, "doc_id long, text string").withColumn("n_chars", F.lit("clash")).withColumn("next", F.lit(1)).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = fingerprints.op4_fingerprints(spark, f"{tmp_path}/{name}").collect()
        assert collections.Counter((r.doc_id, r.n_chars) for r in out) == collections.Counter((i, len(t or "")) for i, t in own)
        order = sorted(own, key=lambda r: (r[0], hash64(r[1] or "")))
        want = collections.Counter()
        for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
            t, n = t or "", n or ""
            edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
            want[i, round(brute_likeness(brute_fingerprint(t), brute_fingerprint(edited)), 12), round(brute_likeness(brute_fingerprint(t), brute_fingerprint(n)), 12)] += 1
        assert collections.Counter((r.doc_id, round(r.near_edited, 12), round(r.near_next, 12)) for r in out) == want


def brute_score(text, logit, bias, bits=quality.BITS):
    """Word and character n-grams one at a time."""
    m32, p, q, shift = (1 << 32) - 1, 0x9E3779B1, 0x85EBCA77, 32 - bits
    text = (text or "").lower()
    words = [xxhash.xxh3_64_intdigest(w) & m32 for w in text.split()]
    got = [(w * p & m32) >> shift for w in words]
    for a, b in zip(words, words[1:]):
        h = (a * q + b) * p & m32
        h ^= h >> 15
        got.append(((0x51ED270B if a == b else h) * q & m32) >> shift)
    codes = [ord(c) for c in text]
    for n in (2, 3, 4):
        for k in range(len(codes) - n + 1):
            h = codes[k]
            for c in codes[k + 1 : k + n]:
                h = (h * q + c) & m32
            got.append(((h + n) * p & m32) >> shift)
    z = bias + (sum(float(logit[g]) for g in got) / len(got) if got else 0.0)
    return 1 / (1 + np.exp(-z))


def test_quality_against_brute_force(spark):
    rng = np.random.default_rng(47)
    texts = [prose(rng, int(n)) for n in rng.integers(1, 60, 30)] + ["", None, "a", "ab", "same same same", "Ünïcode 日本 \U0001f600 text", "word " * 9000]
    labels = [int(k % 3 > 0) for k in range(len(texts))]
    logit, bias = quality.train([t or "" for t in texts], labels)
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[4])]  # repeats and ties are scored alike
    got = quality.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), (logit, bias)).collect()
    assert len(got) == len(rows)
    want = {k: brute_score(t, logit, bias) for k, t in rows}
    assert all(abs(r.score - want[r.doc_id]) < 1e-6 for r in got)


def test_near_dedup_with_small_blocks_and_several_texts_of_one_document(spark):
    """Buckets taken in many blocks, with no pivots at all, lose nothing; texts of one doc_id are one document."""
    from tests.llm.test_operators import brute_components

    rng = np.random.default_rng(53)
    core = prose(rng, 200).split()
    rows = []
    for k in range(40):
        w = list(core)
        for _ in range(int(rng.integers(0, 12))):
            w[int(rng.integers(0, 200))] = str(rng.choice(WORDS)) + str(rng.integers(9))
        rows.append((k, " ".join(w)))
    want = brute_components(rows, 3, 85)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, block=4, stars=0).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == want
    b, c, d = (prose(rng, 50) for _ in range(3))
    some = spark.createDataFrame([(3, b), (5, c), (5, b), (8, c), (8, c), (9, d), (9, ""), (11, d)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(some, 3, 85).where("n_shingles > 0").collect()} == {(3, 3), (5, 3), (8, 3), (9, 9), (11, 9)}


def test_every_stage_on_odd_input(spark, tmp_path):
    rng = np.random.default_rng(59)
    item = prose(rng, 30)
    long = " ".join(rng.choice(WORDS) for _ in range(20000))
    lines = "\n".join(prose(rng, 12) for _ in range(4))
    rows = [(1, prose(rng, 50)), (2, None), (3, ""), (4, "   "), (5, long), (6, lines), (7, lines + "\nand more"), (8, f"see {item} there"), (8, f"see {item} there"), (None, item), (None, None), (9, prose(rng, 50)), (9, prose(rng, 60)), (10, "tie"), (11, "tie")]
    docs = spark.createDataFrame([(i, t, None if k % 3 else "en", None if k % 2 else "web", len(t) if t else None, 1, "x") for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, id int, th string").repartition(3)
    spark.createDataFrame([(1, 1, 0), (5, 1, 0), (6, 1, 0), (None, 0, None), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item), (1, None), (None, ""), (2, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    given = collections.Counter(rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        if name == "packing":
            used = collections.Counter()
            for r in got:
                used[r.doc_id] += r.length
            assert used[2] == used[3] == 1 and len({r.doc_id for r in got}) == len({i for i, _ in rows})
            continue
        assert out.columns == corpus_pipeline.COLUMNS, name
        kept = collections.Counter((r.doc_id, r.text) for r in got)
        if name == "lines":
            assert len(got) == len(rows) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
            assert kept[7, "and more"] == 1 and kept[6, lines] == 1 and kept[2, None] == 1 and kept[3, ""] == 1
        else:
            assert kept <= given, name
        if name == "quality":
            assert kept == given  # no label says that anything is bad
        if name == "near":
            assert kept[10, "tie"] == 1 and (11, "tie") not in kept and kept[None, item] == kept[None, None] == 1
            assert all(n == 1 for n in collections.Counter(i for i, _ in kept.elements() if i is not None).values()) and {2, 3, 4, 9} <= {i for i, _ in kept}
        if name == "benchmark":
            assert given - kept == collections.Counter({(8, rows[7][1]): 2})
    for stage in stages.values():
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
