"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

Base findings are the matches of three patterns, leftmost and non-overlapping per kind, that are long enough.
Candidates are all maximal runs of ``CANDIDATE`` or more of ``[A-Za-z0-9+/_=.-]``, letters alone included. Each is read
whole with its surrounding context (``LEFT`` characters before, ``RIGHT`` after) by a small network in numpy: learned
character vectors (another set inside the candidate than around it), one convolution, maximum over the candidate and over
the context, logistic output. A candidate longer than ``INSIDE`` is read in overlapping parts of that length, each with the
characters around it, and has the highest of their scores. The network is trained on labelled findings: candidates of a
bounded sample of the documents (``SAMPLE_DOCS``, ``TRAIN_MOST``), labelled by whether a base pattern covers them, and
``SYNTHETIC`` generated ones of other shapes (service keys, signed tokens, random strings after telling words; against
dates, paths, versions, numbers, addresses, identifiers, long words). Scores are calibrated on a fifth that isn't trained on, and the
threshold is the highest at which at least ``RECALL`` of its positives are found; ``Network.held_out`` has the recall and the
share of false findings there. Candidates above it that touch no base finding are added with kind ``model``; base findings
always stay.

Positions are code points, ends exclusive; a match's whole text is its span.

Results for odd input: null and empty texts have no findings; findings that begin at the same place come in the order of
their kinds; rows that repeat are scanned once each; an empty table gives no rows; a null ``doc_id`` is kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.llm.common import load, map_batches

#: Fixed patterns: kind, pattern, least length (of group 2, or of the match).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "model")
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

CANDIDATE = 12
_RUN = re.compile(r"[A-Za-z0-9+/_=.\-]{12,}")
LEFT, INSIDE, RIGHT = 24, 48, 8
#: Characters between the beginnings of a long candidate's parts.
STRIDE = 24
#: Parts that are scored at once.
READ = 4096
SAMPLE_DOCS = 4000
SYNTHETIC = 3000
TRAIN_MOST = 4000
RECALL = 0.98
FILTERS, WIDTH, DIM = 24, 5, 8
#: Printable ASCII; 0 is padding, 1 any other character.
_CODES = 2 + 95


def base_findings(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start, then kind."""
    out = []
    low = text.lower()
    if any(x in low for x in _ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _RUN.finditer(text)]


def parts(start: int, end: int) -> list[tuple[int, int]]:
    """A candidate's parts that are read: itself, or overlapping ones that cover it."""
    if end - start <= INSIDE:
        return [(start, end)]
    return [(a, a + INSIDE) for a in [*range(start, end - INSIDE, STRIDE), end - INSIDE]]


def outside(base: list[tuple[int, int, int]], spans: list[tuple[int, int]]) -> list[bool]:
    """Whether each of ``spans`` (in order, disjoint) touches no base finding (by start)."""
    out, k, reach = [], 0, 0  # reach: the greatest end of base findings that begin before the span's end
    for a, b in spans:
        while k < len(base) and base[k][0] < b:
            reach = max(reach, base[k][2])
            k += 1
        out.append(reach <= a)
    return out


def window(text: str, start: int, end: int) -> bytes:
    """Character codes around and in a part of at most ``INSIDE``, fixed in length; those inside are shifted by ``_CODES``."""
    inside = text[start:end]
    raw = (text[max(0, start - LEFT) : start].rjust(LEFT, "\0"), inside.ljust(INSIDE, "\0"), text[end : end + RIGHT].ljust(RIGHT, "\0"))
    a, b, c = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for x in raw)
    codes = [np.where(x == 0, 0, np.where((x >= 32) & (x < 127), x - 30, 1)) for x in (a, b, c)]
    codes[1] = np.where(codes[1] > 0, codes[1] + _CODES, 0)
    return np.concatenate(codes).astype(np.uint8).tobytes()


class Network:
    """Character vectors, one convolution, maxima over candidate and context, logistic output."""

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        self.v = r.normal(0, 0.3, (2 * _CODES, DIM)).astype(np.float32)
        self.k = r.normal(0, (WIDTH * DIM) ** -0.5, (WIDTH * DIM, FILTERS)).astype(np.float32)
        self.kb = np.zeros(FILTERS, np.float32)
        self.w = r.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.b = np.zeros(1, np.float32)
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5
        #: recall, and share of negatives found, on the fifth that isn't trained on
        self.held_out = (float("nan"), float("nan"))

    def _forward(self, x: np.ndarray) -> tuple:
        e = self.v[x]
        e[x == 0] = 0
        n, length, _ = e.shape
        cols = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(n, length - WIDTH + 1, WIDTH * DIM)
        a = np.maximum(cols @ self.k + self.kb, 0)
        lo, hi = LEFT - WIDTH // 2, LEFT + INSIDE - WIDTH // 2
        inner = a[:, lo:hi].argmax(1) + lo
        outer_a = np.concatenate([a[:, :lo], a[:, hi:]], 1)
        outer = outer_a.argmax(1)
        outer = np.where(outer >= lo, outer + hi - lo, outer)
        pick = np.concatenate([inner, outer], 1)
        pooled = a[np.arange(n)[:, None], pick, np.tile(np.arange(FILTERS), 2)]
        return cols, pick, pooled, pooled @ self.w + self.b[0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[k : k + 256])[3] for k in range(0, len(x), 256)]) if len(x) else np.zeros(0, np.float32)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -50, 50)))

    def step(self, x: np.ndarray, y: np.ndarray, rate: float) -> None:
        cols, pick, pooled, z = self._forward(x)
        g = ((1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / len(x)).astype(np.float32)
        gp = g[:, None] * self.w * (pooled > 0)
        self.w -= rate * (pooled.T @ g)
        self.b -= rate * g.sum()
        n = len(x)
        taken = cols[np.arange(n)[:, None], pick]  # n, 2 filters, width x dim
        both = gp[:, :FILTERS, None] * taken[:, :FILTERS] + gp[:, FILTERS:, None] * taken[:, FILTERS:]
        back = gp[:, :, None] * np.concatenate([self.k, self.k], 1).T[None]
        self.k -= rate * both.sum(0).T
        self.kb -= rate * (gp[:, :FILTERS] + gp[:, FILTERS:]).sum(0)
        at = pick[:, :, None] + np.arange(WIDTH)
        codes = x[np.arange(n)[:, None, None], at]
        np.subtract.at(self.v, codes.ravel(), rate * back.reshape(-1, DIM))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, rate: float = 0.8, seed: int = 2) -> Network:
        r = np.random.default_rng(seed)
        held = np.arange(len(x)) % 5 == 4
        tx, ty = x[~held], y[~held]
        for e in range(epochs):
            order = r.permutation(len(tx))
            for k in range(0, len(order), 32):
                own = order[k : k + 32]
                self.step(tx[own], ty[own], rate * (1 - e / epochs))
        z, hy = self.logits(x[held]), y[held]
        for _ in range(200):  # Platt's scaling, by gradient
            p = 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -50, 50))) - (hy * 0.98 + 0.01)
            self.scale -= 0.05 * float((p * z).mean())
            self.shift -= 0.2 * float(p.mean())
        p = self.score(x[held])
        good = np.sort(p[hy > 0])
        if len(good):
            self.threshold = float(good[int((1 - RECALL) * len(good))])
            self.held_out = (float((good >= self.threshold).mean()), float((p[hy == 0] >= self.threshold).mean()) if (hy == 0).any() else 0.0)
        return self


def synthetic(n: int, seed: int = 3) -> tuple[list[bytes], list[int]]:
    """Generated labelled findings."""
    r = np.random.default_rng(seed)
    digits, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    some = lambda chars, k: "".join(chars[i] for i in r.integers(0, len(chars), k))
    word = lambda: "".join(some("bcdfglmnprst", 1) + some("aeiou", 1) for _ in range(r.integers(1, 5)))
    every = lower + upper + digits
    telling = ["key", "secret", "credential", "private", "auth", "bearer", "signature", "pwd", "client", "access"]
    good = [
        lambda: "ghp_" + some(every, 36), lambda: "sk_live_" + some(every, 24), lambda: "xoxb-" + some(digits, 11) + "-" + some(every, 24), lambda: "AIza" + some(every + "_-", 35),
        lambda: "eyJ" + some(every, 30) + "." + some(every, 40) + "." + some(every, 30), lambda: some(every + "+/", 40) + "=", lambda: some(every, int(r.integers(20, 44))), lambda: some(digits + "abcdef", int(r.integers(16, 41))), lambda: some(digits + upper, int(r.integers(18, 32))), lambda: some(lower + upper, int(r.integers(20, 44))),
    ]
    bad = [
        lambda: f"20{some(digits, 2)}-{some('01', 1)}{some(digits, 1)}-{some('012', 1)}{some(digits, 1)}T{some(digits, 2)}.{some(digits, 2)}", lambda: "/".join([word(), word(), word() + some(digits, 2)]) + ".html", lambda: ".".join(some(digits, int(r.integers(1, 4))) for _ in range(4)) + "." + some(digits, 3),
        lambda: some(digits, int(r.integers(12, 20))), lambda: word() + word() + word() + some(digits, 1), lambda: word() + some(digits, 1) + ".example." + ["com", "org", "net"][r.integers(3)], lambda: "-".join([some(digits, 3), some(digits, 3), some(digits, 4)]) + "." + some(digits, 2),
        lambda: "_".join([word(), word(), word(), some(digits, 2)]), lambda: "-".join([word(), word(), "v" + some(digits, 1) + "." + some(digits, 1) + "." + some(digits, 1)]) + "-" + word(), lambda: "...." + word() + some(digits, 4) + "====" + word(), lambda: word().upper() + "-" + some(digits, 8) + "-" + some(digits, 3),
        lambda: word() + word() + word() + word(), lambda: (word() + word() + word()).capitalize() + ".", lambda: "_".join([word(), word(), word()]), lambda: "/".join([word(), word(), word(), word()]), lambda: (word() + word() + word() + word()).upper(), lambda: "-=."[r.integers(3)] * int(r.integers(12, 60)), lambda: "..." + word() + "--" + word() + word(),
    ]
    rows, labels = [], []
    for k in range(n):
        y = int(k % 2)
        value = (good if y else bad)[r.integers(len(good if y else bad))]()
        if len(value) < CANDIDATE:
            continue
        lead = " ".join(word() for _ in range(4))
        lead += (" " + telling[r.integers(len(telling))] + [" ", ": ", " = ", ' "'][r.integers(4)]) if r.random() < (0.7 if y else 0.15) else " "
        text = lead + value + [" ", ", ", '" ', "\n"][r.integers(4)] + word()
        own = [window(text, a, b) for a, b in parts(len(lead), len(lead) + len(value))]
        rows += own
        labels += [y] * len(own)
    return rows, labels


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, labels = [], []
        for text in batch.column(0).to_pylist():
            own = candidates(text or "")
            for (a, b), free in zip(own, outside(base_findings(text or ""), own), strict=True):
                got = [window(text, *p) for p in parts(a, b)]
                rows += got
                labels += [int(not free)] * len(got)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(labels, pa.int32())], names=["x", "y"])


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, most: int = TRAIN_MOST, generated: int = SYNTHETIC) -> Network:
    ids = docs.select(F.col("doc_id").cast("long").alias("_id")).where("_id is not null").orderBy(F.xxhash64("_id"), "_id").limit(sample_docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(ids), texts["doc_id"] == ids["_id"], "left_semi").select("text")
    # half for either label: most candidates are plain words
    seen = map_batches(texts, _label, "x binary, y int")
    got = [r for y in (0, 1) for r in seen.where(F.col("y") == y).orderBy(F.xxhash64("x"), "x").limit(most // 2).collect()]
    rows, labels = synthetic(generated)
    rows += [bytes(r["x"]) for r in got]
    labels += [r["y"] for r in got]
    order = np.random.default_rng(4).permutation(len(rows))
    x = np.frombuffer(b"".join(rows[k] for k in order), np.uint8).reshape(len(rows), -1).astype(np.int64)
    return Network().fit(x, np.array(labels, np.float32)[order])


def findings(texts: list[str], net: Network) -> list[tuple[list, list]]:
    """Base findings, and those with the network's added, of each text."""
    base, where, rows = [base_findings(t) for t in texts], [], []
    out = [(x, list(x)) for x in base]
    best: dict[tuple[int, int, int], float] = {}

    def read() -> None:
        x = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1).astype(np.int64)
        for k, q in zip(where, net.score(x).tolist(), strict=True):
            best[k] = max(q, best.get(k, 0.0))
        where.clear(), rows.clear()

    for k, t in enumerate(texts):
        own = candidates(t)
        for (a, b), free in zip(own, outside(base[k], own), strict=True):
            for p in parts(a, b) if free else ():
                where.append((k, a, b))
                rows.append(window(t, *p))
                if len(rows) == READ:
                    read()
    if rows:
        read()
    for (k, a, b), q in best.items():
        if q >= net.threshold:
            out[k][1].append((a, 3, b))
    return [(x, sorted(y)) for x, y in out]


def _scan(batches: Iterator[pa.RecordBatch], net) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            rows = batch.slice(lo, 200)
            got = findings([t or "" for t in rows.column(1).to_pylist()], net.value)
            cols = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in y] for _, y in got]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(cols, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))], names=["doc_id", "findings"])


def scan(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, findings (array of kind, start, end by start and kind) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, lambda b: _scan(b, shared), "doc_id long, findings array<struct<kind:string,start:int,end:int>>")


def digest(spans: list[tuple[int, int, int]]) -> str:
    """SHA-256 of joined base findings, as the query gives it; for tests."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    out = scan(docs, fit(docs))
    joined = lambda xs: f"array_join(transform({xs}, f -> concat_ws(':', f.kind, f.start, f.end)), ',')"
    base = "filter(findings, f -> f.kind <> 'model')"
    count = lambda kind: F.expr(f"cast(size(filter(findings, f -> f.kind = '{kind}')) AS bigint)").alias(f"n_{kind}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.expr(joined(base)), 256).alias("base_sha256"), F.expr(joined("findings")).alias("spans"))
