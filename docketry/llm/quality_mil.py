"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  A passage is described by its words
(hashed to ``WORDS`` signed buckets), by its letter trigrams (``GRAMS`` buckets), both
without case, and by counts (letter case, symbols, repeats, ...).  A learned layer encodes that;
gated attention (tanh times sigmoid) weighs the passages, and the weighted passage gives
the score.  Only documents carry labels, so the attention learns which passages decide.

The model is fitted on the driver with numpy on a bounded sample, whatever the input's
size: of the labelled documents at most ``max_train``, those with the smallest hash of their
id, and of these in that order as many as have ``max_passages`` passages in all.  Every
passage of every document is scored, in Arrow batches; a block of texts (``BLOCK_CHARS``,
or one text) is in memory at a time.

Nulls: null and empty texts are one passage without words.  Null labels are not
learned from; of several labels of one document the largest counts, of several texts the
first by code point.  Without two kinds of label every score is the mean label (0.5
without labels, as for empty tables).  Very long texts are scored whole.  Repeated rows get equal
scores.  Input columns named like a result are replaced, others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm.common import held_out, stored, table

PASSAGE = 64
MAX_TRAIN = 3000
MAX_PASSAGES = 60_000
BLOCK_CHARS = 1 << 18
WORDS, GRAMS = 128, 128
THRESHOLD = 0.3
#: Pull of the weights to zero.
DECAY = 1e-4
DAMPED = 4.0
_SPACES = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"
_ENDS = ".!?"
N_COUNTS = 13
N_FEATURES = N_COUNTS + WORDS + GRAMS
_MIX, _MORE, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _distinct(pid: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of each passage."""
    order = np.lexsort((value, pid))
    p, v = pid[order], value[order]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (v[1:] != v[:-1])
    return np.bincount(p[new], minlength=n)


def _buckets(hashed: np.ndarray, pid: np.ndarray, n: int, width: int) -> np.ndarray:
    """Signed counts of hashes in ``width`` buckets (a power of two), for each of ``n`` passages."""
    h = (hashed ^ (hashed >> np.uint64(29))) * _LAST
    h ^= h >> np.uint64(32)
    at = pid * np.int64(width) + (h & np.uint64(width - 1)).astype(np.int64)
    sign = 1.0 - 2.0 * ((h >> np.uint64(40)) & np.uint64(1)).astype(np.float64)
    return np.bincount(at, sign, n * width).reshape(n, width)


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage, and how many passages each text has (one at least)."""
    joined = "\x00".join(texts)
    cps = np.frombuffer(f"{joined}\x00".encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.flatnonzero(np.bincount(cps))
    chars = [chr(k) for k in kinds]
    flag = np.zeros((6, kinds[-1] + 1), bool)
    for row, test in zip(flag, (lambda c: c in _SPACES or c == "\x00", str.isupper, str.isalpha, str.isdigit, lambda c: c in _SYMBOLS, lambda c: c == "!"), strict=True):
        row[kinds] = [test(c) for c in chars]
    space = flag[0][cps]
    start = ~space
    start[1:] &= space[:-1]
    first = np.flatnonzero(start)
    n_text = len(texts)
    if not len(first):
        return np.zeros((n_text, N_FEATURES)), np.ones(n_text, np.int64)
    text = np.cumsum(cps == 0)[first]
    size = np.bincount(np.cumsum(start)[~space] - 1, minlength=len(first))
    own = np.repeat(np.arange(len(first)), size)
    flat = cps[~space]
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    power = np.cumprod(np.full(64, _MIX, np.uint64))
    h = np.add.reduceat((flat.astype(np.uint64) + np.uint64(7)) * power[place & 63], np.cumsum(size) - size)
    lower = np.zeros(kinds[-1] + 1, np.uint64)
    lower[kinds] = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in chars]
    low = lower[flat] + np.uint64(7)
    h_low = np.add.reduceat(low * power[place & 63], np.cumsum(size) - size)
    in_text = np.arange(len(first)) - np.searchsorted(text, text)
    begin = np.ones(len(first), bool)
    begin[1:] = (text[1:] != text[:-1]) | (in_text[1:] % PASSAGE == 0)
    pid = np.cumsum(begin) - 1
    n = pid[-1] + 1
    per_char = pid[own]
    count = lambda mask, of: np.bincount(of[mask], minlength=n)
    words = np.bincount(pid, minlength=n)
    letters = np.maximum(np.bincount(per_char, minlength=n), 1)
    last = cps[first + size - 1]
    again = np.zeros(len(first), bool)
    again[1:] = (h[1:] == h[:-1]) & (pid[1:] == pid[:-1])
    pair = np.zeros(len(first), np.uint64)
    pair[1:] = h[1:] * _MORE + h[:-1]
    lines = np.flatnonzero(cps == 10)
    line_of = np.minimum(np.searchsorted(first, lines), len(first) - 1)
    rows = np.column_stack([
        count(flag[1][flat], per_char) / letters, count(flag[2][flat], per_char) / letters, count(flag[3][flat], per_char) / letters,
        count(flag[4][flat], per_char) / words, count(flag[5][flat], per_char) / words, letters / words / 10,
        _distinct(pid, h, n) / words, _distinct(pid, pair, n) / words, count(again, pid) / words,
        np.bincount(pid[line_of], minlength=n) / words, count(np.isin(last, [ord(c) for c in _ENDS]), pid) / words,
        count(size == 1, pid) / words, np.log1p(words) / 4,
    ])
    inner = np.flatnonzero(own[2:] == own[:-2])
    grams = (low[inner] * _MIX + low[inner + 1]) * _MORE + low[inner + 2] * _LAST
    root = np.sqrt(words)[:, None]
    rows = np.column_stack([rows, _buckets(h_low, pid, n, WORDS) / root, _buckets(grams, per_char[inner], n, GRAMS) / root / 2])
    text_of = text[begin]
    has = np.bincount(text_of, minlength=n_text)
    out = np.zeros((len(rows) + (has == 0).sum(), N_FEATURES))
    each = np.maximum(has, 1)
    ends = np.cumsum(each) - each
    out[np.repeat(ends, has) + np.arange(len(rows)) - np.repeat(np.cumsum(has) - has, has)] = rows
    return out, each


def _blocks(texts: list[str | None]) -> Iterator[list[str]]:
    clean = [(t or "").replace("\x00", " ") for t in texts]
    lo, size = 0, 0
    for i, t in enumerate(clean):
        if i > lo and size + len(t) > BLOCK_CHARS:
            yield clean[lo:i]
            lo, size = i, 0
        size += len(t)
    if clean:
        yield clean[lo:]


@dataclass
class Model:
    """Encoder (W, b), gates (V, U, w), output (c, d); or one constant."""

    mean: np.ndarray
    std: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def _forward(self, x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        begin = np.cumsum(bags) - bags
        bag = np.repeat(np.arange(len(bags)), bags)
        a = np.exp(e - np.maximum.reduceat(e, begin)[bag])
        a /= np.add.reduceat(a, begin)[bag]
        z = np.add.reduceat(a[:, None] * h, begin)
        out = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "out": out, "bag": bag, "begin": begin}

    def score(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bags), self.constant)
        return self._forward((x - self.mean) / self.std, bags)["out"]

    def gradient(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over documents, by each weight; ``x`` is standardised."""
        p, f = self.weights, self._forward(x, bags)
        h, t, s, a, z, bag, begin = (f[k] for k in ("h", "t", "s", "a", "z", "bag", "begin"))
        do = (f["out"] - y) / len(y)
        dz = do[:, None] * p["c"]
        da = (dz[bag] * h).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, begin)[bag])
        dt = de[:, None] * s * p["w"] * (1 - t * t)
        ds = de[:, None] * t * p["w"] * s * (1 - s)
        dh = (a[:, None] * dz[bag] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ do, "d": do.sum()}

    @classmethod
    def fit(
        cls, x: np.ndarray, bags: np.ndarray, y: np.ndarray, hidden: int = 16, gate: int = 8, steps: int = 250, seed: int = 3, decay: float = DECAY, damped: float = DAMPED
    ) -> Model:
        """The buckets, many and sparse, count 1 / ``damped`` of a count."""
        if len(set(y.tolist())) < 2:
            return cls(np.zeros(0), np.ones(0), {}, float(y.mean()) if len(y) else 0.5)
        rng = np.random.default_rng(seed)
        shapes = {"W": (x.shape[1], hidden), "b": (hidden,), "V": (hidden, gate), "U": (hidden, gate), "w": (gate,), "c": (hidden,), "d": ()}
        p = {k: rng.normal(0, min(0.3, v[0] ** -0.5), v) if v else np.zeros(()) for k, v in shapes.items()}
        weight = np.where(np.arange(x.shape[1]) < N_COUNTS, 1.0, damped)
        model = cls(x.mean(axis=0), (x.std(axis=0) + 1e-6) * weight, p)
        x = (x - model.mean) / model.std
        m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            for k, g in model.gradient(x, bags, y).items():
                g = g + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                p[k] = p[k] - 0.03 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return model


def learn(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_passages: int = MAX_PASSAGES) -> Model:
    """A model of ``labels.quality`` from at most ``max_train`` labelled documents with ``max_passages`` passages in all."""
    spark = docs.sparkSession
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[bytes] = []
            for block in _blocks(pdf["text"].tolist()):
                x, each = passages(block)
                rows += [part.astype(np.float32).tobytes() for part in np.split(x, np.cumsum(each)[:-1])]
            n = [len(r) // (4 * N_FEATURES) for r in rows]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "n": n, "x": rows})

    picked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    got = stored(picked.mapInPandas(features, "doc_id long, y int, n long, x binary"), "bags")
    order = got.select("doc_id", "n").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    total, chosen = 0, []
    for r in order:
        if total + r["n"] <= max_passages:
            total += r["n"]
            chosen.append((r["doc_id"],))
    used = got.join(F.broadcast(spark.createDataFrame(chosen, "doc_id long")), "doc_id").collect()
    used.sort(key=lambda r: r["doc_id"])
    x = np.frombuffer(b"".join(r["x"] for r in used), np.float32).reshape(-1, N_FEATURES).astype(np.float64)
    return Model.fit(x, np.array([r["n"] for r in used], np.int64), np.array([float(r["y"]) for r in used]))


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with ``score``, 0 to 1."""

    @F.pandas_udf(T.DoubleType())
    def run(col: pd.Series) -> pd.Series:
        parts = [model.score(*passages(block)) for block in _blocks(col.tolist())]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn("score", run("text"))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn(docs, labels.filter(~held_out()))
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
