"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (seeded by its code point).  An
n-gram's vector binds the vectors of its letters, each permuted (rotated) by
its place; a text's vector is the bundle (sum) of the vectors of its n-grams.
A language's prototype bundles the signs of the vectors of its texts, so all
texts weigh alike whatever their length.  A text gets the language whose
prototype has the largest cosine with it.

Training and prediction run in Arrow batches.  A block of texts (``BLOCK_CHARS``
characters, or one text) becomes a row of symbols; its n-grams are counted and
bound ``STEP`` symbols at a time, each step beginning with the last symbols of the one
before, then a matrix product bundles them.  So a long text is bundled whole, and
memory beyond its symbols is bounded.  Sums are whole numbers, so that results don't
depend on partitioning.  A partition of the training rows gives one row a language; the
prototypes are the only thing that the driver holds: ``dim`` numbers a language, and
more than ``MAX_LANGS`` languages are an error.

Null or letterless texts get ``und`` and score 0.  A null ``lang`` isn't learned
from.  With nothing to learn from, as for an empty table, every text gets ``und``.
Equal cosines go to the language first by code point.  Repeated rows get equal
results; input columns named like a result are replaced, others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm.common import free, held_out, table

UNKNOWN = "und"
DIM = 512
N = 3
BLOCK_CHARS = 1 << 19
STEP = 1 << 18
MAX_LANGS = 1000
_ROWS = 256
_SPACE = 0x20


def _letter(code_point: int, dim: int, seed: int) -> np.ndarray:
    """The vector of a letter, the same in every process."""
    bits = np.random.Generator(np.random.PCG64([seed, code_point])).integers(0, 2, dim, np.int8)
    return 2 * bits - 1


def _ranks(values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and the rank of each; without a sort if values stay under ``limit``."""
    if not len(values) or values.max() >= limit:
        return np.unique(values, return_inverse=True)
    seen = np.flatnonzero(np.bincount(values))
    rank = np.zeros(seen[-1] + 1, np.int32)
    rank[seen] = np.arange(len(seen), dtype=np.int32)
    return seen, rank[values]


class Encoder:
    """Text vectors of ``dim`` whole numbers."""

    def __init__(self, dim: int = DIM, n: int = N, seed: int = 5) -> None:
        self.dim, self.n, self.seed = dim, n, seed

    def _symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points in use (a space first), the rank of each symbol, the text of each.

        Letters are in lower case; a run of other characters is one space; a
        bound, which counts as a space, opens each text and closes the last.
        """
        joined = "\x00".join(texts).lower()
        cps = np.frombuffer(f"\x00{joined}\x00".encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, at = _ranks(cps, 0x110000)
        letters = [int(k) for k in kinds if k and chr(k).isalpha()]
        rank = dict(zip(letters, range(1, len(letters) + 1), strict=True))
        sym = np.array([rank.get(int(k), 0) for k in kinds], np.int32)[at]
        bound = cps == 0
        gap = (sym == 0) & ~bound
        keep = ~gap
        keep[1:] |= gap[1:] & ~gap[:-1]
        return np.array([_SPACE, *letters]), sym[keep], np.cumsum(bound[keep], dtype=np.int32) - 1

    def encode(self, texts: list[str]) -> np.ndarray:
        """A row for each text; all zeros without letters."""
        kinds, at, text = self._symbols(texts)
        base, n = len(kinds), self.n
        out = np.zeros((len(texts), self.dim))
        if base == 1:
            return out
        letters = np.array([_letter(int(k), self.dim, self.seed) for k in kinds])
        placed = [np.roll(letters, n - 1 - i, axis=1) for i in range(n)]
        for lo in range(0, len(at) - n + 1, STEP):
            hi = lo + STEP + n - 1
            self._bundle(out, at[lo:hi], text[lo:hi], placed)
        return out

    def _bundle(self, out: np.ndarray, at: np.ndarray, text: np.ndarray, placed: list[np.ndarray]) -> None:
        """Adds the bound n-grams of a run of symbols to the rows of their texts."""
        n, base, size = self.n, len(placed[0]), len(at) - self.n + 1
        gram = at[:size].astype(np.int64)
        for i in range(1, n):
            gram = gram * base + at[i : size + i]
        # all but the last place in one text; the last may be the bound that follows it
        owner = text[:size]
        use = (owner == text[n - 2 : n - 2 + size]) & (gram > 0)
        gram, owner = gram[use], owner[use]
        if not len(gram):
            return
        first, m = owner[0], owner[-1] - owner[0] + 1
        owner = owner - first
        grams, col = _ranks(gram, 1 << 21)
        for lo in range(0, len(grams), 8192):
            part = grams[lo : lo + 8192]
            bound = placed[-1][part % base]
            for i in range(n - 1):
                bound = bound * placed[i][part // base ** (n - 1 - i) % base]
            at_, own = (col, owner) if len(grams) <= 8192 else (col[(sel := (col >= lo) & (col < lo + 8192))] - lo, owner[sel])
            counts = np.bincount(own * np.int64(len(part)) + at_, minlength=m * len(part)).reshape(m, len(part))
            # sums of at most STEP ones are exact in single precision
            out[first : first + m] += counts.astype(np.float32) @ bound.astype(np.float32)


def vectors(encoder: Encoder, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Runs of texts with their vectors; a text over ``BLOCK_CHARS`` is a run of its own."""
    clean = [(x or "").replace("\x00", " ") for x in texts]
    lo, size = 0, 0
    for i, t in enumerate([*clean, None]):
        if i > lo and (t is None or size + len(t) > BLOCK_CHARS or i - lo >= _ROWS):
            yield lo, i, encoder.encode(clean[lo:i])
            lo, size = i, 0
        size += len(t or "")


def learn(docs: DataFrame, encoder: Encoder | None = None) -> tuple[list[str], np.ndarray]:
    """Languages by code point, and their prototypes, from rows with a language."""
    encoder = encoder or Encoder()

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            langs = pdf["lang"].to_numpy()
            for lo, hi, vec in vectors(encoder, pdf["text"].tolist()):
                signs = np.sign(vec).astype(np.int64)
                for lang in set(langs[lo:hi]):
                    got = signs[langs[lo:hi] == lang].sum(axis=0)
                    sums[lang] = sums.get(lang, 0) + got
        if sums:
            yield pd.DataFrame({"lang": list(sums), "sums": [v.tolist() for v in sums.values()]})

    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    parts = rows.mapInPandas(bundle, T.StructType([T.StructField("lang", T.StringType()), T.StructField("sums", T.ArrayType(T.LongType()))]))
    total = parts.select("lang", F.posexplode("sums")).groupBy("lang", "pos").agg(F.sum("col").alias("s"))
    found = total.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("v")).limit(MAX_LANGS + 1).collect()
    if len(found) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages to learn")
    found = sorted(found, key=lambda r: r["lang"])
    proto = np.array([[x["s"] for x in r["v"]] for r in found], float).reshape(len(found), encoder.dim)
    return [r["lang"] for r in found], proto


def identify(docs: DataFrame, langs: list[str], prototypes: np.ndarray, encoder: Encoder | None = None) -> DataFrame:
    """The rows of ``docs`` with ``lang_pred`` and ``score`` (the cosine, 0 to 1)."""
    encoder = encoder or Encoder()
    norms = np.linalg.norm(prototypes, axis=1)
    unit = prototypes / np.where(norms > 0, norms, 1)[:, None]

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(col: pd.Series) -> pd.DataFrame:
        pred = np.full(len(col), UNKNOWN, object)
        score = np.zeros(len(col))
        for lo, _, vec in vectors(encoder, col.tolist()):
            norm = np.linalg.norm(vec, axis=1)
            known = np.flatnonzero(norm > 0)
            if len(langs) and len(known):
                cos = np.round(vec[known] @ unit.T / norm[known, None], 9)
                best = cos.argmax(axis=1)
                pred[lo + known] = np.array(langs, object)[best]
                score[lo + known] = np.clip(cos[np.arange(len(best)), best], 0, 1)
        return pd.DataFrame({"lang_pred": pred, "score": score})

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    (name,) = free([*docs.columns, "lang_pred", "score"], "found")
    return docs.select(*kept, predict("text").alias(name)).select(*kept, F.col(f"{name}.lang_pred"), F.col(f"{name}.score"))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, proto = learn(docs.filter(~held_out()))
    found = identify(docs.select("doc_id", "text"), langs, proto)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
