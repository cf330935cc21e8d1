"""Periodic runs of words, by seeds that are extended along diagonals.

A run is a maximal stretch of words with smallest period q and a length of at least
``LEAST`` words and ``TIMES`` periods.  Words q apart are equal all along it, so it holds
two overlapping copies of a stretch of ``length - q`` words.  Lags are taken in classes: for lags
from ``a`` on, k is the least such overlap that a run can have, and the class goes up to lag
k.  The k-grams of every text are indexed; each occurrence is paired with the next
one of its text if that is a lag of the class away.  Inside a run no k-gram recurs
sooner than after q words (else its words had a smaller period, as k is q at least), so the
next occurrence is the one that a run needs, and no other pairs are made.  A pair is a seed of the
diagonal of its lag, and is extended both ways word by word.  A table of the furthest word covered a lag
tells seeds that lie on a diagonal already extended; they are passed over.

The index of a class takes only words where the k-gram of the class before recurs, and only texts
with enough of them for a run.  k-grams are told apart by 64-bit hashes, extension compares the words
themselves.  Work is n log n in the words of a text for each class that finds such places; there are
as many classes as powers of three in the longest text.

Words are what is between spaces, tabs, line ends, vertical tabs and form feeds.  Null and
empty texts have no runs.  Long texts are taken whole, a text is in one task.  Repeated rows each get their
result; an empty table gives an empty one.  Other columns are kept unless named like a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm.common import free, let, table, words
from docketry.llm.spans import WORD_BYTES, runs_of_rows, split_words

LEAST, TIMES = 6, 4
#: Bytes of texts that a task works on at a time, unless one text is longer.
RUN_BYTES = 1 << 22
RESULTS = ("n_words", "runs", "collapsed")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def lag_classes(longest: int) -> Iterator[tuple[int, int, int]]:
    """``first, last`` lag and k of the classes for texts of up to ``longest`` words."""
    first = 1
    while max(LEAST, TIMES * first) <= longest:
        k = min(max(LEAST, TIMES * q) - q for q in range(first, max(first, LEAST) + 1))
        yield first, k, k
        first = k + 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


class _Grams:
    """Hashes of k-grams from those of half the length; a gram past the end of its text is of no use."""

    def __init__(self, codes: np.ndarray, doc: np.ndarray):
        self.size = 1
        self.h = _mixed(_mixed(codes.astype(np.uint64) + np.uint64(1)) + doc.astype(np.uint64) * _MIX)

    def at(self, places: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the grams of ``k`` words there; k never shrinks from call to call."""
        while 2 * self.size <= k:
            later = np.zeros_like(self.h)
            later[: -self.size] = self.h[self.size :]
            self.h = _mixed(self.h * np.uint64(3) + _mixed(later))
            self.size *= 2
        return _mixed(self.h[places] * np.uint64(5) + _mixed(self.h[places + (k - self.size)]))


def _forward(x: np.ndarray, i: int, q: int, end: int) -> int:
    """The first place from ``i`` on where the word ``q`` later differs, or is past the end."""
    step = 32
    while i + q < end:
        stop = min(i + step, end - q)
        differ = np.flatnonzero(x[i:stop] != x[i + q : stop + q])
        if len(differ):
            return i + int(differ[0])
        i, step = stop, 2 * step
    return i


def _backward(x: np.ndarray, i: int, q: int, begin: int) -> int:
    """The first place of the equal words that end before ``i``."""
    step = 32
    while i > begin:
        start = max(begin, i - step)
        differ = np.flatnonzero(x[start:i] != x[start + q : i + q])
        if len(differ):
            return start + int(differ[-1]) + 1
        i, step = start, 2 * step
    return i


def find_runs(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``text, start, length, period`` of all runs, in order; words as numbers, texts one after the other."""
    found = []
    texts, base = np.arange(len(offsets) - 1), offsets
    places, grams = None, None
    for first, last, k in lag_classes(int(np.diff(offsets).max(initial=0))):
        size = np.diff(base)
        if places is None:
            doc = np.repeat(np.arange(len(size)), size)
            grams, places = _Grams(codes, doc), np.arange(len(codes))
        places = places[places + k <= base[doc[places] + 1]]
        if not len(places):
            break
        # the next occurrence in the same text; texts differ in all their hashes
        hashes = grams.at(places, k)
        order = np.argsort(hashes, kind="stable")
        same = (hashes[order[1:]] == hashes[order[:-1]]) & (doc[places[order[1:]]] == doc[places[order[:-1]]])
        here, there = places[order[:-1][same]], places[order[1:][same]]
        lag = there - here
        seeds = (first <= lag) & (lag <= last)
        at, lags = here[seeds], lag[seeds]
        # a seed right behind another of its lag is on the same diagonal
        by_lag = np.lexsort((at, lags))
        at, lags = at[by_lag], lags[by_lag]
        heads = np.ones(len(at), bool)
        heads[1:] = (lags[1:] != lags[:-1]) | (at[1:] != at[:-1] + 1)
        furthest: dict[int, int] = {}
        for i, q in zip(at[heads].tolist(), lags[heads].tolist(), strict=True):
            if i < furthest.get(q, -1):
                continue
            d = int(doc[i])
            begin, end = int(base[d]), int(base[d + 1])
            left, right = _backward(codes, i, q, begin), _forward(codes, i, q, end)
            furthest[q] = right
            length = right - left + q
            if length >= max(LEAST, TIMES * q):
                found.append((int(texts[d]), left - begin, length, q))
        # a longer gram recurs only where a shorter one does
        again = np.zeros(len(codes), bool)
        again[here], again[there] = True, True
        enough = np.bincount(doc[np.flatnonzero(again)], minlength=len(size)) >= (TIMES - 1) * (last + 1) - k + 1
        if not enough.all():
            # the other texts can't have runs of larger lags
            keep = np.repeat(enough, size)
            again, codes, texts = again[keep], codes[keep], texts[enough]
            grams.h = grams.h[keep]
            base = np.append(0, np.cumsum(size[enough]))
            doc = np.repeat(np.arange(len(texts)), size[enough])
        places = np.flatnonzero(again)
    out = np.array(found, np.int64).reshape(-1, 4)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _searched(batches: Iterator[pa.RecordBatch], kept: list[str]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo, hi in runs_of_rows(whole.column(0), RUN_BYTES):
            batch = whole.slice(lo, hi - lo)
            found, at = split_words(batch.column(0), WORD_BYTES)
            runs = find_runs(found.dictionary_encode().indices.to_numpy(), at)
            text, start, length, period = runs.T
            dropped = np.zeros(len(found) + 1, np.int64)
            np.add.at(dropped, at[text] + start + period, 1)
            np.add.at(dropped, at[text] + start + length, -1)
            stay = np.cumsum(dropped[:-1]) == 0
            ends = np.append(0, np.cumsum(stay))[at].astype(np.int32)
            collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), found.filter(pa.array(stay))), " ")
            each = pa.StructArray.from_arrays([pa.array(c) for c in (start, length, period)], ["start", "length", "period"])
            of = pa.array(np.searchsorted(text, np.arange(len(batch) + 1)).astype(np.int32))
            own = [batch.column(k + 1) for k in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(at)), pa.ListArray.from_arrays(of, each), collapsed], [*kept, *RESULTS])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (text, any others but the text) with ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    ``collapsed`` holds the words, joined by single spaces, without those that a run repeats: a word
    goes if any run contains it after that run's first period.
    """
    kept = [c for c in docs.columns if c not in (*RESULTS, "text")]
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])
    source = docs.select(F.col("text").alias(free(kept, "whole")[0]), *[F.col(f"`{c}`") for c in kept])
    return source.mapInArrow(lambda batches: _searched(batches, kept), schema)


def greatest_run(runs: Column) -> Column:
    """The run of greatest exact length/period; of equal ones the first by start, then period; null without runs."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    # runs come by start and period, so an equal one later never wins
    return F.aggregate(runs, none, lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best))


def planted(doc_id: Column, text: Column) -> Column:
    """The text, with the contract's repetition for ids whose CRC-32 ends in 0; as it is without words or an id."""
    h = F.crc32(doc_id.cast("string"))

    def repeated(x: Column) -> Column:
        w, g = x["w"], x["g"]
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = F.transform(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.array_join(F.transform(at, lambda i: F.get(w, i.cast("int"))), " ")

    made = let(F.struct(words(text).alias("w"), F.floor(h / 10).alias("g")), lambda x: F.when(F.size(x["w"]) > 0, repeated(x)).otherwise(F.lit("")))
    return F.when(h % 10 == 0, made).otherwise(text)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    lines = F.transform("runs", lambda x: F.concat_ws(",", *[x[c].cast("string") for c in ("start", "length", "period")]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = F.col("best")
    found = periodic_runs(docs).withColumn("best", greatest_run(F.col("runs")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
