"""Similarity join of distinct names, exact for the weighted measure.

Let two names have la <= lb characters and share o of them (repeats counted, spaces too).  A longest common
subsequence has o characters at most, sorting tokens moves characters only, and the best window of the
longer name shares o with the shorter one at most.  So with ``U = 200 o / (la + lb)`` and ``P = 200 o / (la + o)``

* simple and sorted-token ratio are at most U, the partial ratio at most P;
* the token-set ratio is at most U if no token is shared and none repeated, as it then is the sorted-token ratio; else 100.

Hence a similarity of at least t needs ``0.5 U + 0.2 P + 30 >= t``, and without a shared token even
``0.8 U + 0.2 P >= t``.  Both rise with o, so each pair of lengths has a least o: lengths for which the shorter name hasn't as many
characters never meet at all, and of the others one matrix product a tile counts the shared
characters of ``CHUNK`` by ``CHUNK`` names.  Only pairs that pass are scored, cheapest measure first, each
with what the measures left could still add.

An index of rare characters or of character pairs with a prefix filter would not spare more: at t = 85 the shares that are
certain to be common are so small that prefixes hold about half of a name's characters or pairs, and
most names share one of those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.names import partial_ratio, shared_in_order, similarity_of, token_set_ratio
from docketry.sources.store import written

CHUNK = 4096
#: Names of one chunk that are compared with all of the other at a time.
ROWS = 256
#: Classes of characters that are counted apart; more of them only let fewer pairs pass.
CLASSES = 64
#: Bits of a name's set of tokens; a bit in common may be a shared token.
TOKEN_BITS = 256
_SLACK = 1e-6
_SCORED = "a string, b string, similarity double"
_COUNTED = "met long, passed long, scored long, found long"


def least_shared(la: np.ndarray | int, lb: np.ndarray | int, threshold: float, tokens: bool) -> np.ndarray:
    """The fewest common characters that names of these lengths need, with or without a common token."""
    la, lb = np.minimum(la, lb).astype(np.float64), np.maximum(la, lb).astype(np.float64)
    each, rest = (0.5, 30.0) if tokens else (0.8, 0.0)
    lo, hi = np.zeros_like(la), la + 1
    # the bound rises with o: the least whole o by halving
    while np.any(hi - lo > 1):
        mid = np.floor((lo + hi) / 2)
        enough = each * 200 * mid / (la + lb) + 0.2 * 200 * mid / (la + mid) + rest >= threshold - _SLACK
        lo, hi = np.where(enough, lo, mid), np.where(enough, mid, hi)
    return hi


def _counts(names: list[str]) -> np.ndarray:
    out = np.zeros((len(names), CLASSES), np.int16)
    at = np.repeat(np.arange(len(names)), [len(n) for n in names])
    np.add.at(out, (at, np.fromiter((ord(ch) % CLASSES for n in names for ch in n), np.int64)), 1)
    return out


def _unary(counts: np.ndarray, most: np.ndarray) -> np.ndarray:
    """A column for the first, second ... of each class, so that products of rows are sums of minima."""
    wide = np.repeat(counts, most, axis=1)
    step = np.concatenate([np.arange(1, m + 1) for m in most]) if most.any() else np.zeros(0)
    return (wide >= step).astype(np.float32)


def _token_bits(names: list[str]) -> np.ndarray:
    """Bits of each name's tokens; all bits for one with a repeated token."""
    out = np.zeros((len(names), TOKEN_BITS // 64), np.uint64)
    for row, name in zip(out, names, strict=True):
        tokens = name.split(" ")
        if len(set(tokens)) < len(tokens):
            row[:] = np.uint64(2**64 - 1)
        for t in tokens:
            bit = sum((k + 1) * ord(ch) for k, ch in enumerate(t)) % TOKEN_BITS
            row[bit // 64] |= np.uint64(1 << bit % 64)
    return out


def compared(left: list[str], right: list[str], threshold: float) -> tuple[list[tuple[str, str, float]], int, int]:
    """``a, b, similarity`` (a < b) of the pairs of two chunks of names of one length each; how many passed and were scored."""
    la, lb = len(left[0]), len(right[0])
    x, y = _counts(left), _counts(right)
    any_, no_token = (float(least_shared(np.array([la]), np.array([lb]), threshold, t)[0]) for t in (True, False))
    most = np.minimum(x.max(axis=0), y.max(axis=0))
    if most.sum() < any_:
        return [], 0, 0
    wide_x, wide_y = _unary(x, most), np.ascontiguousarray(_unary(y, most).T)
    ordered = [[" ".join(sorted(n.split(" "))) for n in names] for names in (left, right)]
    out, passed, scored, least, total = [], 0, 0, threshold - _SLACK, la + lb
    for lo in range(0, len(left), ROWS):
        shared = wide_x[lo : lo + ROWS] @ wide_y
        i, j = np.nonzero(shared >= any_)
        common = shared[i, j]
        i += lo
        close = common >= no_token
        if not close.all():
            far = np.flatnonzero(~close)
            rows, columns = (np.unique(k[far], return_inverse=True) for k in (i, j))
            bits_x, bits_y = _token_bits([left[k] for k in rows[0]]), _token_bits([right[k] for k in columns[0]])
            close[far] = (bits_x[rows[1].ravel()] & bits_y[columns[1].ravel()]).any(axis=1)
        i, j, common = i[close], j[close], common[close]
        passed += len(i)
        most_p, most_u = 40 * common / (min(la, lb) + common), 200 * common / total
        row, last, last_sorted = -1, None, None
        for a, b, u, p in zip(i.tolist(), j.tolist(), most_u.tolist(), most_p.tolist(), strict=True):
            if left[a] == right[b]:
                continue
            if a != row:
                row, last, last_sorted = a, shared_in_order(left[a]), shared_in_order(ordered[0][a])
            by_tokens = 200.0 * last_sorted(ordered[1][b]) / total
            if 0.3 * by_tokens + 0.2 * u + p + 30 < least:
                continue
            simple = 200.0 * last(right[b]) / total
            if 0.2 * simple + 0.3 * by_tokens + p + 30 < least:
                continue
            scored += 1
            of_sets = token_set_ratio(left[a], right[b])
            if 0.2 * simple + 0.3 * by_tokens + p + 0.3 * of_sets < least:
                continue
            score = round(similarity_of(simple, partial_ratio(left[a], right[b]), by_tokens, of_sets), 6)
            if score >= threshold:
                out.append((*sorted((left[a], right[b])), score))
    return out, passed, scored


def _tiles(names: DataFrame, threshold: float) -> DataFrame:
    """``na, pa, n, part, left, right``: chunks of names of one length that meet, each two once."""
    sized = written(names.select("norm").distinct().withColumn("n", F.length("norm")), "sized")
    sizes = written(sized.groupBy("n").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("parts")), "sizes")
    part = F.pmod(F.xxhash64("norm"), F.col("parts")).cast("int")
    chunks = written(sized.join(sizes, "n").groupBy("n", part.alias("part")).agg(F.array_sort(F.collect_list("norm")).alias("names")), "chunks")
    # 100 na / (na + n) + 50 must reach the threshold, which bounds the longer name's length n
    longest = sizes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    share = (threshold - 50 - _SLACK) / 100
    most = F.least(F.lit(longest), F.floor(F.col("na") * (1 / share - 1) + _SLACK)) if share > 0 else F.lit(longest)
    left = chunks.select(F.col("n").alias("na"), F.col("part").alias("pa"), F.col("names").alias("left"))
    left = left.withColumn("n", F.explode(F.sequence(F.col("na").cast("long"), most.cast("long")))).join(sizes, "n")
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return left.join(chunks.withColumnRenamed("names", "right"), ["n", "part"]).filter("na < n or pa <= part")


def similar_pairs(names: DataFrame, threshold: float = 85) -> DataFrame:
    """``a, b, similarity`` (a < b) of all pairs of the distinct ``norm`` at or over the threshold."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [r for x, y in zip(pdf["left"], pdf["right"], strict=True) for r in compared(list(x), list(y), threshold)[0]]
        # a chunk compared with itself finds each pair twice
        return pd.DataFrame(sorted(set(found)), columns=["a", "b", "similarity"])

    return _tiles(names, threshold).groupBy("na", "pa", "n", "part").applyInPandas(run, _SCORED)


def join_counts(names: DataFrame, threshold: float = 85) -> DataFrame:
    """One row: pairs that ``met`` in a tile, ``passed`` the bounds on shared characters and tokens, were ``scored`` to the third measure, and ``found``."""

    def each(pdf: pd.DataFrame) -> Iterator[tuple[int, int, int, int]]:
        for na, pa, n, part, x, y in zip(*(pdf[c] for c in ("na", "pa", "n", "part", "left", "right")), strict=True):
            found, passed, scored = compared(list(x), list(y), threshold)
            twice = 2 if (na, pa) == (n, part) else 1
            met = len(x) * (len(x) - 1) // 2 if twice == 2 else len(x) * len(y)
            yield met, (passed - len(x) * (twice - 1)) // twice, scored // twice, len(set(found))

    counted = _tiles(names, threshold).groupBy("na", "pa", "n", "part").applyInPandas(lambda pdf: pd.DataFrame(list(each(pdf)), columns=["met", "passed", "scored", "found"]), _COUNTED)
    return counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("met", "passed", "scored", "found")])
