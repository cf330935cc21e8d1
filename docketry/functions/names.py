"""Company names: the normaliser and four similarity measures.

Measures are 0 to 100.  The longest common subsequence is found bit-parallel on
Python integers, in Arrow batches of name pairs; callers score distinct names or
pairs only, never raw rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.functions.lookups import ARTICLES, SUFFIXES
from docketry.functions.scalars import c

_EDGES = r"(?U)^\s+|\s+$"


def normalized(name: Column | str) -> Column:
    """Upper case, endings cut once each in order, punctuation to spaces, articles dropped; '' for null."""
    strip = lambda x: F.regexp_replace(x, _EDGES, "")
    start = strip(F.upper(F.coalesce(c(name), F.lit(""))))

    def cut(acc: Column, end: Column) -> Column:
        return F.when(acc.endswith(end), strip(F.left(acc, F.length(acc) - F.length(end)))).otherwise(acc)

    short = F.aggregate(F.array(*[F.lit(s) for s in SUFFIXES]), start, cut)
    spaced = F.regexp_replace(F.regexp_replace(short, r"(?U)[^\w\s]", " "), r"(?U)\s+", " ")
    return F.array_join(F.filter(F.split(F.trim(spaced), " "), lambda w: ~w.isin(*ARTICLES) & (w != "")), " ")


def _marks(a: str) -> dict[str, int]:
    """For each character a bit for each place in ``a``."""
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    return at


def shared_in_order(a: str):
    """A function that gives the length of the longest common subsequence with ``a``, a bit for each character of it."""
    at, full, n = _marks(a), (1 << len(a)) - 1, len(a)

    def length(b: str) -> int:
        s = full
        for ch in b:
            u = s & at.get(ch, 0)
            s = (s + u | s - u) & full
        return n - s.bit_count()

    return length


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    return shared_in_order(a)(b)


def _lcs_of_starts(a: str, b: str) -> list[int]:
    """Lengths for every beginning of ``b`` of one character or more, from one pass."""
    at, full = _marks(a), (1 << len(a)) - 1
    s, out = full, []
    for ch in b:
        u = s & at.get(ch, 0)
        s = (s + u | s - u) & full
        out.append(len(a) - s.bit_count())
    return out


def ratio(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * _lcs(a, b) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with a window of the longer one, shorter windows at both ends too."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    best = _best_window(a, b)
    return max(best, _best_window(b, a)) if len(a) == len(b) else best


def _best_window(a: str, b: str) -> float:
    n = len(a)
    starts, ends = _lcs_of_starts(a, b[:n]), _lcs_of_starts(a[::-1], b[: -n - 1 : -1])
    best = max(200.0 * common / (n + k + 1) for side in (starts, ends) for k, common in enumerate(side))
    # a window moved by one shares one character more at most, so windows that can't be best are passed over
    length, at, most = shared_in_order(a), 1, max(starts[-1], ends[-1]) if len(b) >= n else 0
    while at < len(b) - n:
        common = length(b[at : at + n])
        most = max(most, common)
        at += max(1, most - common + 1)
    return max(best, 200.0 * most / (2 * n))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_a, only_b = (" ".join(sorted(t)) for t in (x & y, x - y, y - x))
    if both and (not only_a or not only_b):
        return 100.0
    with_a, with_b = f"{both} {only_a}".strip(), f"{both} {only_b}".strip()
    scores = [ratio(with_a, with_b)]
    if both:
        scores += [ratio(both, with_a), ratio(both, with_b)]
    return max(scores)


def similarity(a: str, b: str) -> float:
    """Weighted mean of the measures of two normalised names; 0 if one is empty."""
    if not a or not b:
        return 0.0
    return similarity_of(ratio(a, b), partial_ratio(a, b), token_sort_ratio(a, b), token_set_ratio(a, b))


def similarity_of(simple: float, partial: float, token_sort: float, token_set: float) -> float:
    """The weighted mean of the four measures."""
    return 0.2 * simple + 0.2 * partial + 0.3 * token_sort + 0.3 * token_set


MEASURES = {"simple": ratio, "partial": partial_ratio, "token_sort": token_sort_ratio, "token_set": token_set_ratio, "weighted": similarity}


def measure(kind: str, a: Column | str, b: Column | str) -> Column:
    """One of ``MEASURES`` on two columns of normalised names, rounded to six places; null with null."""
    one = MEASURES[kind]

    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else round(one(p, q), 6) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(c(a), c(b))


def token_key(name: Column | str) -> Column:
    """Sorted distinct tokens, joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.split(c(name), " "))), " ")
