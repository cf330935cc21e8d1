"""Ranked lexical search, a term at a time with a limit on accumulators.

The documents' postings are kept by document: a table has a row a document with the codes and
counts of the terms that were asked for, so nothing is shuffled by term and a frequent
term is no hot key.  A task takes the postings of a batch of documents, turns them
to lists by term, and takes each item's terms in turn, the rarest first.  A term adds to the
accumulators of its documents and creates missing ones, until the sum of the bounds of the terms
left (gain times the largest impact that the term has in the batch) is less than the
``k``-th best score, be it a partial one of the batch or one of an earlier batch of the task.
No document without an accumulator can then reach the best ``k``; the terms left update
the accumulators there are, exactly.  Each task gives its best ``k`` of an item,
so the answer is the best of those, and exact.

Items are taken in blocks of about ``BLOCK_TERMS`` pairs of an item and a term, the only thing that passes
through the driver and is sent to every task; a block reads the documents once more.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased.
Null and empty texts have none: such documents are no part of the statistics, such items have
no result.  Repeated rows are documents (or items) of their own; a document without an id
counts like others and comes after equal scores.  Long texts are taken whole.  Empty tables give
an empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import stored, table
from docketry.llm.spans import byte_class, runs_of_rows, split_words

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM_BYTES = byte_class("".join(chr(i) for i in range(128) if not chr(i).isalnum()))
#: The scoring's saturation and length share, in hundredths or thousandths.
LENGTH_SHARE, SATURATION, SCALE = 25, 12, 1_000_000_000
#: Pairs of an item and a term in a block of items, about.
BLOCK_TERMS = 500_000
#: Bytes of texts, or postings, that a task works on at a time.
RUN_BYTES, RUN_POSTINGS = 1 << 23, 1 << 21
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: Column | str) -> Column:
    """Array of a text's terms with repeats; empty for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(TERM), F.lit(0))


def _counted(wanted: Broadcast):
    """For each document its number of terms, and the codes and counts of the wanted ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value_set = pa.array(wanted.value, pa.string())
        for batch in batches:
            for lo, hi in runs_of_rows(batch.column("text"), RUN_BYTES):
                part = batch.slice(lo, hi - lo)
                found, at = split_words(part.column("text"), TERM_BYTES)
                coded = found.dictionary_encode()
                code = pc.index_in(pc.ascii_lower(coded.dictionary), value_set=value_set).fill_null(-1).to_numpy()[coded.indices.to_numpy()]
                use = np.flatnonzero(code >= 0)
                row = np.searchsorted(at, use, "right") - 1
                key, times = np.unique(row * np.int64(len(value_set)) + code[use], return_counts=True)
                ends = pa.array(np.searchsorted(key, np.arange(len(part) + 1) * np.int64(len(value_set))).astype(np.int32))
                codes = pa.array((key % max(len(value_set), 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(at)), pa.ListArray.from_arrays(ends, codes), pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int64)))], ["doc_id", "n", "codes", "times"]
                )

    return run


class _Best:
    """The best ``k`` documents of an item so far; equal scores by id, missing ids last."""

    def __init__(self, k: int):
        self.k, self.score, self.doc, self.none = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """A score below this is of no use."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        score, doc, none = (np.concatenate(x) for x in ((self.score, score), (self.doc, doc), (self.none, none)))
        order = np.lexsort((doc, none, -score))[: self.k]
        self.score, self.doc, self.none = score[order], doc[order], none[order]


class Postings:
    """Postings of a batch of documents, by term: documents and impacts."""

    def __init__(self, row: np.ndarray, code: np.ndarray, times: np.ndarray, m: np.ndarray):
        impact = (SCALE * times) // (1000 * times + SATURATION * m[row])
        order = np.argsort(code, kind="stable")
        self.row, self.impact = row[order], impact[order]
        self.codes, start = np.unique(code[order], return_index=True)
        self.ends = np.append(start, len(code))
        self.most = np.maximum.reduceat(self.impact, start) if len(code) else np.zeros(0, np.int64)
        self.n_docs = len(m)

    def scores(self, codes: np.ndarray, gains: np.ndarray, k: int, least: int) -> np.ndarray:
        """A score for each document of one item, whose terms come rarest first.

        It is exact for every document that can be among the best ``k`` or reach ``least``; 0 stands for
        documents that never got an accumulator.
        """
        acc = np.zeros(self.n_docs, np.int64)
        at = np.searchsorted(self.codes, codes)
        at = np.minimum(at, max(len(self.codes) - 1, 0))
        here = np.flatnonzero(self.codes[at] == codes) if len(self.codes) else np.zeros(0, np.int64)
        at, gains = at[here], gains[here]
        # what all terms from here on can add at most
        left = np.append(np.cumsum((gains * self.most[at])[::-1])[::-1], 0)
        alive = None
        for j, (t, gain) in enumerate(zip(at, gains, strict=True)):
            if alive is None and (left[j] < least or np.count_nonzero(acc > left[j]) >= k):
                alive = acc > 0
                if not alive.any():
                    break
            rows, impact = self.row[self.ends[t] : self.ends[t + 1]], self.impact[self.ends[t] : self.ends[t + 1]]
            if alive is not None:
                old = alive[rows]
                rows, impact = rows[old], impact[old]
            acc[rows] += gain * impact
        return acc


def _ranked(items: Broadcast, k: int):
    """The best ``k`` documents of a task for every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {item: _Best(k) for item, _, _ in items.value}
        for whole in batches:
            ends = np.append(0, np.cumsum(pc.list_value_length(whole.column("codes")).to_numpy()))
            lo = 0
            while lo < len(whole):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + RUN_POSTINGS, "right")) - 1)
                batch = whole.slice(lo, hi - lo)
                lo = hi
                size = pc.list_value_length(batch.column("codes")).to_numpy()
                flat = [batch.column(c).flatten().to_numpy() for c in ("codes", "times")]
                postings = Postings(np.repeat(np.arange(len(size)), size), *flat, batch.column("m").to_numpy())
                ids, none = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                for item, codes, gains in items.value:
                    mine = best[item]
                    acc = postings.scores(codes, gains, k, mine.least)
                    some = np.flatnonzero(acc >= mine.least)
                    if len(some) > 4 * k:
                        some = some[acc[some] >= np.partition(acc[some], -k)[-k]]
                    if len(some):
                        mine.add(acc[some], ids[some], none[some])
        for item, b in best.items():
            if len(b.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.score), item)), pa.array(b.doc, mask=b.none), pa.array(b.score)], ["item", "doc_id", "score"])

    return run


def _block(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``item, doc_id, score``: the best of each task for the items of a block (item, term, repeats)."""
    sc = docs.sparkSession.sparkContext
    wanted = [r.term for r in asked.select("term").distinct().orderBy("term").collect()]
    postings = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counted(sc.broadcast(wanted)), "doc_id long, n long, codes array<int>, times array<long>"), "postings")
    n_docs, n_terms = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = postings.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("df"))
    weigh = F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long")
    weight = {wanted[code]: w for code, w in found.select("code", weigh).collect()}
    code = {term: c for c, term in enumerate(wanted)}
    of: dict[int, list[tuple[int, int, int]]] = {}
    for item, term, repeats in asked.select("item", "term", "repeats").collect():
        if term in weight:
            of.setdefault(item, []).append((-weight[term], code[term], repeats))
    items = []
    for item, ts in sorted(of.items()):
        ts.sort()
        items.append((item, np.array([c for _, c, _ in ts], np.int32), np.array([-w * r for w, _, r in ts], np.int64)))
    m = F.expr(f"{100 - LENGTH_SHARE} + ({LENGTH_SHARE} * n * {n_docs}L) div {max(n_terms, 1)}L").alias("m")
    return postings.filter(F.size("codes") > 0).select("doc_id", m, "codes", "times").mapInArrow(_ranked(sc.broadcast(items), k), "item long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of highest score above 0 for each row of ``items`` (item_id, text)."""
    rows = stored(items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()), "items")
    asked = stored(rows.select("item", F.explode(terms("text")).alias("term")).groupBy("item", "term").agg(F.count(F.lit(1)).alias("repeats")), "asked")
    blocks = max(1, -(-asked.count() // BLOCK_TERMS))
    out = None
    for b in range(blocks):
        one = _block(docs, asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b), k)
        out = one if out is None else out.union(one)
    out = stored(out.withColumn("part", F.spark_partition_id()), "best")
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))

    def first(df: DataFrame, *by: str) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)

    # in two steps, so that no task takes the best of all others
    tasks = out.agg(F.max("part")).first()[0] or 0
    near = first(out.withColumn("part", F.pmod("part", F.lit(math.isqrt(tasks + 1)))), "item", "part").drop("part")
    return first(near, "item").join(rows.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op12_ranked_lexical(spark, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


_SQL_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}')"
OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_SQL_TERMS} AS ts FROM documents),
f AS (SELECT k, term, count(*)::BIGINT AS tf FROM (SELECT k, unnest(ts) AS term FROM d) GROUP BY k, term),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
i AS (SELECT row_number() OVER () AS item, item_id, {_SQL_TERMS} AS ts FROM benchmark),
q AS (SELECT item, item_id, term, count(*)::BIGINT AS repeats FROM (SELECT item, item_id, unnest(ts) AS term FROM i) GROUP BY ALL),
w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM f GROUP BY term), s),
m AS (SELECT k, doc_id, 75 + (25 * len(ts)::BIGINT * n_docs) // n_terms AS m FROM d, s WHERE len(ts) > 0),
p AS (
  SELECT item, item_id, doc_id, k, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (k) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM p WHERE score > 0) WHERE rank <= 20
"""
