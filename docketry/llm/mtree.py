"""Exact inner-product top-k by best-first search of an M-tree.

Components become floor(1024 x).  With M the largest norm, a candidate c gets one
more component, sqrt(M^2 - |c|^2), and a query a zero; then |q - c|^2 = |q|^2 + M^2 -
2 q.c, so the nearest candidates by that metric are those with the largest inner
product.

The tree has three levels.  The top directory holds a routing vector and a covering
radius for each subtree; routing vectors are those with the smallest hash of
their id, at most ``MAX_TREES`` of them, so the directory is bounded and is sent to every task.
Cells with more than ``tree_rows`` rows are dealt over several subtrees.  A subtree is
built in one task, of pages of ``PAGE`` rows; a page keeps its routing vector, its covering radius, its
distance to the subtree's routing vector, and each row's distance to its own.

Queries, by the blocks of their hash, first search the nearest subtree, best page
first, and then every subtree that the bound so found can't rule out; a subtree goes to
the blocks that ask for it.  Stored distances and the triangle inequality rule out
pages and rows before their distance is computed.  Rows with equal vectors are one entry
with its smallest ids.

Scores are exact: products are taken in doubles while every sum stays below 2^53, else in
64-bit integers; vectors whose scores might not fit a long are an error.  Distances are in
doubles, so bounds leave room for rounding in proportion to the norms; a candidate
is never ruled out by rounding.

Vectors that are null or hold a null, NaN or infinite component take no part; a
shorter vector counts as filled with zeros.  Null ids take no part.  Ties go to the
smaller id.  An empty table gives an empty result; repeated ids are separate rows.  Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import stored, table

SCALE = 1024
PAGE = 256
TREE_ROWS = 1024
MAX_TREES = 16_384
QUERY_BLOCK = 4096
#: Rows of a frame of routed queries.
ROUTED_ROWS = 4096
FOUND = "query_id long, vec_id long, score long"


def scaled(v: Column) -> Column:
    """Whole components; null if the vector takes no part."""
    bad = F.exists(v, lambda x: F.coalesce(F.isnan(x) | (F.abs(x.cast("double")) == float("inf")), F.lit(True)))
    return F.when(v.isNotNull() & ~bad, F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("double")))


def _matrix(col: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(col), dim))
    for row, v in zip(out, col, strict=True):
        row[: len(v)] = v
    return out


def _lifted(m: np.ndarray, most: float) -> np.ndarray:
    return np.column_stack([m, np.sqrt(np.maximum(most - (m * m).sum(axis=1), 0))])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between the rows of ``a`` and those of ``b`` (or its one row), by differences, so that small ones are precise."""
    d = a - b
    return np.sqrt((d * d).sum(axis=1))


def _room(norms: np.ndarray | float, dim: int) -> np.ndarray | float:
    """What rounding may take from a score that a distance bounds; ``norms`` is |q|^2 + M^2."""
    return 0.5 + (dim + 16) * 2.0**-50 * norms


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T
    return np.sqrt(np.maximum(d, 0))


class Subtree:
    """Pages of distinct vectors below one routing vector."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, router: np.ndarray, most: float, k: int, page: int = PAGE) -> None:
        self.rows, owner = np.unique(rows, axis=0, return_inverse=True)
        # whole numbers either way; in doubles only while all sums are exact
        self.exact = self.rows if most < 2.0**52 else self.rows.astype(np.int64)
        order = np.lexsort((ids, owner.ravel()))
        groups = np.split(ids[order], np.flatnonzero(np.diff(owner.ravel()[order])) + 1)
        self.ids = [g[: k + 1] for g in groups]  # one more than k, as one may be the query itself
        self.most = most
        lifted = _lifted(self.rows, most)
        n = len(lifted)
        to_router = _apart(lifted, router[None])
        # page routers: rows at equal steps of distance from the subtree's router
        heads = np.argsort(to_router, kind="stable")[:: page // 2]
        away = _distances(lifted, lifted[heads])
        cell = away.argmin(axis=1)
        near = _apart(lifted, lifted[heads[cell]])
        order = np.lexsort((near, cell))
        cuts = np.flatnonzero(np.diff(cell[order])) + 1
        self.pages = [part[i : i + page] for part in np.split(order, cuts) for i in range(0, len(part), page)]
        self.heads = lifted[[heads[cell[p[0]]] for p in self.pages]]
        self.near = [near[p] for p in self.pages]  # a row's distance to its page's router
        self.radius = np.array([x.max() for x in self.near])
        self.parent = _apart(self.heads, router[None])

    def search(self, query_id: int, q: np.ndarray, to_router: float, k: int, least: float) -> list[tuple[int, int]]:
        """Best (score, id) of this subtree, none below ``least``; the best page first."""
        base = float(q @ q) + self.most
        room, q_ = _room(base, len(q)), q.astype(self.exact.dtype)
        score_at = lambda d: (base - d * d) / 2 + room  # noqa: E731  no smaller than any score at that distance
        # the parent's stored distances rule out pages before theirs are computed
        might = np.flatnonzero(score_at(np.maximum(np.abs(to_router - self.parent) - self.radius, 0)) >= least)
        if not len(might):
            return []
        lifted = np.append(q, 0.0)
        away = _apart(self.heads[might], lifted[None])
        bound = score_at(np.maximum(away - self.radius[might], 0))
        best: list[tuple[int, int]] = []
        for i in np.argsort(-bound, kind="stable"):
            if bound[i] < least:
                break
            p = self.pages[might[i]]
            p = p[score_at(np.abs(away[i] - self.near[might[i]])) >= least]
            if not len(p):
                continue
            scores = self.exact[p] @ q_
            good = scores >= least
            found = [(int(s), int(x)) for s, r in zip(scores[good], p[good], strict=True) for x in self.ids[r] if x != query_id]
            if found:
                best = sorted(best + found, key=lambda t: (-t[0], t[1]))[:k]
                if len(best) == k:
                    least = max(least, best[-1][0])
        return best


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, tree_rows: int = TREE_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest inner products for each query.

    Both inputs have ``vec_id, embedding``; a query's own id isn't among its results.
    """
    spark = vectors.sparkSession
    clean = lambda df: df.select("vec_id", scaled(F.col("embedding")).alias("v")).filter(F.col("v").isNotNull() & F.col("vec_id").isNotNull())
    rows, asked = clean(vectors), clean(queries)
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("most"), F.max(F.size("v")).alias("dim")).first()
    n, most, dim = stats["n"], stats["most"], stats["dim"]
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n_asked, dim_asked, most_asked = asked.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(norm)).first()
    dim = max(dim, dim_asked or 0)
    if max(most, most_asked or 0.0) >= 2.0**62:
        raise ValueError("scores of these vectors don't fit a long")
    tree_rows = max(tree_rows, -(-n // MAX_TREES))
    heads = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(-(-n // tree_rows)).toPandas()
    routers = np.unique(_lifted(_matrix(heads["v"], dim), most), axis=0)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 512):
                part = pdf.iloc[lo : lo + 512]
                rows = _lifted(_matrix(part["v"], dim), most)
                cell = _distances(rows, routers).argmin(axis=1)
                yield part.assign(cell=cell.astype(np.int32), away=_apart(rows, routers[cell]))

    placed = stored(rows.mapInPandas(assign, "vec_id long, v array<double>, cell int, away double"), "cells")
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).toPandas().sort_values("cell")
    splits = np.ceil(cells["n"].to_numpy() / tree_rows).astype(int)
    first = np.zeros(len(routers), int)
    first[cells["cell"]] = np.cumsum(splits) - splits
    tree_cell = np.repeat(cells["cell"].to_numpy(), splits)
    tree_radius = np.repeat(cells["radius"].to_numpy(), splits)
    blocks = max(1, -(-n_asked // QUERY_BLOCK))
    # at most MAX_TREES cells
    dealt = spark.createDataFrame(pd.DataFrame({"cell": cells["cell"], "first": first[cells["cell"]], "splits": splits}), "cell int, first int, splits int")
    trees = placed.join(F.broadcast(dealt), "cell").withColumn("tree", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("splits")).cast("int"))
    trees = trees.select("tree", "vec_id", "v")

    def route(first_only: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for lo in range(0, len(pdf), 256):
                    part = pdf.iloc[lo : lo + 256]
                    q = _matrix(part["v"], dim)
                    away = _distances(np.column_stack([q, np.zeros(len(q))]), routers)[:, tree_cell]
                    norms = (q * q).sum(axis=1)[:, None] + most
                    bound = (norms - np.maximum(away - tree_radius, 0) ** 2) / 2 + _room(norms, dim)
                    nearest = bound.argmax(axis=1)
                    if first_only:
                        row, tree = np.arange(len(q)), nearest
                    else:
                        go = bound >= part["least"].fillna(-np.inf).to_numpy()[:, None]
                        go[np.arange(len(q)), nearest] = False
                        row, tree = np.nonzero(go)
                    for k in range(0, len(row), ROUTED_ROWS):
                        r, t = row[k : k + ROUTED_ROWS], tree[k : k + ROUTED_ROWS]
                        yield pd.DataFrame({
                            "tree": t.astype(np.int32), "block": part["block"].to_numpy()[r], "query_id": part["query_id"].to_numpy()[r],
                            "q": part["v"].to_numpy()[r], "away": away[r, t], "least": part["least"].to_numpy()[r],
                        })

        return run

    def search(rows_: pd.DataFrame, asked_: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows_) and len(asked_):
            router = routers[tree_cell[asked_["tree"].iloc[0]]]
            tree = Subtree(rows_["vec_id"].to_numpy(), _matrix(rows_["v"], dim), router, most, k)
            qs = _matrix(asked_["q"], dim)
            for query_id, q, away, least in zip(asked_["query_id"], qs, asked_["away"], asked_["least"], strict=True):
                found += [(query_id, x, s) for s, x in tree.search(query_id, q, away, k, -np.inf if pd.isna(least) else least)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    key = ["tree", "block"]
    routed = f"tree int, block int, query_id long, q array<double>, away double, least double"

    def searched(qs: DataFrame, first_only: bool) -> DataFrame:
        pairs = stored(qs.mapInPandas(route(first_only), routed), "routed")
        asks = pairs.select(F.col("tree").alias("of"), F.col("block").alias("at")).distinct()
        wanted = trees.join(asks, F.col("tree") == F.col("of")).select("tree", F.col("at").alias("block"), "vec_id", "v")
        return wanted.groupBy(*key).cogroup(pairs.groupBy(*key)).applyInPandas(search, FOUND)

    asked = asked.select(F.col("vec_id").alias("query_id"), "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    near = stored(searched(asked.withColumn("least", F.lit(None).cast("double")), True), "near")
    least = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("least"))
    far = searched(asked.join(least, "query_id", "left"), False)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.union(far).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op8_exact_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
