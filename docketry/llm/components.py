"""Connected components of an edge table by pointers that jump and edges that shrink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import cut

#: Pointers up to this number are sent to every task, so that a hub's many edges stay where they are.
BROADCAST_ROWS = 1_000_000
#: Far more rounds than doubling jumps need; reaching it is an error.
MAX_ROUNDS = 64


def _looked_up(df: DataFrame, column: str, to: DataFrame, name: str, small: bool) -> DataFrame:
    """``df`` with ``name``, where the pointer of ``column`` points to.

    If all pointers, or those that ``df`` asks for, are few, they go to every task.
    Otherwise both sides are shuffled; a hub's rows are then split by adaptive execution.
    """
    found = to.select(F.col("id").alias(column), F.col("l").alias(name))
    if not small:
        asked = cut(found.join(df.select(column).distinct(), column, "left_semi"))
        found, small = asked, asked.count() <= BROADCAST_ROWS
    return df.join(F.broadcast(found) if small else found, column)


def components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``id, component`` (the least id reachable) for every id in ``edges`` (columns a, b).

    Every id points to its least neighbour at first.  In each round pointers jump
    to where they point to, edges move to where their ends point to (those within
    one place go), and what is left of them lowers pointers.  Edges shrink and
    jumps double, so rounds grow with the logarithm of the number of ids; if
    ``max_rounds`` don't do, an error is raised.  Loops and repeated edges are harmless;
    null ends are dropped; no edges give no rows.
    """
    e = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    e = cut(e.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    least = lambda df: df.union(df.select("v", "u")).groupBy("u").agg(F.min("v").alias("m"))
    to = cut(least(e).select(F.col("u").alias("id"), F.least("u", "m").alias("l")))
    small = to.count() <= BROADCAST_ROWS

    def jumped(t: DataFrame) -> DataFrame:
        return cut(_looked_up(t, "l", t, "n", small).select("id", F.col("n").alias("l")))

    for _ in range(max_rounds):
        to = jumped(to)
        moved = _looked_up(_looked_up(e, "u", to, "x", small), "v", to, "y", small)
        e = cut(moved.filter("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct())
        if e.isEmpty():
            break
        lower = least(e).withColumnRenamed("u", "id")
        to = to.join(F.broadcast(lower) if small else lower, "id", "left").select("id", F.least("l", F.coalesce("m", "l")).alias("l"))
    else:
        raise RuntimeError(f"edges are left after {max_rounds} rounds")
    last = None
    for _ in range(max_rounds):
        state = to.agg(F.sum(F.col("l").cast("decimal(38,0)"))).first()[0]
        if state == last:
            return to.withColumnRenamed("l", "component")
        last, to = state, jumped(to)
    raise RuntimeError(f"pointers still jump after {max_rounds} rounds")
