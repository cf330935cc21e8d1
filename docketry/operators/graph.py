"""Connected components of an edge table, and passes over components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.sources.store import written

#: Far more rounds than the logarithm of any number of rows; reaching it is an error.
MAX_ROUNDS = 64


def _jumped(to: DataFrame) -> DataFrame:
    """``id, to`` with every pointer moved to its end: each step makes what a pointer spans four times as long."""
    for _ in range(MAX_ROUNDS):
        once = to.join(to.select(F.col("id").alias("to"), F.col("to").alias("next")), "to")
        twice = once.join(once.select(F.col("id").alias("next"), F.col("next").alias("last")), "next")
        step = written(twice.select("id", F.col("last").alias("to"), (F.col("last") != F.col("to")).alias("moved")), "jumps")
        to = step.select("id", "to")
        if step.filter("moved").isEmpty():
            return to
    raise RuntimeError(f"pointers still move after {MAX_ROUNDS} rounds")


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (the least id reachable) for every id in ``edges`` (a, b); edges with a null end are dropped.

    In each round every id points to its least neighbour if that is less, pointers jump to their ends, and edges
    are drawn between those ends.  An id with an edge left joins another in the next round, so rounds
    follow the logarithm of the ids.
    """
    edges = written(edges.filter("a is not null and b is not null").select("a", "b").distinct(), "edges")
    found = None
    for _ in range(MAX_ROUNDS):
        both = edges.union(edges.select("b", "a"))
        low = _jumped(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("to")).select("id", F.least("id", "to").alias("to")))
        if found is None:
            found = low
        else:
            then = low.select(F.col("id").alias("to"), F.col("to").alias("then"))
            found = written(found.join(then, "to", "left").select("id", F.coalesce("then", "to").alias("to")), "found")
        ends = lambda c: low.select(F.col("id").alias(c), F.col("to").alias(f"{c}_to"))
        edges = edges.join(ends("a"), "a").join(ends("b"), "b").filter("a_to <> b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        edges = written(edges.distinct(), "edges")
        if edges.isEmpty():
            return found.withColumnRenamed("to", "component")
    raise RuntimeError(f"edges are left after {MAX_ROUNDS} rounds")
