"""Company-name resolution: scoring, searching and grouping distinct names.

Scores are computed for distinct names or pairs of them only; ``similar`` has the join that finds
all pairs over a threshold, ``graph`` the components that groups are made in.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions import scalars as S
from docketry.functions.names import measure, normalized, similarity
from docketry.functions.scalars import filled
from docketry.operators.graph import components
from docketry.operators.similar import similar_pairs
from docketry.sources.store import written

KEY = "company_name_normalized"
#: Pairs of a component that one task decides; a larger one is decided by rounds of joins.
COMPONENT = 500_000


def distinct_names(df: DataFrame, column: str = "company_name") -> DataFrame:
    """``name, norm``: a row for each distinct name."""
    return df.filter(filled(column)).select(F.col(column).alias("name")).distinct().withColumn("norm", normalized("name")).filter("norm <> ''")


def find_matches(names: DataFrame, query: str, threshold: float = 75, limit: int | None = 10, prefilter: str | None = None) -> DataFrame:
    """``name, similarity`` of names like ``query``, best first.

    ``prefilter='substring'`` keeps only names that hold the normalised query, which
    is fast but can't find misspellings.
    """
    target = normalized(F.lit(query))
    cand = names.filter(F.col("norm").contains(target)) if prefilter == "substring" else names
    scored = cand.select("norm").distinct().withColumn("target", target).withColumn("similarity", measure("weighted", "norm", "target"))
    out = names.join(scored.filter(F.col("similarity") >= threshold).drop("target"), "norm")
    out = out.select("name", "similarity").orderBy(F.desc("similarity"), "name")
    return out if limit is None else out.limit(limit)


def best_match(names: DataFrame, query: str, threshold: float = 75) -> DataFrame:
    return find_matches(names, query, threshold, limit=1)


def match_rows(df: DataFrame, query: str, threshold: float = 75, column: str = "company_name", limit: int | None = None) -> DataFrame:
    """Rows whose name matches, with the similarity; those of the ``limit`` best names if given."""
    (found,) = S.free([*df.columns, "similarity"], "found")
    hits = find_matches(distinct_names(df, column), query, threshold, limit).withColumnRenamed("name", found)
    return df.join(hits, F.col(column) == F.col(found)).drop(found)


def _leaders(pairs: DataFrame) -> DataFrame:
    """``a``: the names that lead, taken in order, so that no leader is like an earlier one.

    A name leads as soon as no undecided smaller name is like it; what is like a
    leader is decided.  A round does that for all names at once, with joins; the
    number of rounds follows the longest chain of decisions, not the rows.  In the
    end every name that no leader took leads, also one whose own pairs were all
    decided from their other ends.
    """
    left, led = pairs.select("a", "b"), None
    while not left.isEmpty():
        heads = written(left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti"), "heads")
        taken = written(left.join(heads, "a").select("b").distinct(), "taken")
        left = left.join(heads, "a", "left_anti").join(taken.withColumnRenamed("b", "a"), "a", "left_anti").join(taken, "b", "left_anti")
        left = written(left.select("a", "b"), "left")
        led = taken if led is None else led.union(taken)
    found = pairs.select("a").distinct()
    return found if led is None else found.join(led.withColumnRenamed("b", "a"), "a", "left_anti")


def _members(pdf: pd.DataFrame) -> pd.DataFrame:
    """The groups of one component: names in order, each unused one leads a group of later unused names like it."""
    used, out = set(), []
    for a, like in pdf.sort_values(["a", "b"]).groupby("a", sort=True):
        if a in used:
            continue
        for b, score in zip(like["b"], like["similarity"], strict=True):
            if b not in used:
                used.add(b)
                out.append((b, a, score))
    return pd.DataFrame(out, columns=["norm", "leader", "similarity"])


def group_similar(names: DataFrame, threshold: float = 85) -> DataFrame:
    """``norm, leader, similarity``: groups of two names or more.

    Names in order, each unused one leads a group of later unused names that are
    like it: a member belongs to the first leader that it is like.  That is decided inside a
    component of the pairs, in one task; components of more than ``COMPONENT`` pairs are decided by rounds of joins.
    """
    pairs = written(similar_pairs(names, threshold), "pairs")
    each = written(pairs.join(components(pairs).withColumnRenamed("id", "a"), "a"), "components")
    sizes = written(each.groupBy("component").agg(F.count(F.lit(1)).alias("pairs")), "sizes")
    small = each.join(sizes.filter(F.col("pairs") <= COMPONENT), "component", "left_semi")
    members = written(small.groupBy("component").applyInPandas(_members, "norm string, leader string, similarity double"), "members")
    large = each.join(sizes.filter(F.col("pairs") > COMPONENT), "component", "left_semi").select("a", "b", "similarity")
    if not large.isEmpty():
        led = large.join(_leaders(large), "a")
        members = members.union(led.groupBy(F.col("b").alias("norm")).agg(F.min("a").alias("leader"), F.min_by("similarity", "a").alias("similarity")))
    heads = members.select(F.col("leader").alias("norm"), "leader").distinct().withColumn("similarity", F.lit(100.0))
    return members.union(heads)


def resolved(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with ``representative``: the leader of their name's group, else their own name."""
    lead = groups.select(F.col("norm").alias(KEY), "leader")
    return df.join(lead, KEY, "left").withColumn("representative", F.coalesce("leader", KEY)).drop("leader")


def sound_groups(names: DataFrame) -> DataFrame:
    """``code, norm, leader, similarity``: names that sound alike, with the first of them and how like it they are written.

    The code is that of the name without spaces.  Each name meets its group's first one only.
    """
    coded = names.select("norm").distinct().withColumn("code", F.soundex(F.regexp_replace("norm", " ", "")))
    leaders = coded.groupBy("code").agg(F.min("norm").alias("leader"))
    return coded.join(leaders, "code").select("code", "norm", "leader", measure("weighted", "norm", "leader").alias("similarity"))


def watch_list(names: DataFrame, queries: Sequence[str], threshold: float = 75) -> DataFrame:
    """``query, name, similarity`` for each name like one of ``queries``; every name is scored."""
    spark = names.sparkSession
    asked = spark.createDataFrame([(q,) for q in queries], "query string").withColumn("target", normalized("query"))
    pairs = names.select("norm").distinct().crossJoin(F.broadcast(asked))
    scored = pairs.withColumn("similarity", measure("weighted", "norm", "target")).filter(F.col("similarity") >= threshold)
    return scored.join(names, "norm").select("query", "name", "similarity")


def brute_groups(names: list[str], threshold: float = 85) -> list[list[str]]:
    """The same groups from all pairs, for small lists in tests."""
    used: set[str] = set()
    out = []
    left = sorted(set(names))
    for i, a in enumerate(left):
        if a in used:
            continue
        group = [a] + [b for b in left[i + 1 :] if b not in used and similarity(a, b) >= threshold]
        used.update(group)
        if len(group) > 1:
            out.append(group)
    return out
