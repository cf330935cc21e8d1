"""Composite risk scores, 0 to 100, for all companies in one job.

One grouping by company and standard, then one by company, gives every component.
Components are rounded to two places before they are weighted.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import scalars as S


@dataclass(frozen=True)
class Weights:
    violations: float = 0.30
    penalties: float = 0.25
    recency: float = 0.20
    severity: float = 0.15
    agencies: float = 0.10
    most_violations: int = 1000
    most_penalty: float = 1_000_000
    high_penalty: float = 25_000


def log_score(x: Column, most: float) -> Column:
    """100 at ``most``, 0 at nothing, on a log scale."""
    return F.when(x > 0, F.round(F.least(100 * F.log1p(x.cast("double")) / F.log1p(F.lit(float(most))), F.lit(100.0)), 2)).otherwise(0.0)


def recency_score(days: Column) -> Column:
    """100 up to 30 days ago, 0 from 730; null days score 0."""
    return F.round(F.when(days <= 30, 100.0).when(days >= 730, 0.0).when(days.isNotNull(), 100 * (1 - (days - 30) / F.lit(700.0))).otherwise(0.0), 2)


def severity_score(mean: Column, high_share: Column, repeat_share: Column) -> Column:
    parts = 0.5 * F.least(mean / 50000 * 100, F.lit(100.0)) + 0.3 * high_share * 100 + 0.2 * F.least(repeat_share * 200, F.lit(100.0))
    return F.round(F.least(parts, F.lit(100.0)), 2)


def latest(df: DataFrame) -> date | None:
    """The default day that recency is counted from."""
    return df.agg(F.max("violation_date")).first()[0]


def risk_scores(df: DataFrame, key: str = "company_name_normalized", as_of: date | None = None, weights: Weights = Weights()) -> DataFrame:
    """A row for each ``key``: component scores, composite score, level, and what they are made from."""
    w = weights
    day = F.lit(as_of).cast("date") if as_of else df.agg(F.max("violation_date")).scalar()
    rows = df.filter(S.filled(key))
    p = F.coalesce("current_penalty", F.lit(0.0))
    each = rows.groupBy(key, "standard").agg(
        F.count(F.lit(1)).alias("n"), F.sum(S.cents(p)).alias("s"), F.count_if(p > w.high_penalty).alias("high"),
        F.max("violation_date").alias("last"), F.collect_set("agency").alias("ag"), F.min_by("naics_code", F.when(S.valid_industry("naics_code"), F.col("naics_code"))).alias("code"),
    )
    one = each.groupBy(key).agg(
        F.sum("n").alias("violation_count"), (F.sum("s").cast("double") / 100).alias("total_penalties"), F.sum("high").alias("high"), F.max("last").alias("last"),
        F.count_if(F.col("standard").isNotNull() & (F.col("n") > 1)).alias("repeat"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ag")))).alias("agencies"), F.min("code").alias("code"),
    )
    n = F.col("violation_count")
    scored = one.withColumns({
        "violation_score": log_score(n, w.most_violations),
        "penalty_score": log_score(F.col("total_penalties"), w.most_penalty),
        "recency_score": recency_score(F.datediff(day, "last")),
        "severity_score": severity_score(F.col("total_penalties") / n, F.col("high") / n, F.col("repeat") / n),
        "agency_score": S.agency_count_score(F.size("agencies")),
    })
    parts = (("violation", w.violations), ("penalty", w.penalties), ("recency", w.recency), ("severity", w.severity), ("agency", w.agencies))
    # whole hundredths times whole weights, so that halves round the same way everywhere
    total = sum((F.round(F.col(f"{name}_score") * 100).cast("long") * round(x * 10_000) for name, x in parts), F.lit(0).cast("long"))
    scored = scored.withColumn("composite_score", F.least(F.floor((total + 5000) / 10_000) / 100, F.lit(100.0)))
    return scored.select(
        key, "composite_score", S.risk_level(F.col("composite_score")).alias("risk_level"), "violation_score", "penalty_score", "recency_score", "severity_score", "agency_score",
        "violation_count", "total_penalties", F.array_join("agencies", ",").alias("agencies"), S.iso_date("last").alias("most_recent_violation"), S.sector("code").alias("naics_sector"),
    )


def against_peers(scores: DataFrame) -> DataFrame:
    """Scores beside the mean, median and percentile of their sector (companies with a sector only).

    Scores have two places, so companies are counted by sector and score first: a sector
    has 10,001 counts at most, and windows run over those instead of companies.
    """
    known = scores.filter(F.col("naics_sector").isNotNull()).withColumn("points", F.round(F.col("composite_score") * 100).cast("long"))
    w = Window.partitionBy("naics_sector")
    upto = w.orderBy("points").rowsBetween(Window.unboundedPreceding, -1)
    n, s, low = F.col("peer_count"), F.col("points"), F.col("below")
    counts = known.groupBy("naics_sector", "points").agg(F.count(F.lit(1)).alias("here"))
    counts = counts.withColumns({"below": F.coalesce(F.sum("here").over(upto), F.lit(0)), "peer_count": F.sum("here").over(w), "peer_sum": F.sum(F.col("here") * s).over(w)})
    middle = lambda at: F.max(F.when((low <= at) & (at < low + F.col("here")), s)).over(w)
    median = F.round((middle(F.floor((n - 1) / 2)) + middle(F.floor(n / 2))) / 200, 3)
    counts = counts.select("naics_sector", "points", "below", "peer_count", F.round(F.col("peer_sum") / n / 100, 4).alias("peer_mean"), median.alias("peer_median"))
    out = known.join(F.broadcast(counts), ["naics_sector", "points"])  # sectors are a fixed list
    return out.select(
        *[c for c in ("company_name_normalized",) if c in scores.columns], "naics_sector", "composite_score", "peer_count", "peer_mean", "peer_median",
        F.round(100 * F.col("below") / F.col("peer_count"), 4).alias("percentile"), S.peer_label(F.col("composite_score"), F.col("peer_mean")).alias("comparison"),
    )
