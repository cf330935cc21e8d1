"""Before and after analysis around a company's anchor violation, for all companies at once."""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.functions import scalars as S
from docketry.operators.aggregates import exact_quantiles, value_before
from docketry.sources.store import written

DAYS = 365
KEY = "company_name_normalized"


def dated(df: DataFrame) -> DataFrame:
    return df.filter(S.filled(KEY) & F.col("violation_date").isNotNull())


def projected(df: DataFrame) -> DataFrame:
    """What the analyses use of the dated rows, stored, as they read it several times."""
    return written(dated(df).select(KEY, "violation_date", *[c for c in ("current_penalty", "agency") if c in df.columns]), "dated")


def anchors(df: DataFrame) -> DataFrame:
    """``key, analysis_type, anchor`` (a date): up to three anchors a company.

    * significant_violation: the first violation with a penalty of at least the
      median that is a year or more after the company's first, else the first
      such at all; without penalties the one nearest to a third of a
      timeline of over 730 days, else the middle one;
    * first_high_penalty: the first with a penalty of at least the upper quartile;
    * first_multi_agency: the first date on which two agencies cited the company.
    """
    return anchors_of(projected(df))


def anchors_of(rows: DataFrame) -> DataFrame:
    """The anchors of dated rows; see ``anchors``."""
    ends = rows.groupBy(KEY).agg(F.min("violation_date").alias("first"), F.max("violation_date").alias("last"), F.count(F.lit(1)).alias("n"))
    stats = written(ends.join(exact_quantiles(rows, [KEY], "current_penalty", {"med": 0.5, "q75": 0.75}), KEY, "left"), "stats")
    joined = rows.join(stats, KEY)
    d, p = F.col("violation_date"), F.col("current_penalty")
    third = F.date_add("first", F.floor(F.datediff("last", "first") / 3).cast("int"))
    nearest = F.min_by("violation_date", F.struct(F.abs(F.datediff(d, third)), d))
    picked = joined.groupBy(KEY).agg(
        F.min(F.when((p >= F.col("med")) & (d >= F.date_add("first", DAYS)), d)).alias("late"), F.min(F.when(p >= F.col("med"), d)).alias("early"), F.min(F.when(p >= F.col("q75"), d)).alias("high"),
        nearest.alias("near"), F.first("med").alias("med"), F.datediff(F.max("last"), F.min("first")).alias("span"),
    )
    # dates are counted first: a company has no more of them than the calendar
    bare = stats.filter("med is null").select(KEY, "n")
    dates = rows.join(bare, KEY).groupBy(KEY, "n", "violation_date").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(KEY).orderBy("violation_date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    half = F.floor(F.col("n") / 2)
    middle = dates.withColumn("i", before).filter((F.col("i") <= half) & (half < F.col("i") + F.col("c"))).select(KEY, F.col("violation_date").alias("middle"))
    picked = picked.join(middle, KEY, "left")
    main = F.when(F.col("med").isNotNull(), F.coalesce("late", "early")).when(F.col("span") > 730, F.col("near")).otherwise(F.col("middle"))
    several = rows.groupBy(KEY, "violation_date").agg(F.count_distinct("agency").alias("a")).filter("a > 1").groupBy(KEY).agg(F.min("violation_date").alias("anchor"))
    each = lambda df_, kind, col: df_.select(KEY, F.lit(kind).alias("analysis_type"), col.alias("anchor")).filter("anchor is not null")
    return (
        each(picked, "significant_violation", main)
        .union(each(picked, "first_high_penalty", F.col("high")))
        .union(each(several, "first_multi_agency", F.col("anchor")))
    )


@lru_cache(maxsize=256)
def _counts(m: int, n: int) -> tuple[int, ...]:
    """Arrangements of m and n untied values by their rank-sum statistic, 0 to m n.

    They are the coefficients of the product of (1 - q^(n + i)) / (1 - q^i) for i = 1 to m.
    """
    c = [1] + [0] * (m * n)
    for i in range(1, m + 1):
        for u in range(m * n, n + i - 1, -1):
            c[u] -= c[u - n - i]
        for u in range(i, m * n + 1):
            c[u] += c[u - i]
    return tuple(c)


def tail(u1: float, n1: int, n2: int, ties: float) -> float:
    """Two-sided p-value of U: exact if it is untied and one side has eight values at most, else normal with ties."""
    n = n1 + n2
    u = max(u1, n1 * n2 - u1)
    if ties == 0 and min(n1, n2) <= 8:
        return min(1.0, 2 * sum(_counts(min(n1, n2), max(n1, n2))[math.ceil(u) :]) / math.comb(n, n1))
    var = n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))
    if var <= 0:
        return 1.0
    z = (u - n1 * n2 / 2 - 0.5) / math.sqrt(var)
    return min(1.0, max(0.0, math.erfc(z / math.sqrt(2))))


@F.pandas_udf(T.DoubleType())
def _p_value(u1: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([round(tail(a, int(b), int(c), d), 4) for a, b, c, d in zip(u1, n1, n2, ties, strict=True)])


def windows(df: DataFrame, anchor: DataFrame, days: int = DAYS) -> DataFrame:
    """Counts, yearly rates and their change around each anchor; the anchor's own day is in neither side."""
    d = F.col("violation_date")
    rows = dated(df).select(KEY, "violation_date")
    near = anchor.join(rows, KEY).withColumn("before", (d < F.col("anchor")) & (d >= F.date_sub("anchor", days))).withColumn("after", (d > F.col("anchor")) & (d <= F.date_add("anchor", days)))
    out = near.groupBy(KEY, "analysis_type", "anchor").agg(F.count(F.lit(1)).alias("n_dated"), F.count_if("before").alias("before_count"), F.count_if("after").alias("after_count"))
    rate = lambda x: F.round(F.col(x) / F.lit(days / 365.0), 4)
    out = out.withColumn("before_rate", rate("before_count")).withColumn("after_rate", rate("after_count"))
    b, a = F.col("before_rate"), F.col("after_rate")
    change = F.when(b > 0, F.round((a - b) / b * 100, 2)).when(a > 0, 100.0).otherwise(0.0)
    return out.withColumn("rate_change_pct", change)


def rank_sums(df: DataFrame, anchor: DataFrame, days: int = DAYS) -> DataFrame:
    """``u1, n1, n2, ties`` of the gaps between violations before and after each anchor.

    Violations are counted by date and gaps by length before anything is put in order, so a window holds at most ``days`` rows.
    """
    by, d = [KEY, "analysis_type", "anchor"], F.col("violation_date")
    dates = dated(df).groupBy(KEY, "violation_date").agg(F.count(F.lit(1)).alias("c"))
    rows = anchor.join(dates, KEY)
    first, second = (d < F.col("anchor")) & (d >= F.date_sub("anchor", days)), (d > F.col("anchor")) & (d <= F.date_add("anchor", days))
    rows = rows.withColumn("side", F.when(first, "b").when(second, "a")).filter("side is not null")
    side = Window.partitionBy(*by, "side")
    rows = rows.withColumn("gap", F.datediff(d, F.lag(d).over(side.orderBy(d)))).withColumn("n", F.sum("c").over(side))
    # violations of a date are 0 days apart; a side with one event has the one gap 365
    each = F.array(F.struct(F.when(F.col("n") == 1, 365).otherwise(F.col("gap")).alias("gap"), F.lit(1).cast("long").alias("t")), F.struct(F.lit(0).alias("gap"), (F.col("c") - 1).alias("t")))
    gaps = rows.select(*by, "side", F.explode(each).alias("g")).select(*by, "side", "g.*").filter("gap is not null and t > 0")
    count = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("t"))), F.lit(0))
    counted = gaps.groupBy(*by, "gap").agg(count("b").alias("b"), count("a").alias("a"), F.sum("t").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy(*by).orderBy("gap").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = counted.withColumn("r", before + (F.col("t") + 1) / F.lit(2.0))
    ties = F.sum(F.col("t") * (F.col("t") * F.col("t") - 1)).cast("double")
    sums = counted.groupBy(*by).agg(F.sum(F.col("b") * F.col("r")).alias("r1"), F.sum("b").alias("n1"), F.sum("a").alias("n2"), ties.alias("ties"))
    return sums.select(*by, (F.col("r1") - F.col("n1") * (F.col("n1") + 1) / F.lit(2.0)).alias("u1"), "n1", "n2", "ties")


def strength(change: Column) -> Column:
    x = F.abs(change)
    return F.when(x >= 100, "Very Strong").when(x >= 50, "Strong").when(x >= 25, "Moderate").when(x >= 10, "Weak").otherwise("Minimal")


def analyses(df: DataFrame, anchor: DataFrame | None = None, days: int = DAYS, least: int = 3) -> DataFrame:
    """Impact of each anchor: change, p-value, type and strength.

    With fewer than ``least`` dated violations nothing can be analysed.  If one
    side is empty p is 0.01 by decree, if both are it is 1; ``p_method`` tells.
    """
    df = projected(df)
    anchor = written(anchors_of(df) if anchor is None else anchor, "anchors")
    by = [KEY, "analysis_type", "anchor"]
    out = windows(df, anchor, days).join(rank_sums(df, anchor, days), by, "left")
    b, a = F.col("before_count"), F.col("after_count")
    method = F.when((b == 0) & (a == 0), "both_empty").when((b == 0) | (a == 0), "one_empty").otherwise("rank_sum")
    out = out.withColumn("p_method", method)
    p = F.when(method == "both_empty", 1.0).when(method == "one_empty", 0.01).otherwise(_p_value(F.coalesce("u1", F.lit(0.0)), F.coalesce("n1", F.lit(1)), F.coalesce("n2", F.lit(1)), F.coalesce("ties", F.lit(0.0))))
    out = out.withColumn("p_value", p)
    enough, sure = F.col("n_dated") >= least, F.col("p_value") < 0.05
    up, down = F.col("after_rate") > F.col("before_rate"), F.col("after_rate") < F.col("before_rate")
    kind = F.when(~enough, "Unable to Analyze").when(~sure, "No Significant Change").when(up, "Increased").when(down, "Reduced").otherwise("No Change")
    change = F.when(enough, F.col("rate_change_pct")).otherwise(0.0)
    out = out.withColumns({"impact": kind, "rate_change_pct": change, "significant": enough & sure})
    return out.withColumn("impact_strength", F.when(kind.isin("Increased", "Reduced"), strength(change)).otherwise("None")).select(
        *by, "n_dated", "before_count", "after_count", "before_rate", "after_rate", "rate_change_pct", "p_method", "p_value", "significant", "impact", "impact_strength"
    )


def summary(found: DataFrame) -> DataFrame:
    """Counts of impact types by company, and the mean change, half a hundredth rounded away from 0."""
    kind = F.col("impact")
    return found.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("total_analyses"), F.count_if(kind == "Increased").alias("increased"), F.count_if(kind == "Reduced").alias("reduced"),
        F.count_if(kind.isin("No Change", "No Significant Change")).alias("no_change"), F.count_if("significant").alias("statistically_significant"), F.round(F.avg(F.col("rate_change_pct").cast("decimal(18,2)")), 2).cast("double").alias("avg_rate_change_pct"),
    )


def timeline(df: DataFrame, anchor: DataFrame) -> DataFrame:
    """Each dated violation as Before, Impact or After its company's anchor."""
    d = F.col("violation_date")
    period = F.when(d < F.col("anchor"), "Before").when(d == F.col("anchor"), "Impact").otherwise("After")
    return dated(df).join(anchor.select(KEY, "analysis_type", "anchor"), KEY).withColumn("period", period)


def gaps(df: DataFrame) -> DataFrame:
    """Days since a company's previous violation; a company's rows are split by dates, however many they are."""
    order = ["violation_date", *[k for k in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "current_penalty") if k in df.columns]]
    (last,) = S.free([*df.columns, "gap_days"], "last_date")
    found = value_before(dated(df), [KEY], order, "violation_date", last)
    return found.withColumn("gap_days", F.datediff("violation_date", last)).drop(last)


def neighbours(df: DataFrame, days: int = DAYS) -> DataFrame:
    """Each company's dates with its violations in the ``days`` before and after.

    Dates are counted first, so a window row is a company's date, not a violation.
    """
    each = dated(df).groupBy(KEY, "violation_date").agg(F.count(F.lit(1)).alias("n"))
    each = each.withColumn("day", F.unix_date("violation_date").cast("long"))
    w = Window.partitionBy(KEY).orderBy("day")
    s = lambda lo, hi: F.coalesce(F.sum("n").over(w.rangeBetween(lo, hi)), F.lit(0))
    return each.select(KEY, "violation_date", "n", s(-days, -1).alias("before_count"), s(1, days).alias("after_count"))
