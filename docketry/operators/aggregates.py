"""Fixed aggregations over violations and inspections."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import scalars as S
from docketry.sources.store import written


def _n() -> Column:
    return F.count(F.lit(1))


def _of_year(df: DataFrame, year: int | None) -> DataFrame:
    return df if year is None else df.filter(F.col("year") == year)


def top_violations(df: DataFrame, n: int = 10, year: int | None = None) -> DataFrame:
    """Most cited standards; ties by standard."""
    rows = _of_year(df, year).filter(S.filled("standard"))
    out = rows.groupBy("standard").agg(_n().alias("citation_count"), F.coalesce(S.mean2("current_penalty"), F.lit(0.0)).alias("avg_penalty"))
    return out.orderBy(F.desc("citation_count"), "standard").limit(n)


def by_state(df: DataFrame, year: int | None = None) -> DataFrame:
    rows = _of_year(df, year).filter(S.filled("site_state"))
    out = rows.groupBy(F.col("site_state").alias("state")).agg(_n().alias("violation_count"), F.coalesce(S.total("current_penalty"), F.lit(0.0)).alias("total_penalties"))
    return out.orderBy(F.desc("violation_count"), "state")


def by_industry(df: DataFrame, n: int = 15, year: int | None = None) -> DataFrame:
    """Violations with a known industry by two-digit sector."""
    rows = _of_year(df, year).filter(S.valid_industry("naics_code"))
    out = rows.groupBy(S.sector("naics_code").alias("naics_sector")).agg(_n().alias("violation_count"), F.coalesce(S.mean2("current_penalty"), F.lit(0.0)).alias("avg_penalty"))
    return out.withColumn("sector_name", S.sector_name("naics_sector")).orderBy(F.desc("violation_count"), "naics_sector").limit(n)


def known_sectors(df: DataFrame) -> DataFrame:
    """The least known sector of each company; one row a company, so that it can be joined instead of looked up."""
    rows = df.filter(S.valid_industry("naics_code") & S.filled("company_name_normalized"))
    return rows.groupBy("company_name_normalized").agg(F.min(S.sector("naics_code")).alias("known_sector"))


def classified_companies(df: DataFrame, year: int | None = None, top_companies: int | None = None) -> DataFrame:
    """Companies of unknown industry with count, mean penalty and sector (null if none is told).

    The sector is that known for the same company in any year, else what words in
    the name tell.  Company names without letters have none.
    """
    rows = _of_year(df, year).filter(S.unknown_industry("naics_code"))
    groups = rows.groupBy("company_name", "company_name_normalized").agg(_n().alias("c"), F.sum(S.cents("current_penalty")).alias("s"), F.count("current_penalty").alias("k"))
    if top_companies is not None:
        groups = groups.orderBy(F.desc("c"), "company_name", "company_name_normalized").limit(top_companies)
    told = F.coalesce("known_sector", S.sector_from_words("company_name"))
    joined = groups.join(known_sectors(df), "company_name_normalized", "left")
    return joined.withColumn("sector", F.when(S.filled("company_name"), told))


def by_industry_classified(df: DataFrame, n: int = 15, year: int | None = None, top_companies: int | None = None) -> DataFrame:
    """Sectors of known and classified violations; what can't be told is sector 00.

    A sector's mean is that of its groups' means weighted by their rows; groups
    without a mean or with a mean of 0 count for nothing in it.
    """
    mean = lambda s, k: F.when(k > 0, s / k / 100)
    weighted = lambda c, m: (
        F.sum(F.when(m != 0, m * c)).alias("w"),
        F.sum(F.when(m != 0, c)).alias("wc"),
    )
    rows = _of_year(df, year).filter(S.valid_industry("naics_code"))
    known = rows.groupBy(S.sector("naics_code").alias("sector")).agg(_n().alias("c"), F.sum(S.cents("current_penalty")).alias("s"), F.count("current_penalty").alias("k"))
    known = known.select("sector", "c", mean(F.col("s"), F.col("k")).alias("m"))
    told = classified_companies(df, year, top_companies).withColumn("m", mean(F.col("s"), F.col("k")))
    sector = F.coalesce("sector", F.lit("00"))
    told = told.groupBy(sector.alias("sector")).agg(F.sum("c").alias("c"), *weighted(F.col("c"), F.col("m")))
    told = told.select("sector", "c", F.when(F.col("sector") != "00", F.col("w") / F.col("wc")).alias("m"))
    both = known.union(told).groupBy("sector").agg(F.sum("c").alias("violation_count"), *weighted(F.col("c"), F.col("m")))
    out = both.select(
        F.col("sector").alias("naics_sector"), "violation_count", S.sector_name("sector").alias("sector_name"), F.coalesce(F.round(F.col("w") / F.col("wc"), 2), F.lit(0.0)).alias("avg_penalty")
    )
    return out.orderBy(F.desc("violation_count"), "naics_sector").limit(n)


def penalty_summary(df: DataFrame, group_by: str = "viol_type") -> DataFrame:
    """Count, total, mean and maximum by viol_type, standard or state; empty for another key."""
    key = {"viol_type": "viol_type", "standard": "standard", "state": "site_state"}.get(group_by)
    rows = df.filter(S.filled(key)) if key else df.filter(F.lit(False))
    out = rows.groupBy(F.col(key or "viol_type").alias("group_key")).agg(
        _n().alias("violation_count"), S.total("current_penalty").alias("total_penalty"), S.mean2("current_penalty").alias("avg_penalty"), F.max("current_penalty").alias("max_penalty")
    )
    return out.orderBy(F.desc("total_penalty"), "group_key")


def trend(df: DataFrame, state: str | None = None, min_year: int = 2000) -> DataFrame:
    """Rows by year (violations or inspections)."""
    rows = df.filter(F.col("year") >= min_year)
    rows = rows if state is None else rows.filter(F.col("site_state") == state.upper())
    return rows.groupBy("year").agg(_n().alias("row_count")).orderBy("year")


def penalty_trend(df: DataFrame, state: str | None = None, min_year: int = 2000) -> DataFrame:
    rows = df.filter(F.col("year") >= min_year)
    rows = rows if state is None else rows.filter(F.col("site_state") == state.upper())
    return rows.groupBy("year").agg(F.coalesce(S.total("current_penalty"), F.lit(0.0)).alias("total_penalty")).orderBy("year")


def industry_benchmark(df: DataFrame, naics: str) -> DataFrame:
    """One industry (two digits) beside the whole, in one scan."""
    inside = F.coalesce(S.sector("naics_code") == naics[:2], F.lit(False))
    mine = F.when(inside, F.col("current_penalty"))
    out = df.agg(
        F.count_if(inside).alias("industry_violations"), F.coalesce(S.mean2(mine), F.lit(0.0)).alias("industry_avg_penalty"), _n().alias("national_violations"), F.coalesce(S.mean2("current_penalty"), F.lit(0.0)).alias("national_avg_penalty")
    )
    return out.select(F.lit(naics[:2]).alias("naics_sector"), "*", F.round(100 * S.per(F.col("industry_violations"), F.col("national_violations")), 4).alias("pct_of_national"))


def overview(df: DataFrame, year: int | None = None, state: str | None = None) -> DataFrame:
    rows = _of_year(df, year)
    rows = rows if state is None else rows.filter(F.col("site_state") == state.upper())
    return rows.agg(_n().alias("total_violations"), F.coalesce(S.total("current_penalty"), F.lit(0.0)).alias("total_penalties"), F.coalesce(S.mean2("current_penalty"), F.lit(0.0)).alias("avg_penalty"))


def establishments(df: DataFrame, column: str = "company_name", approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.filter(S.filled(column)).agg(count(F.col(column)).alias("establishments"))


def year_penalties(df: DataFrame, year: int) -> DataFrame:
    """Penalties of a year; mean, sum, least and most over those above 0."""
    p = S.positive("current_penalty")
    return _of_year(df, year).agg(
        _n().alias("total_violations"), F.count(p).alias("with_penalty"), S.mean2(p).alias("avg_penalty"), S.total(p).alias("total_penalty"), F.min(p).alias("min_penalty"), F.max(p).alias("max_penalty")
    )


def company_breakdown(df: DataFrame) -> DataFrame:
    """A row for each company: an array of its agencies with count, total, mean and maximum penalty."""
    each = df.filter(S.filled("company_name_normalized")).groupBy("company_name_normalized", "agency").agg(
        _n().alias("violation_count"), F.coalesce(S.total("current_penalty"), F.lit(0.0)).alias("total_penalties"), F.coalesce(S.mean2("current_penalty"), F.lit(0.0)).alias("avg_penalty"), F.max("current_penalty").alias("max_penalty")
    )
    packed = F.array_sort(F.collect_list(F.struct("agency", "violation_count", "total_penalties", "avg_penalty", "max_penalty")))
    return each.groupBy("company_name_normalized").agg(packed.alias("agencies"))


def type_histogram(df: DataFrame) -> DataFrame:
    """``company_name_normalized, agency`` and a map from violation type to rows."""
    each = df.filter(S.filled("company_name_normalized") & F.col("viol_type").isNotNull()).groupBy("company_name_normalized", "agency", "viol_type").agg(_n().alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("viol_type", "n")))
    return each.groupBy("company_name_normalized", "agency").agg(F.map_from_entries(entries).alias("violation_types"))


def cross_agency(df: DataFrame, agencies: Sequence[str], min_violations: int = 1) -> DataFrame:
    """Companies that two agencies or more cited ``min_violations`` times each, a column an agency."""
    rows = df.filter(S.filled("company_name_normalized") & F.col("agency").isin(*agencies))
    wide = rows.groupBy("company_name_normalized").pivot("agency", list(agencies)).agg(_n()).na.fill(0)
    enough = [F.when(F.col(a) >= min_violations, F.col(a)).otherwise(F.lit(0)).alias(a) for a in agencies]
    wide = wide.select("company_name_normalized", *enough)
    return wide.filter(sum((F.col(a) > 0).cast("int") for a in agencies) > 1)


def repeat_standards(df: DataFrame) -> DataFrame:
    """Standards that a company was cited for more than once."""
    each = df.filter(S.filled("company_name_normalized") & F.col("standard").isNotNull()).groupBy("company_name_normalized", "standard").agg(_n().alias("n"))
    return each.groupBy("company_name_normalized").agg(F.count_if(F.col("n") > 1).alias("repeat_standards"))


def shared_dates(df: DataFrame) -> DataFrame:
    """Dates on which more than one agency cited a company."""
    each = df.filter(S.filled("company_name_normalized") & F.col("violation_date").isNotNull()).groupBy("company_name_normalized", "violation_date")
    return each.agg(F.count_distinct("agency").alias("agencies")).filter("agencies > 1")


def penalty_quantiles(df: DataFrame) -> DataFrame:
    """Exact median and upper quartile of each company's penalties, interpolated."""
    found = exact_quantiles(df.filter(S.filled("company_name_normalized")), ["company_name_normalized"], "current_penalty", {"median_penalty": 0.5, "q75_penalty": 0.75})
    return found.select("company_name_normalized", *[F.round(c, 4).alias(c) for c in ("median_penalty", "q75_penalty")])


def available_agencies(df: DataFrame) -> DataFrame:
    return df.filter(F.col("agency").isNotNull()).select("agency").distinct()


def citation_pairs(df: DataFrame, least: int = 2) -> DataFrame:
    """Pairs of standards cited together in ``least`` inspections or more.

    Pairs are made within one inspection's distinct standards, which are few.
    """
    sets = df.filter(S.filled("standard") & S.filled("activity_nr")).groupBy("activity_nr").agg(F.array_sort(F.collect_set("standard")).alias("s"))
    first = sets.filter(F.size("s") > 1).select("s", F.posexplode("s").alias("i", "standard_a"))
    pairs = first.select("standard_a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("standard_b"))
    return pairs.groupBy("standard_a", "standard_b").agg(_n().alias("inspections")).filter(F.col("inspections") >= least)


def seasonal(df: DataFrame) -> DataFrame:
    rows = df.filter(F.col("violation_date").isNotNull())
    return rows.groupBy(F.year("violation_date").alias("year"), F.month("violation_date").alias("month")).agg(_n().alias("violation_count"))


def joined_inspections(violations: DataFrame, inspections: DataFrame) -> DataFrame:
    """Every violation with its inspection's columns; of repeated inspections the first by date and name counts."""
    cols = [x for x in ("estab_name", "site_state", "naics_code", "open_date", "close_case_date", "inspection_type") if x in inspections.columns]
    right = first_by_key(inspections, "activity_nr", ["open_date", "estab_name"]).select("activity_nr", *[F.col(x).alias(f"inspection_{x}" if x in violations.columns else x) for x in cols])
    return violations.join(right, "activity_nr", "left")


def first_by_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row for each key, the first by ``order``; rows without a key are dropped.

    The order covers all columns in the end, so that the choice is the same in
    every run; a partial aggregate leaves one row a key and task to shuffle.
    """
    rest = [x for x in df.columns if x not in (key, *order)]
    plain = [x for x in rest if not dict(df.dtypes)[x].startswith("map")]
    rank = F.struct(*order, *plain)
    out = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*[x for x in df.columns if x != key]), rank).alias("r"))
    return out.select(*[F.col(key) if x == key else F.col(f"r.{x}").alias(x) for x in df.columns])


def sums_before(df: DataFrame, order: Sequence[Column | str], name: str, by: Sequence[str] = (), value: str | None = None) -> DataFrame:
    """Each row with the sum of ``value`` (or the number of rows) that come before it inside ``by``.

    Rows are dealt out by ranges of the order; a row's sum is that of the ranges before its own
    plus one inside it, so no task holds a whole group.
    """
    amount, part, start = S.free([*df.columns, name], "amount", "part", "start")
    ranged = df.withColumn(amount, F.col(value) if value else F.lit(1).cast("long")).repartitionByRange(*by, *order)
    ranged = written(ranged.withColumn(part, F.spark_partition_id()), "ranged")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(*by, part).agg(F.sum(amount).alias(start))
    starts = starts.withColumn(start, F.coalesce(F.sum(start).over(before(Window.partitionBy(*by).orderBy(part))), F.lit(0)))
    inside = F.coalesce(F.sum(amount).over(before(Window.partitionBy(*by, part).orderBy(*order))), F.lit(0))
    their = S.free([*ranged.columns, name, start], *[f"{k}_{b}" for k, b in enumerate([*by, part])])
    starts = starts.select(*[F.col(b).alias(t) for b, t in zip([*by, part], their, strict=True)], start)
    same = reduce(lambda x, y: x & y, [F.col(b).eqNullSafe(F.col(t)) for b, t in zip([*by, part], their, strict=True)])
    out = ranged.withColumn(name, inside).join(starts, same)
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c != name], (F.col(name) + F.col(start)).alias(name))


def ranked(df: DataFrame, order: Sequence[Column | str], name: str = "row_number") -> DataFrame:
    """Rows numbered inside their agency (null is one of them)."""
    found = sums_before(df, order, name, ["agency"])
    return found.withColumn(name, (F.col(name) + 1).cast("int"))


def exact_median(df: DataFrame, column: str) -> DataFrame:
    """One row, ``median``: of the values counted and put in order by ranges; null without values."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    placed = sums_before(counted, ["value"], "before", value="n")
    total = placed.agg(F.sum("n")).scalar()
    at = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col("value")))
    return placed.withColumn("lo", F.floor((total - 1) / 2)).withColumn("hi", F.floor(total / 2)).agg(((at(F.col("lo")) + at(F.col("hi"))) / 2).alias("median"))


def exact_quantiles(df: DataFrame, by: Sequence[str], column: str, at: dict[str, float]) -> DataFrame:
    """Exact quantiles of the values of each group, interpolated between neighbours; a column for each of ``at``.

    Equal values are counted first, and the counts put in order by ranges inside a group, so a group with many rows is
    split over tasks and none holds its values.  Rows without a value, or without a whole key, are left out.
    """
    value, n, before, total, *their = S.free([*by, *at], "value", "n", "before", "total", *[f"{k}_{b}" for k, b in enumerate(by)])
    rows = df.filter(F.col(column).isNotNull()).na.drop(subset=list(by))
    counted = rows.groupBy(*by, F.col(column).cast("double").alias(value)).agg(F.count(F.lit(1)).alias(n))
    placed = sums_before(counted, [*by, value], before, by, n)
    totals = placed.groupBy(*[F.col(b).alias(t) for b, t in zip(by, their, strict=True)]).agg(F.sum(n).alias(total))
    placed = placed.join(totals, reduce(lambda x, y: x & y, [F.col(b) == F.col(t) for b, t in zip(by, their, strict=True)]))

    def quantile(q: float) -> Column:
        place = q * (F.col(total) - 1)
        holds = lambda k: (F.col(before) <= k) & (k < F.col(before) + F.col(n))
        low, high = F.max(F.when(holds(F.floor(place)), F.col(value))), F.max(F.when(holds(F.ceil(place)), F.col(value)))
        place = q * (F.max(total) - 1)
        return F.when(F.floor(place) == F.ceil(place), low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return placed.groupBy(*by).agg(*[quantile(q).alias(name) for name, q in at.items()])


def value_before(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Each row with the ``value`` of the row before it inside ``by``, by ``order``; null for a group's first row.

    Rows are dealt out by ranges of the order; the last value of each range is carried on to the next one of
    the group, so no task holds a whole group.
    """
    part, last, first, *their = S.free([*df.columns, name], "part", "last", "first", *[f"{k}_{b}" for k, b in enumerate([*by, "part"])])
    ranged = written(df.repartitionByRange(*by, *order).withColumn(part, F.spark_partition_id()), "ranged")
    inside = Window.partitionBy(*by, part).orderBy(*order)
    ends = ranged.groupBy(*by, part).agg(F.max_by(value, F.struct(*order)).alias(last))
    ends = ends.withColumn(last, F.lag(last).over(Window.partitionBy(*by).orderBy(part)))
    ends = ends.select(*[F.col(b).alias(t) for b, t in zip([*by, part], their, strict=True)], last)
    same = reduce(lambda x, y: x & y, [F.col(b).eqNullSafe(F.col(t)) for b, t in zip([*by, part], their, strict=True)])
    out = ranged.withColumn(first, F.row_number().over(inside) == 1).withColumn(name, F.lag(value).over(inside)).join(ends, same)
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c != name], F.when(F.col(first), F.col(last)).otherwise(F.col(name)).alias(name))
