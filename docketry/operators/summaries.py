"""Pre-aggregated summary tables and totals over grouping sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import scalars as S


def _stats() -> list[Column]:
    return [F.count(F.lit(1)).alias("violation_count"), F.coalesce(S.total("current_penalty"), F.lit(0.0)).alias("total_penalties"), F.coalesce(S.mean2("current_penalty"), F.lit(0.0)).alias("avg_penalty")]


def _agency(df: DataFrame, agency: str | None) -> DataFrame:
    return df if agency is None else df.filter(F.col("agency") == agency)


def by_year(df: DataFrame, agency: str | None = None) -> DataFrame:
    rows = _agency(df, agency).filter(F.col("year").isNotNull())
    return rows.groupBy("agency", "year").agg(*_stats(), F.max("current_penalty").alias("max_penalty"), F.min("current_penalty").alias("min_penalty"))


def by_state(df: DataFrame, agency: str | None = None) -> DataFrame:
    """A null year is a group of its own."""
    return _agency(df, agency).filter(S.filled("site_state")).groupBy("agency", "site_state", "year").agg(*_stats())


def by_standard(df: DataFrame, agency: str | None = None) -> DataFrame:
    return _agency(df, agency).filter(S.filled("standard")).groupBy("agency", "standard", "year").agg(*_stats())


def by_company(df: DataFrame, agency: str | None = None) -> DataFrame:
    first, last = F.min("violation_date"), F.max("violation_date")
    rows = _agency(df, agency).filter(S.filled("company_name_normalized"))
    return rows.groupBy("agency", "company_name_normalized").agg(
        *_stats(), first.alias("first_violation_date"), last.alias("last_violation_date"), (F.year(last) - F.year(first) + 1).alias("years_active")
    )


SUMMARIES = {"by_year": by_year, "by_state": by_state, "by_standard": by_standard, "by_company": by_company}


def with_all_years(df: DataFrame, key: str = "site_state") -> DataFrame:
    """By (agency, key, year) and (agency, key); ``all_years`` tells totals from null years."""
    rows = df.filter(S.filled(key))
    out = rows.groupingSets([["agency", key, "year"], ["agency", key]], "agency", key, "year").agg(F.grouping("year").alias("g"), *_stats())
    return out.select("agency", key, "year", (F.col("g") == 1).alias("all_years"), "violation_count", "total_penalties", "avg_penalty")


def refresh(df: DataFrame, path: str, agency: str | None = None) -> dict[str, str]:
    """Writes the four summaries, partitioned by agency; with ``agency`` only its partition is replaced."""
    out = {}
    for name, summary in SUMMARIES.items():
        out[name] = f"{path}/{name}"
        writer = summary(df, agency).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("agency")
        writer.parquet(out[name])
    return out


#: Logarithm of the buckets of a sketch; the error of a count is 0.83 / 2^6 (1.3 %) for one standard deviation.
SKETCH = 12


def company_sketches(df: DataFrame, agency: str | None = None, size: int = SKETCH) -> DataFrame:
    """``agency, year`` and a mergeable sketch of the distinct company names; a null year is a group of its own."""
    rows = _agency(df, agency).filter(S.filled("company_name"))
    return rows.groupBy("agency", "year").agg(F.hll_sketch_agg("company_name", size).alias("companies"))


def companies_in(sketches: DataFrame, first: int | None = None, last: int | None = None, agency: str | None = None) -> DataFrame:
    """One row, ``establishments``: about how many companies were cited in the years, from sketches alone."""
    rows = _agency(sketches, agency)
    rows = rows if first is None else rows.filter(F.col("year") >= first)
    rows = rows if last is None else rows.filter(F.col("year") <= last)
    return rows.agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("companies")), F.lit(0)).alias("establishments"))


def refresh_sketches(df: DataFrame, path: str, agency: str | None = None) -> str:
    """Writes the sketches beside the summaries, partitioned by agency; with ``agency`` only its partition is replaced."""
    out = f"{path}/company_sketches"
    company_sketches(df, agency).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("agency").parquet(out)
    return out
