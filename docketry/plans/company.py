"""Everything about one searched company, or about all of them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.names import measure, normalized
from docketry.operators import aggregates, impact, risk
from docketry.operators.search import matching, page


def search_company(df: DataFrame, name: str, agencies=None, fuzzy: bool = True, threshold: float = 75, limit: int = 100, offset: int = 0, prefilter: str | None = None) -> DataFrame:
    """Rows of companies like ``name`` with the similarity, best first, one page.

    Every distinct name is scored; with ``prefilter='substring'`` only those that hold the argument are, which is
    faster and finds no misspellings.
    """
    rows = matching(df, agencies=agencies, company=name if prefilter == "substring" or not fuzzy else None)
    order = ["company_name", "agency", "activity_nr", *[c for c in ("l_linenumber", "l_partkey", "l_suppkey", "current_penalty") if c in df.columns]]
    if not fuzzy:
        return page(rows, order, limit, offset)
    names = rows.select("company_name_normalized").distinct()
    scored = names.withColumn("t", normalized(F.lit(name))).withColumn("similarity", measure("weighted", "company_name_normalized", "t")).drop("t")
    hits = rows.join(scored.filter(F.col("similarity") >= threshold), "company_name_normalized")
    return page(hits, [F.desc("similarity"), *order], limit, offset)


def matched(df: DataFrame, name: str, agencies=None) -> DataFrame:
    """All rows of the searched company, under one constant key."""
    return matching(df, agencies=agencies, company=name).withColumn("company_name_normalized", F.lit(name))


def company_risk(df: DataFrame, name: str, as_of: date | None = None) -> DataFrame:
    """Risk of all matched rows as one company."""
    return risk.risk_scores(matched(df, name), as_of=as_of or risk.latest(df))


def company_report(df: DataFrame, name: str, as_of: date | None = None) -> DataFrame:
    """One row: breakdown by agency, histograms of types, and risk."""
    rows = matched(df, name)
    types = aggregates.type_histogram(rows).groupBy("company_name_normalized").agg(F.array_sort(F.collect_list(F.struct("agency", F.to_json("violation_types").alias("types")))).alias("types"))
    return aggregates.company_breakdown(rows).join(types, "company_name_normalized").join(company_risk(df, name, as_of), "company_name_normalized").withColumnRenamed("company_name_normalized", "company")


def company_impact(df: DataFrame, name: str) -> DataFrame:
    return impact.analyses(matched(df, name))
