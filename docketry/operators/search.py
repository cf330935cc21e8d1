"""Filtered search with stable paging."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.names import normalized
from docketry.functions.scalars import c, filled

MOST_ROWS = 10_000


def matching(
    df: DataFrame,
    *,
    agency: str | None = None,
    state: str | None = None,
    naics_prefix: str | None = None,
    year: int | None = None,
    keyword: str | None = None,
    min_penalty: float | None = None,
    company: str | None = None,
    agencies: Iterable[str] | None = None,
    keyword_columns: Sequence[str] = ("company_name", "standard"),
) -> DataFrame:
    """Rows that meet every filter given; texts are literal, not patterns. 0 is a filter, None is not."""
    tests: list[Column] = []
    if agency is not None:
        tests.append(F.col("agency") == agency)
    if agencies is not None:
        tests.append(F.col("agency").isin(*agencies))
    if state is not None:
        tests.append(F.col("site_state") == state.upper())
    if naics_prefix is not None:
        tests.append(F.col("naics_code").startswith(naics_prefix))
    if year is not None:
        tests.append(F.col("year") == year)
    if keyword is not None:
        hits = [F.coalesce(contains(k, keyword), F.lit(False)) for k in available(df, keyword_columns)]
        tests.append(F.greatest(*hits, F.lit(False)))
    if min_penalty is not None:
        tests.append(F.col("current_penalty") >= min_penalty)
    if company is not None:
        tests.append(names_company(company))
    for t in tests:
        df = df.filter(t)
    return df


def contains(column: Column | str, text: str) -> Column:
    """Whatever the case."""
    return F.lower(c(column)).contains(text.lower())


def names_company(name: str) -> Column:
    """The normalised name holds the normalised argument, or the raw name the raw one."""
    return F.col("company_name_normalized").contains(normalized(F.lit(name))) | contains("company_name", name)


def available(df: DataFrame, candidates: Sequence[str]) -> list[str]:
    """Those of ``candidates`` that ``df`` has, in their order; a look at the schema only."""
    return [k for k in candidates if k in df.columns]


def first_available(df: DataFrame, candidates: Sequence[str]) -> str | None:
    return next(iter(available(df, candidates)), None)


def _asked(limit: int, offset: int) -> int:
    """The limit, if page and place can be asked for."""
    if not 1 <= limit <= MOST_ROWS or offset < 0:
        raise ValueError(f"a page has 1 to {MOST_ROWS} rows and doesn't begin before the first")
    return limit


def page(df: DataFrame, order: Sequence[Column | str], limit: int = 100, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` by a total order; a ``limit`` over ``MOST_ROWS`` is an error."""
    size = _asked(limit, offset)
    return df.orderBy(*order).offset(offset).limit(size)


def page_metadata(df: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """``total, page_limit, page_offset, has_next, has_previous``."""
    n = df.agg(F.count(F.lit(1)).alias("total"))
    size = _asked(limit, offset)
    return n.select(
        "total",
        F.lit(size).alias("page_limit"),
        F.lit(offset).alias("page_offset"),
        (F.col("total") > offset + size).alias("has_next"),
        F.lit(offset > 0).alias("has_previous"),
    )


def count_matching(df: DataFrame, **filters) -> DataFrame:
    return matching(df, **filters).agg(F.count(F.lit(1)).alias("total"))


def distinct_values(df: DataFrame, column: str, least: int | None = None) -> DataFrame:
    """Sorted distinct values of a column, none empty, none under ``least``."""
    values = df.filter(F.col(column) >= least if least is not None else filled(column)).select(column).distinct()
    return values.orderBy(column)


def sample(df: DataFrame, key: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """``n`` random rows, those with the smallest hashes of seed and key; the same on every run."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    return df.orderBy(order, *key).limit(n)
