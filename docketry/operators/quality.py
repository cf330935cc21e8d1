"""Data-quality checks as tables, each from one pass over the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import scalars as S
from docketry.functions.lookups import STATES
from docketry.operators.aggregates import exact_median

SCHEMA = "check string, severity string, column string, failing_rows long, total_rows long, message string"


def _n() -> Column:
    return F.count(F.lit(1))


def _exploded(one: DataFrame, rows: list[tuple[str, str, str, Column, Column]]) -> DataFrame:
    """A row for each (check, severity, column, failing, fails) that fails."""
    items = F.array(*[
        F.struct(F.lit(a).alias("check"), F.lit(b).alias("severity"), F.lit(c).alias("column"), n.cast("long").alias("failing_rows"), F.col("total").alias("total_rows"), bad.alias("bad")) for a, b, c, n, bad in rows
    ])
    out = one.select(F.explode(items).alias("x")).select("x.*").filter("bad").drop("bad")
    return out.withColumn("message", F.concat_ws(" ", F.col("column"), F.lit("fails"), F.col("check"), F.lit("in"), F.col("failing_rows"), F.lit("of"), F.col("total_rows"), F.lit("rows")))


def structure(df: DataFrame, required: Sequence[str] = (), most_null: float = 0.5) -> DataFrame:
    """Empty table, missing columns (by the schema), columns with too many nulls."""
    cols = df.columns
    one = df.agg(_n().alias("total"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(cols)])
    rows = [("empty_table", "error", "*", F.lit(0), F.col("total") == 0)]
    rows += [("missing_column", "error", c, F.lit(0), F.lit(True)) for c in required if c not in cols]
    rows += [("null_rate", "warning", c, F.col(f"n{i}"), F.col(f"n{i}") > most_null * F.col("total")) for i, c in enumerate(cols)]
    return _exploded(one, rows)


def years(df: DataFrame, column: str = "year", least: int = 1900, most: int = 2100) -> DataFrame:
    y = F.col(column)
    one = df.agg(_n().alias("total"), F.count_if(y.isNull()).alias("nulls"), F.count_if((y < least) | (y > most)).alias("out"))
    return _exploded(one, [("year_null", "warning", column, F.col("nulls"), F.col("nulls") > 0), ("year_range", "error", column, F.col("out"), F.col("out") > 0)])


def year_stats(df: DataFrame, column: str = "year") -> DataFrame:
    return df.agg(F.min(column).alias("min_year"), F.max(column).alias("max_year"), F.count(column).alias("year_count"))


def penalties(df: DataFrame, column: str = "current_penalty", most: float = 10_000_000) -> DataFrame:
    p = F.col(column)
    one = df.agg(_n().alias("total"), F.count_if(p < 0).alias("neg"), F.count_if((p < 0) | (p > most)).alias("out"))
    return _exploded(one, [("penalty_negative", "warning", column, F.col("neg"), F.col("neg") > 0), ("penalty_range", "warning", column, F.col("out"), F.col("out") > 0)])


def penalty_stats(df: DataFrame, column: str = "current_penalty") -> DataFrame:
    one = df.agg(F.min(column).alias("min_penalty"), F.max(column).alias("max_penalty"), S.mean2(column).alias("mean_penalty"))
    return one.crossJoin(exact_median(df, column).select(F.round("median", 3).alias("median_penalty")))  # one row each


def states(df: DataFrame, column: str = "site_state") -> DataFrame:
    """Distinct values that are no state code, with their rows."""
    value = F.upper(F.col(column))
    return df.filter(F.col(column).isNotNull()).groupBy(value.alias("state")).agg(_n().alias("failing_rows")).filter(~F.col("state").isin(*STATES))


def names(df: DataFrame, column: str = "company_name", longest: int = 500) -> DataFrame:
    n = F.col(column)
    one = df.agg(_n().alias("total"), F.count_if(n == "").alias("empty"), F.count_if(F.length(n) > longest).alias("long"), F.count_if(n.isNull()).alias("nulls"))
    return _exploded(one, [(f"name_{k}", "warning", column, F.col(k), F.col(k) > 0) for k in ("empty", "long", "nulls")])


def comprehensive(df: DataFrame, required: Sequence[str] = ()) -> DataFrame:
    """All checks whose column the table has."""
    pick = lambda *cs: next((c for c in cs if c in df.columns), None)
    parts = [structure(df, required)]
    if c := pick("year"):
        parts.append(years(df, c))
    if c := pick("current_penalty", "penalty"):
        parts.append(penalties(df, c))
    if c := pick("company_name", "estab_name"):
        parts.append(names(df, c))
    if c := pick("site_state", "state"):
        bad = states(df, c).agg(F.coalesce(F.sum("failing_rows"), F.lit(0)).alias("f")).crossJoin(df.agg(_n().alias("total")))  # one row each
        parts.append(_exploded(bad, [("state_code", "warning", c, F.col("f"), F.col("f") > 0)]))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def reject_reasons(df: DataFrame) -> Column:
    """Why a violation is no good: an array, empty for good rows."""
    tests = {
        "year_range": (F.col("year") < 1900) | (F.col("year") > 2100),
        "penalty_range": (F.col("current_penalty") < 0) | (F.col("current_penalty") > 10_000_000),
        "state_code": ~F.upper("site_state").isin(*STATES),
        "name_missing": ~S.filled("company_name"),
    }
    return F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), k) for k, t in tests.items()]), lambda x: x.isNotNull())


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad rows with their reasons."""
    tagged = df.withColumn("reject_reasons", reject_reasons(df))
    return tagged.filter(F.size("reject_reasons") == 0).drop("reject_reasons"), tagged.filter(F.size("reject_reasons") > 0)
