"""Raw extracts to the common model; columns that a file lacks are typed nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.names import normalized
from docketry.functions.scalars import cleaned, filled, number, parsed_date
from docketry.operators.aggregates import first_by_key
from docketry.sources import schemas
from docketry.sources.csv_parts import by_name, read_parts

#: Descriptions are cut to this many characters, names to 500, as the common model says.
TEXT = 10_000


def read_csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """All part files of a folder or pattern as one table, by the names of each part's header; see ``csv_parts`` for what is skipped."""
    return read_parts(spark, path, schema).rows


def combine(parts: list[DataFrame]) -> DataFrame:
    """Parts with differing columns as one table."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _col(df: DataFrame, *names: str) -> Column:
    """The first column there is, else null."""
    return next((F.col(f"`{n}`") for n in names if n in df.columns), F.lit(None).cast("string"))


def _year(df: DataFrame, date: Column, *names: str) -> Column:
    return F.coalesce(*[number(_col(df, n), "int") for n in names or ("year",)], F.year(date)).cast("int")


def inspections(raw: DataFrame) -> DataFrame:
    """Trimmed and cut; year from its column, else from the date, row by row; no row without a key."""
    opened = parsed_date(_col(raw, "open_date"))
    out = raw.select(
        cleaned(_col(raw, "activity_nr"), 50).alias("activity_nr"), cleaned(_col(raw, "estab_name"), 500).alias("estab_name"), F.upper(cleaned(_col(raw, "site_state"), 2)).alias("site_state"),
        cleaned(_col(raw, "naics_code"), 10).alias("naics_code"), opened.alias("open_date"), parsed_date(_col(raw, "close_case_date")).alias("close_case_date"), _year(raw, opened).alias("year"),
        cleaned(_col(raw, "inspection_type", "insp_type"), 100).alias("inspection_type"),
    )
    return out.filter(F.col("activity_nr").isNotNull())


def unique_inspections(df: DataFrame) -> DataFrame:
    return first_by_key(df, "activity_nr", ["open_date", "estab_name"])


def violations(raw: DataFrame, agency: str, fill_penalties: bool = False) -> DataFrame:
    """Violations (already joined with their inspections) in the common schema."""
    name = cleaned(_col(raw, "estab_name", "company_name"), 500)
    day = parsed_date(_col(raw, "open_date", "violation_date"))
    money = lambda c: F.coalesce(number(_col(raw, c)), F.lit(0).cast("decimal(18,2)")) if fill_penalties else number(_col(raw, c))
    text = {"standard": 50, "viol_type": 50, "description": TEXT, "site_city": 100, "naics_code": 10, "sic_code": 10, "facility_id": 100, "violation_type": 100, "enforcement_action": 200}
    out = raw.select(
        F.lit(agency).alias("agency"), name.alias("company_name"), normalized(name).alias("company_name_normalized"), cleaned(_col(raw, "activity_nr"), 50).alias("activity_nr"),
        *[cleaned(_col(raw, k), n).alias(k) for k, n in text.items()], *[money(c).alias(c) for c in ("initial_penalty", "current_penalty", "fta_penalty")],
        F.upper(cleaned(_col(raw, "site_state"), 2)).alias("site_state"), day.alias("violation_date"), _year(raw, day).alias("year"),
    )
    return by_name(out, schemas.VIOLATIONS)


def agency_violations(raw: DataFrame, agency: str) -> DataFrame:
    """An agency's extract by its registered mapping."""
    source = schemas.SOURCES[agency]
    return violations(raw.select(*[_col(raw, theirs).alias(ours) for ours, theirs in source.mapping.items()]), agency)


def empty_source(spark: SparkSession, agency: str) -> DataFrame:
    """The agency's columns without rows, for agencies without a file."""
    return spark.createDataFrame([], ", ".join(f"{c} string" for c in schemas.SOURCES[agency].columns))


def accident_layout(columns: list[str]) -> str:
    if {"mine_id", "ai_dt"} <= set(columns):
        return "mine"
    return "fatality" if {"summary_nr", "event_date"} <= set(columns) else "standard"


def accidents(raw: DataFrame) -> DataFrame:
    """Accidents from any of the three layouts, told by the header; no row without a key."""
    layout = accident_layout(raw.columns)
    if layout == "mine":
        day = parsed_date(_col(raw, "ai_dt"))
        degree = cleaned(_col(raw, "inj_degr_desc"))
        key = F.when(filled(cleaned(_col(raw, "mine_id"))), F.concat_ws("_", cleaned(_col(raw, "mine_id")), cleaned(_col(raw, "document_no"))))
        found = {
            "accident_key": F.substring(key, 1, 50), "estab_name": cleaned(_col(raw, "operator_name"), 500), "site_state": F.upper(cleaned(_col(raw, "fips_state_cd"), 2)),
            "accident_date": day, "year": _year(raw, day, "ai_year", "cal_yr"), "description": cleaned(_col(raw, "ai_narr"), TEXT),
            "fatality": F.when(degree.isNotNull(), F.upper(degree).contains("FATAL")).otherwise(F.coalesce(number(_col(raw, "degree_injury_cd"), "int") == 1, F.lit(False))),
            "injury_type": F.coalesce(cleaned(_col(raw, "nature_injury"), 100), F.substring(degree, 1, 100)),
        }
    elif layout == "fatality":
        day = parsed_date(_col(raw, "event_date"))
        found = {
            "accident_key": cleaned(_col(raw, "summary_nr"), 50), "site_state": F.upper(cleaned(_col(raw, "state_flag"), 2)), "accident_date": day, "year": _year(raw, day),
            "description": F.nullif(F.substring(F.concat_ws(" | ", cleaned(_col(raw, "event_desc")), cleaned(_col(raw, "abstract_text"))), 1, TEXT), F.lit("")),
            "fatality": F.coalesce(F.upper(cleaned(_col(raw, "fatality"))) == "X", F.lit(False)), "injury_type": cleaned(_col(raw, "event_keyword"), 100),
        }
    else:
        day = parsed_date(_col(raw, "accident_date"))
        flag = F.coalesce(number(_col(raw, "fatality"), "double") != 0, _col(raw, "fatality").cast("string").try_cast("boolean"))
        found = {
            "accident_key": cleaned(_col(raw, "accident_key"), 50), "activity_nr": cleaned(_col(raw, "activity_nr"), 50), "estab_name": cleaned(_col(raw, "estab_name"), 500), "site_state": F.upper(cleaned(_col(raw, "site_state"), 2)),
            "naics_code": cleaned(_col(raw, "naics_code"), 10), "accident_date": day, "year": _year(raw, day), "description": cleaned(_col(raw, "description"), TEXT), "fatality": flag, "injury_type": cleaned(_col(raw, "injury_type"), 100),
        }
    return by_name(raw.select(*[e.alias(k) for k, e in found.items()]), schemas.ACCIDENTS).filter(F.col("accident_key").isNotNull())


def backfill_year(df: DataFrame, date: str = "violation_date") -> DataFrame:
    """Null years from the first four characters of the date."""
    text = F.col(date).cast("string")
    return df.withColumn("year", F.coalesce("year", F.when(F.length(text) >= 4, F.substring(text, 1, 4).try_cast("int"))))


def backfill_report(df: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return df.agg(n.alias("total"), F.count("year").alias("with_year"), (n - F.count("year")).alias("without_year"), F.min("year").alias("min_year"), F.max("year").alias("max_year"), F.round(F.coalesce(F.try_divide(100.0 * F.count("year"), n), F.lit(0.0)), 2).alias("pct"))
