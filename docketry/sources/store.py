"""Writing tables as partitioned Parquet, loading whole sets, incremental upserts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions.scalars import free
from docketry.sources import swap

TABLES = ("inspections", "violations", "accidents")
#: Temporary folders of sessions that run in one process.
_own: dict[str, str] = {}
#: Intermediate tables of each session.
_made: dict[str, list[str]] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir.

    Where that isn't set, a session in one process uses a temporary folder; on a cluster it is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="docketry-"))
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clean(spark: SparkSession) -> int:
    """Removes the intermediate tables that this session has made so far, once the results that read them are stored or read; their number."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        swap.Folder(spark, path).remove("")
    return len(paths)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a Parquet table in the shared folder, so that what follows doesn't run the plan again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def has_rows(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.parquet(path).limit(1).isEmpty()
    except Exception as e:  # the folder may not be there yet
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise


def save(df: DataFrame, path: str, partition: str | None = None, force: bool = True) -> bool:
    """Replaces the partitions that ``df`` has rows of (all, without a partition column); False if kept.

    Without ``force`` a table that has rows is left alone.
    """
    if not force and has_rows(df.sparkSession, path):
        return False
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    return True


def append(df: DataFrame, path: str, partition: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def load_all(found: dict[str, DataFrame], path: str, tables: Iterable[str] = TABLES, force: bool = True) -> dict[str, bool]:
    """Saves the chosen tables; ValueError for an unknown one."""
    tables = list(tables)
    if unknown := set(tables) - set(TABLES):
        raise ValueError(f"unknown tables: {sorted(unknown)}")
    return {t: save(found[t], f"{path}/{t}", "agency" if t == "violations" else None, force) for t in tables}


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """``table, row_count, has_rows``."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count", (F.col("row_count") > 0).alias("has_rows"))
        out = one if out is None else out.union(one)
    return out


def completeness(expected: dict[str, DataFrame], actual: dict[str, DataFrame]) -> DataFrame:
    """Rows expected and found by table, and what is missing."""
    e = table_stats(expected).select("table_name", F.col("row_count").alias("expected_rows"))
    a = table_stats(actual).select("table_name", F.col("row_count").alias("actual_rows"))
    j = e.join(a, "table_name", "left").withColumn("actual_rows", F.coalesce("actual_rows", F.lit(0)))
    return j.withColumn("missing_rows", F.col("expected_rows") - F.col("actual_rows")).withColumn("complete", F.col("missing_rows") <= 0)


def newer_than(df: DataFrame, column: str, last) -> DataFrame:
    return df.filter(F.col(column) > F.lit(last))


def upserted(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """Old and new rows, the latest version of each key."""
    fresh, place = free([*old.columns, *new.columns], "fresh", "place")
    w = Window.partitionBy(*key).orderBy(F.desc(version), F.desc(fresh))
    both = old.withColumn(fresh, F.lit(0)).unionByName(new.withColumn(fresh, F.lit(1)), allowMissingColumns=True)
    return both.withColumn(place, F.row_number().over(w)).filter(F.col(place) == 1).drop(place, fresh)


def upsert_table(new: DataFrame, path: str, key: list[str], version: str, buckets: int = swap.BUCKETS) -> list[int]:
    """Brings the latest version of each key of ``new`` into a stored table; only the buckets of its keys are rewritten, whose numbers are given back."""
    return swap.merge_touched(new, path, key, lambda old, fresh: upserted(fresh.limit(0) if old is None else old, fresh, key, version), buckets)
