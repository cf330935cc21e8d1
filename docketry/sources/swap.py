"""Replacing parts of a stored table: what is new is staged beside it, then directories change places.

A table is a folder with a directory a slice or bucket (``agency=EPA``, ``bucket=7``).  New directories are written whole under a
hidden name, then each takes the place of the old one by two renames; the rest of the table isn't touched.  A load that fails
leaves the old rows.  A stop between the renames leaves a directory set aside, which ``recovered`` puts back
before the next change.  Where renames are no single step, as in some object stores, readers must wait until a change has ended.
"""

from __future__ import annotations

import urllib.parse
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.scalars import free

_STAGED, _ASIDE = ".staged-", ".aside-"
_NULL = "__HIVE_DEFAULT_PARTITION__"
#: Buckets of a table that is merged by key; a merge rewrites those that a batch touches.
BUCKETS = 64


class Folder:
    """A folder on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.path = path.rstrip("/")
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.path}/{name}" if name else self.path)

    def has(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def directories(self, name: str = "") -> list[str]:
        """Names of the directories in it, or in one of them."""
        if not self.has(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name)) if s.isDirectory())

    def move(self, name: str, to: str) -> None:
        if not self._fs.rename(self._at(name), self._at(to)):
            raise OSError(f"{self.path}/{name} can't be moved to {to}")

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


def recovered(spark: SparkSession, path: str) -> Folder:
    """The folder, after what a stopped change left in it is put back or removed."""
    folder = Folder(spark, path)
    for name in folder.directories():
        if name.startswith(_ASIDE):
            for part in folder.directories(name):
                if not folder.has(part):
                    folder.move(f"{name}/{part}", part)
            folder.remove(name)
        elif name.startswith(_STAGED):
            folder.remove(name)
    return folder


def swapped_in(folder: Folder, staged: str, gone: list[str] | None = None) -> list[str]:
    """Puts the directories of ``staged`` in place of those of the same names, takes ``gone`` away; the names changed."""
    fresh = [n for n in folder.directories(staged) if "=" in n]
    aside = f"{_ASIDE}{uuid.uuid4().hex}"
    for name in [*fresh, *(gone or [])]:
        if folder.has(name):
            if not folder.has(aside):
                folder._fs.mkdirs(folder._at(aside))
            folder.move(name, f"{aside}/{name}")
        if name in fresh:
            folder.move(f"{staged}/{name}", name)
    folder.remove(aside)
    folder.remove(staged)
    return fresh


def _slice_name(folder: Folder, column: str, value) -> str | None:
    wanted = f"{column}={_NULL if value is None else value}"
    return next((n for n in folder.directories() if urllib.parse.unquote(n) == wanted), None)


def reload_slice(df: DataFrame, path: str, column: str, value, force: bool = True) -> bool:
    """Replaces the rows of the table whose ``column`` is ``value`` by those of ``df`` that have it; False if kept.

    Without ``force`` a slice that has rows is left alone.  No rows empty the slice.  Rows of other values are an error, and
    nothing is changed then, nor if the load fails.
    """
    folder = recovered(df.sparkSession, path)
    old = _slice_name(folder, column, value)
    if old is not None and not force:
        return False
    staged = f"{_STAGED}{uuid.uuid4().hex}"
    df.write.partitionBy(column).parquet(f"{folder.path}/{staged}")
    written = [n for n in folder.directories(staged) if "=" in n]
    if any(urllib.parse.unquote(n) != f"{column}={_NULL if value is None else value}" for n in written):
        folder.remove(staged)
        raise ValueError(f"rows of another {column} than {value!r}: {written}")
    swapped_in(folder, staged, [old] if old is not None and old not in written else [])
    return True


def bucket(key: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def merge_touched(batch: DataFrame, path: str, key: list[str], merge, buckets: int = BUCKETS, batch_id: int | None = None) -> list[int]:
    """Merges a batch into a table bucketed by ``key``; the numbers of the buckets rewritten, which are those of the batch's keys.

    ``merge(old, new)`` gives the rows of the touched buckets; ``old`` is None where there are none yet.  With
    ``batch_id`` each bucket remembers the last batch it took, so a batch that is run again changes nothing in
    buckets that have it already.
    """
    spark = batch.sparkSession
    folder = recovered(spark, path)
    place, last = free(batch.columns, "bucket", "last_batch")
    placed = batch.withColumn(place, bucket(key, buckets))
    touched = sorted(r[0] for r in placed.select(place).distinct().collect())
    there = [b for b in touched if folder.has(f"{place}={b}")]
    old = None
    if there:
        old = spark.read.option("basePath", folder.path).parquet(*[f"{folder.path}/{place}={b}" for b in there])
    if old is not None and batch_id is not None:
        done = {r[0] for r in old.groupBy(place).agg(F.max(last).alias(last)).filter(F.col(last) >= batch_id).collect()}
        touched = [b for b in touched if b not in done]
        placed, old = placed.filter(~F.col(place).isin(*done)) if done else placed, old.filter(~F.col(place).isin(*done)) if done else old
    if not touched:
        return []
    made = merge(None if old is None else old.drop(place, last), placed.drop(place))
    staged = f"{_STAGED}{uuid.uuid4().hex}"
    made = made.withColumn(place, bucket(key, buckets)).withColumn(last, F.lit(-1 if batch_id is None else batch_id).cast("long"))
    made.repartition(F.col(place)).write.partitionBy(place).parquet(f"{folder.path}/{staged}")
    swapped_in(folder, staged)
    return touched


def merged_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table that ``merge_touched`` keeps."""
    return spark.read.parquet(path).drop("bucket", "last_batch")
