"""CSV parts with headers of their own as one table, by name; what can't be used is told, not lost.

A survey of the parts' lines, one distributed scan, gives each part's header and whether a quoted field of it goes over
a line's end.  Parts with the same header are read together, and only those with such fields as whole files; the others are
split like any text.  Names are matched without regard to case, blanks around them or a byte-order mark.

Lines with more filled fields than the header has are bad: they go to a side table with their file.  Shorter lines are filled up with
nulls.  A part that can't be read (a damaged archive, say) and one whose header has no wanted
column are skipped and reported with the reason; an empty one is passed over.  The driver holds a line a part, no rows.
"""

from __future__ import annotations

import csv
import urllib.parse
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OPTIONS = {"escape": '"', "mode": "PERMISSIVE"}


@dataclass
class Parts:
    """Rows by name, ``file, line`` of the bad lines, and the parts skipped with the reason."""

    rows: DataFrame
    bad_lines: DataFrame
    skipped: list[tuple[str, str]] = field(default_factory=list)


def _survey(spark: SparkSession, files: list[str]) -> dict[str, tuple[str, bool]]:
    """For each file its first line, and whether any line leaves a quote open."""
    lines = spark.read.text(files).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    first = F.min_by("value", F.when(F.col("start") == 0, F.col("place")))
    found = lines.groupBy("file").agg(first.alias("header"), F.max(quotes % 2 == 1).alias("open"))
    return {urllib.parse.unquote(r["file"]): (r["header"], r["open"]) for r in found.collect()}


def _surveyed(spark: SparkSession, files: list[str]) -> tuple[dict[str, tuple[str, bool]], list[tuple[str, str]]]:
    """The survey of the files that can be read, and the others with the reason."""
    if not files:
        return {}, []
    try:
        return _survey(spark, files), []
    except Exception as e:  # one damaged part fails the whole scan
        if len(files) == 1:
            return {}, [(files[0], str(e).strip().split("\n")[0][:200])]
    half = len(files) // 2
    (a, x), (b, y) = _surveyed(spark, files[:half]), _surveyed(spark, files[half:])
    return a | b, x + y


def _names(header: str) -> tuple[str, ...]:
    """The header's names, lower case; a name that comes again, or none, gets its place."""
    out: list[str] = []
    for k, name in enumerate(next(csv.reader([header.lstrip("﻿")]), [])):
        name = name.strip().lower()
        out.append(name if name and name not in out else f"{name}_{k}")
    return tuple(out)


def by_name(df: DataFrame, schema: str) -> DataFrame:
    """The columns of ``schema`` in order; missing ones null."""
    have = {c.lower(): c for c in df.columns}
    fields = T._parse_datatype_string(schema).fields
    return df.select(*[F.col(f"`{have[f.name]}`").cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in fields])


def read_parts(spark: SparkSession, path: str | list[str], schema: str) -> Parts:
    """All parts of a folder, pattern or list of files as the columns of ``schema``."""
    listed = sorted(r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect())
    found, skipped = _surveyed(spark, listed)
    wanted = {f.name for f in T._parse_datatype_string(schema).fields}
    groups: dict[tuple[tuple[str, ...], bool], list[str]] = defaultdict(list)
    for p in sorted(set(listed) - {p for p, _ in skipped}):
        header, is_open = found.get(urllib.parse.unquote(p), (None, False))
        names = _names(header or "")
        if wanted & set(names):
            groups[names, is_open].append(p)
        else:
            skipped.append((p, "no wanted column"))
    rows, bad = spark.createDataFrame([], schema), spark.createDataFrame([], "file string, line string")
    for (names, is_open), files in sorted(groups.items()):
        columns = [f"c{k}" for k in range(len(names))]
        strings = ", ".join(f"{c} string" for c in columns)
        # one field more than the header has, so that a long line shows; its whole text is that of the bad record
        raw = spark.read.options(**_OPTIONS, header=True, multiLine=is_open, columnNameOfCorruptRecord="bad", columnPruning=False).schema(f"{strings}, more string, bad string").csv(files)
        raw = raw.withColumn("long", F.coalesce(F.col("more") != "", F.lit(False)))
        good = raw.filter(~F.col("long")).select(*[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)])
        rows = rows.unionByName(by_name(good, schema))
        bad = bad.unionByName(raw.filter("long").select(F.col("_metadata.file_path").alias("file"), F.coalesce("bad", "more").alias("line")))
    return Parts(rows, bad, sorted(skipped))
