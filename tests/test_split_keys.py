"""What puts a key's rows in order without holding them in one task, against plain forms."""

import gzip
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from docketry.functions import names as N
from docketry.operators import aggregates as A
from docketry.operators import impact as I
from docketry.operators import resolve as R
from docketry.operators import summaries
from docketry.sources import conform, csv_parts, schemas

KEY = "company_name_normalized"


@pytest.fixture(autouse=True)
def small_ranges(spark):
    """Small tables are kept in several ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows are one company's."""
    rng = random.Random(8)
    rows = []
    for k in range(1500):
        name = "HOT" if k % 3 == 0 else f"C{rng.randrange(40)}"
        day = date(2000, 1, 1) + timedelta(days=int(rng.paretovariate(0.7) * 9) % 2500) if rng.random() < 0.95 else None
        rows.append((name, day, rng.choice([None, 0.0, 10.0, 10.0, rng.random() * 99]), rng.choice(["OSHA", "EPA"]), k))
    rows += [("ONE", date(2001, 1, 1), None, "EPA", 1), ("NONE", None, None, "EPA", 2), (None, date(2001, 1, 1), 5.0, "EPA", 3)]
    return spark.createDataFrame(rows, f"{KEY} string, violation_date date, current_penalty double, agency string, l_orderkey long").repartition(6).cache()


def test_quantiles(hot):
    got = {r[KEY]: (r["a"], r["b"], r["c"]) for r in A.exact_quantiles(hot, [KEY], "current_penalty", {"a": 0.5, "b": 0.75, "c": 1.0}).collect()}
    rows = hot.filter(F.col(KEY).isNotNull() & F.col("current_penalty").isNotNull())
    want = {r[0]: tuple(r)[1:] for r in rows.groupBy(KEY).agg(F.median("current_penalty"), F.percentile("current_penalty", 0.75), F.max("current_penalty")).collect()}
    assert got == want and "ONE" not in got
    assert A.exact_quantiles(hot.filter("false"), [KEY], "current_penalty", {"a": 0.5}).count() == 0


def test_a_hot_key_is_split(spark, hot):
    placed = A.value_before(hot.filter(f"{KEY} = 'HOT'").withColumn("last", F.lit(1)), [KEY], ["violation_date", "l_orderkey"], "l_orderkey", "before")
    ranges = hot.filter(f"{KEY} = 'HOT'").repartitionByRange(KEY, "violation_date", "l_orderkey").groupBy(F.spark_partition_id()).count()
    assert ranges.count() > 1 and placed.columns[-2:] == ["last", "before"]
    want = hot.filter(f"{KEY} = 'HOT'").withColumn("before", F.lag("l_orderkey").over(Window.partitionBy(KEY).orderBy("violation_date", "l_orderkey")))
    assert sorted(placed.select("l_orderkey", "before").collect(), key=str) == sorted(want.select("l_orderkey", "before").collect(), key=str)


def test_gaps(hot):
    w = Window.partitionBy(KEY).orderBy("violation_date", "l_orderkey", "current_penalty")
    want = I.dated(hot).withColumn("gap_days", F.datediff("violation_date", F.lag("violation_date").over(w)))
    got = I.gaps(hot)
    assert sorted(map(tuple, got.select(KEY, "l_orderkey", "gap_days").collect()), key=str) == sorted(map(tuple, want.select(KEY, "l_orderkey", "gap_days").collect()), key=str)
    assert got.filter("gap_days is null").count() == got.select(KEY).distinct().count()


def test_rank_sums(spark, hot):
    anchors = I.anchors(hot)
    got = {tuple(r)[:3]: tuple(r)[3:] for r in I.rank_sums(hot, anchors, 200).collect()}
    days = {}
    for r in I.dated(hot).collect():
        days.setdefault(r[KEY], []).append(r["violation_date"])
    want = {}
    for r in anchors.collect():
        sides = []
        for low, high in ((-200, -1), (1, 200)):
            inside = sorted(d for d in days[r[KEY]] if low <= (d - r["anchor"]).days <= high)
            sides.append([(y - x).days for x, y in zip(inside, inside[1:], strict=False)] if len(inside) > 1 else [365] * len(inside))
        every = sorted(sides[0] + sides[1])
        if every:
            rank = {g: every.index(g) + (every.count(g) + 1) / 2 for g in every}
            n1 = len(sides[0])
            want[tuple(r)] = (sum(rank[g] for g in sides[0]) - n1 * (n1 + 1) / 2, n1, len(sides[1]), float(sum(every.count(g) ** 3 - every.count(g) for g in set(every))))
    assert got == want and len(want) > 30


def test_middle_of_companies_without_penalties(spark):
    rows = [("A", date(2000, 1, 1) + timedelta(days=d), None, "EPA") for d in (0, 0, 5, 5, 5, 9, 400)] + [("B", date(2000, 1, 1), None, "EPA")]
    df = spark.createDataFrame(rows, f"{KEY} string, violation_date date, current_penalty double, agency string")
    got = {(r[KEY], r["analysis_type"]): r["anchor"] for r in I.anchors(df).collect()}
    assert got == {("A", "significant_violation"): date(2000, 1, 6), ("B", "significant_violation"): date(2000, 1, 1)}


def test_sketches_merge_over_years(spark, tmp_path):
    df = spark.range(60_000).select(F.concat(F.lit("Company "), F.col("id") % 7000).alias("company_name"), (F.col("id") % 5 + 2000).cast("int").alias("year"), F.when(F.col("id") % 2 == 0, "EPA").otherwise("FDA").alias("agency"))
    df = df.union(spark.createDataFrame([(None, 2001, "EPA"), ("", 2001, "EPA"), ("No year", None, "EPA")], df.schema))
    summaries.refresh_sketches(df, f"file://{tmp_path}")
    stored = spark.read.parquet(summaries.refresh_sketches(df.filter("agency = 'EPA'"), f"file://{tmp_path}", "EPA"))
    for first, last, agency in ((None, None, None), (2001, 2003, None), (2002, 2002, "EPA"), (2050, None, None)):
        rows = df.filter(F.col("company_name") != "")
        rows = rows.filter(F.col("year") >= first) if first else rows
        rows = rows.filter(F.col("year") <= last) if last else rows
        rows = rows.filter(F.col("agency") == agency) if agency else rows
        exact = rows.select("company_name").distinct().count()
        assert abs(summaries.companies_in(stored, first, last, agency).first()[0] - exact) <= 4 * 0.013 * exact


def test_names_that_sound_alike(spark):
    names = spark.createDataFrame([(n,) for n in ("ROBERT", "RUPERT", "RUBIN", "1ST")], "norm string")
    got = {r["norm"]: (r["code"], r["leader"], r["similarity"]) for r in R.sound_groups(names).collect()}
    assert got["RUPERT"] == ("R163", "ROBERT", round(N.similarity("RUPERT", "ROBERT"), 6)) and got["RUBIN"][1] == "RUBIN" and got["ROBERT"][2] == 100


def test_parts_with_headers_of_their_own(spark, tmp_path):
    d = tmp_path / "parts x"
    d.mkdir()
    (d / "a.csv").write_text("activity_nr,estab_name\n1,Bolt\n")
    (d / "b.csv").write_text("﻿Estab_Name, activity_nr ,site_state,other\nNut,2,ca,z\nshort,3\nlong,4,tx,z,more,and more\ntrailing,5,tx,z,,\n")
    (d / "c.csv").write_text('activity_nr,estab_name\n6,"over\ntwo ""lines"", really"\n7,plain\n')
    (d / "d.csv").write_text("x,y\n1,2\n")
    (d / "e.csv").write_text("")
    (d / "f.csv.gz").write_bytes(gzip.compress(b"activity_nr\n8\n"))
    (d / "g.csv.gz").write_bytes(gzip.compress(b"activity_nr\n" + bytes(range(48, 58)) * 5000)[:60])
    (d / "h.csv").write_text("activity_nr,activity_nr,,estab_name\n9,x,,Twice\n")
    found = csv_parts.read_parts(spark, f"file://{d}", schemas.RAW_INSPECTIONS)
    got = {r["activity_nr"]: (r["estab_name"], r["site_state"]) for r in found.rows.collect()}
    assert got == {"1": ("Bolt", None), "2": ("Nut", "ca"), "3": ("short", None), "5": ("trailing", "tx"), "6": ('over\ntwo "lines", really', None), "7": ("plain", None), "8": (None, None), "9": ("Twice", None)}
    assert [(r["file"].split("/")[-1], r["line"]) for r in found.bad_lines.collect()] == [("b.csv", "long,4,tx,z,more,and more")]
    assert [(p.split("/")[-1], why if why == "no wanted column" else "damaged") for p, why in found.skipped] == [("d.csv", "no wanted column"), ("g.csv.gz", "damaged")]
    rows = conform.read_csv(spark, [f"file://{d}/a.csv", f"file://{d}/b.csv"], schemas.RAW_INSPECTIONS)
    assert rows.count() == 4 and conform.inspections(rows).filter("site_state = 'CA'").first()["activity_nr"] == "2"


def test_a_large_part_is_split(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("activity_nr,estab_name\n" + "\n".join(f"{k},name {k}" for k in range(40_000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = csv_parts.read_parts(spark, f"file://{path}", schemas.RAW_INSPECTIONS).rows
        assert rows.select(F.spark_partition_id()).distinct().count() > 4
        assert rows.count() == 40_000 and rows.agg(F.sum("activity_nr")).first()[0] == sum(range(40_000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
