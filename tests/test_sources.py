import pytest
from pyspark.sql import functions as F

from docketry.sources import conform, schemas, store
from docketry.streaming import incremental as ST


def write(tmp_path, name, text):
    p = tmp_path / name
    p.mkdir()
    (p / "part1.csv").write_text(text)
    return f"file://{p}"


def test_inspections(spark, tmp_path):
    path = write(tmp_path, "i", 'activity_nr,estab_name,site_state,open_date,year\n1,"A ""x"",\nB",ca,2020-01-02,\n1,Z,CA,2019-01-01,2018\n , blank,CA,,\n2,C,,not a date,\n')
    rows = {r["activity_nr"]: r for r in conform.unique_inspections(conform.inspections(conform.read_csv(spark, path, schemas.RAW_INSPECTIONS))).collect()}
    assert set(rows) == {"1", "2"}
    assert rows["1"]["year"] == 2018 and rows["1"]["estab_name"] == "Z"
    assert rows["2"]["open_date"] is None and rows["2"]["year"] is None and rows["2"]["site_state"] is None


def test_accident_layouts(spark, tmp_path):
    mine = write(tmp_path, "m", "mine_id,document_no,operator_name,fips_state_cd,ai_dt,ai_year,ai_narr,inj_degr_desc,degree_injury_cd,nature_injury\n7,9,Op,06,01/31/2015,,text,,1,\n,9,Op,06,,,,fatality,,cut\n")
    read = lambda p: conform.accidents(spark.read.option("header", True).csv(p)).collect()
    (r,) = read(mine)
    assert (r["accident_key"], r["year"], r["fatality"], r["injury_type"]) == ("7_9", 2015, True, None)
    report = write(tmp_path, "f", "summary_nr,event_date,event_desc,abstract_text,fatality,event_keyword\n5,2014-05-06,fall,,X,kw\n")
    (r,) = read(report)
    assert (r["description"], r["fatality"], r["year"]) == ("fall", True, 2014)
    plain = write(tmp_path, "s", "accident_key,fatality,accident_date\na,1,2013-01-01\nb,0,\n,1,\n")
    assert {r["accident_key"]: r["fatality"] for r in read(plain)} == {"a": True, "b": False}


def test_sources_and_registry(spark):
    raw = spark.createDataFrame([("Mill, Inc.", "12.5", "2020-02-03")], "facility_name string, penalty_amount string, violation_date string")
    r = conform.agency_violations(raw, "EPA").first()
    assert (r["company_name_normalized"], float(r["current_penalty"]), r["year"], r["agency"]) == ("MILL", 12.5, 2020, "EPA")
    assert conform.agency_violations(conform.empty_source(spark, "FDA"), "FDA").count() == 0
    schemas.register(schemas.AgencySource("X", "n", ("n",), {"company_name": "n"}))
    assert conform.agency_violations(spark.createDataFrame([("Q",)], "n string"), "X").first()["company_name"] == "Q"
    del schemas.SOURCES["X"]


def test_store(spark, tmp_path):
    df = spark.createDataFrame([("EPA", 1), ("FDA", 2)], "agency string, x int")
    path = f"file://{tmp_path}/t"
    assert store.save(df, path, "agency", force=False)
    assert not store.save(df, path, "agency", force=False)
    store.save(df.filter("agency = 'EPA'").withColumn("x", F.lit(9)), path, "agency")
    assert {(r["agency"], r["x"]) for r in spark.read.parquet(path).collect()} == {("EPA", 9), ("FDA", 2)}
    with pytest.raises(ValueError):
        store.load_all({}, path, ["nothing"])
    new = store.upserted(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, ver int, v string"), spark.createDataFrame([(1, 1, "c")], "k int, ver int, v string"), ["k"], "ver")
    assert {(r["k"], r["v"]) for r in new.collect()} == {(1, "c"), (2, "b")}


def test_streams_equal_batch(spark, tmp_path):
    df = spark.range(100).select(F.col("id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 3600).alias("ts"), (F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("value"))
    path = f"file://{tmp_path}/e"
    df.repartitionByRange(4, "ts").write.parquet(path)
    df.write.mode("append").parquet(path)
    once = ST.ingest(spark, path, df.schema, lambda s: ST.deduplicated(s, ["id"], "ts", "30 days"))
    assert once.count() == 100
    merged, query = ST.upsert_summary(ST.files(spark, path, df.schema, per_batch=2), f"file://{tmp_path}/u", f"file://{tmp_path}/c", ["g"], "value")
    assert {r["g"]: r["violation_count"] for r in merged.collect()} == {0: 68, 1: 66, 2: 66}
    assert sum(p["rows"] for p in ST.progress(query)) == 200
    alerts = ST.ingest(spark, path, df.schema, lambda s: ST.alerts(s, "value", 97))
    assert sorted(r["id"] for r in alerts.collect()) == [98, 98, 99, 99]
    plain = f"file://{tmp_path}/p"
    df.repartitionByRange(4, "ts").write.parquet(plain)
    summed = ST.ingest(spark, plain, df.schema, lambda s: ST.running_summary(s, "ts", ["g"], "value", "1 day", "1 hour"))
    want = df.groupBy(F.window("ts", "1 day").start.alias("window_start"), "g").agg(F.count("*").alias("n"))
    both = summed.join(want, ["window_start", "g"])
    assert both.count() == summed.count() > 0 and both.filter("n <> violation_count").count() == 0


def test_windows_are_whole_whatever_the_order(spark, tmp_path):
    df = spark.range(240).select(F.timestamp_seconds(1_700_000_000 + F.col("id") * 3600).alias("ts"), (F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("value"))
    path = f"file://{tmp_path}/late"
    for k in (3, 1, 0, 2):
        df.filter(f"floor(value / 60) = {k}").coalesce(1).write.mode("append").parquet(path)
    got = ST.windowed_summary(ST.files(spark, path, df.schema, per_batch=1), f"file://{tmp_path}/w", f"file://{tmp_path}/s", "ts", ["g"], "value")
    want = df.groupBy(F.window("ts", "1 day").start.alias("window_start"), "g").agg(F.count("*").alias("violation_count"), F.sum("value").alias("total"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_resumed_summary_and_progress(spark, tmp_path):
    from docketry.streaming import incremental as ST

    df = spark.createDataFrame([(k % 3, float(k)) for k in range(60)], "g int, value double")
    path, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    df.repartition(3).write.parquet(path)
    run = lambda: ST.upsert_summary(ST.files(spark, path, df.schema, per_batch=1), out, state, ["g"], "value")[0]
    first = sorted(map(tuple, run().collect()))
    assert sorted(map(tuple, run().collect())) == first and sum(r[1] for r in first) == 60  # nothing new
    df.limit(6).coalesce(1).write.mode("append").parquet(path)
    assert sum(r["violation_count"] for r in run().collect()) == 66
    empty = f"file://{tmp_path}/empty"
    df.filter("false").coalesce(1).write.parquet(empty)
    assert ST.upsert_summary(ST.files(spark, empty, df.schema), f"{out}-e", f"{state}-e", ["g"], "value")[0].filter("violation_count > 0").count() == 0
    done = ST.load_progress(ST.files(spark, path, df.schema, per_batch=1), f"{out}-p", f"{state}-p")
    assert done.count() >= 3 and done.agg({"rows": "sum"}).first()[0] == 66


def test_progress_of_more_batches_than_spark_remembers(spark, tmp_path):
    from docketry.streaming import incremental as ST

    path = f"file://{tmp_path}/many"
    spark.range(12).repartition(12).write.parquet(path)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        done = ST.load_progress(ST.files(spark, path, spark.range(1).schema, per_batch=1), f"{path}-o", f"{path}-s")
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert done.agg({"rows": "sum"}).first()[0] == 12 and done.count() > 2


def test_clashing_names(spark):
    old = spark.createDataFrame([(1, 1, "a", 7)], "k int, ver int, fresh string, place int")
    new = spark.createDataFrame([(1, 1, "c", 8)], "k int, ver int, fresh string, place int")
    assert [tuple(r) for r in store.upserted(old, new, ["k"], "ver").collect()] == [(1, 1, "c", 8)]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    context = SimpleNamespace(getConf=lambda: {}, master="spark://host:7077")
    with pytest.raises(ValueError):
        store.scratch(SimpleNamespace(sparkContext=context), "x")
