"""Tables that are changed in place: slices, touched buckets, streams with state."""

import datetime

import pytest
from pyspark.sql import functions as F

from docketry.sources import store, swap
from docketry.streaming import incremental as ST


def table(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(path).select("agency", "x").collect())


def test_slices_are_reloaded_emptied_and_left_alone(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame([("EPA", 1), ("FDA", 2), ("A/B c", 3), (None, 4)], "agency string, x int")
    store.save(df, path, "agency")
    none = df.filter("false")
    assert swap.reload_slice(none, path, "agency", "EPA")
    left = {(r["agency"], r["x"]) for r in spark.read.parquet(path).collect()}
    assert left == {("FDA", 2), ("A/B c", 3), (None, 4)}
    assert swap.reload_slice(df.filter("agency = 'A/B c'").withColumn("x", F.lit(9)), path, "agency", "A/B c")
    assert swap.reload_slice(df.filter("agency is null").withColumn("x", F.lit(8)), path, "agency", None)
    assert swap.reload_slice(df.filter("agency = 'EPA'"), path, "agency", "EPA")
    assert not swap.reload_slice(none, path, "agency", "FDA", force=False)
    want = {("EPA", 1), ("FDA", 2), ("A/B c", 9), (None, 8)}
    assert {(r["agency"], r["x"]) for r in spark.read.parquet(path).collect()} == want
    with pytest.raises(ValueError):
        swap.reload_slice(df, path, "agency", "EPA")
    broken = df.filter("agency = 'EPA'").withColumn("x", F.when(F.col("x") > 0, F.raise_error(F.lit("broken"))).cast("int"))
    with pytest.raises(Exception, match="broken"):
        swap.reload_slice(broken, path, "agency", "EPA")
    swap.recovered(spark, path)
    assert {(r["agency"], r["x"]) for r in spark.read.parquet(path).collect()} == want
    assert [n for n in swap.Folder(spark, path).directories() if n.startswith(".")] == []


def test_a_stop_while_directories_change_places(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame([("EPA", 1), ("FDA", 2)], "agency string, x int")
    store.save(df, path, "agency")
    move, moves = swap.Folder.move, []

    def once(self, name, to):
        if moves:
            raise KeyboardInterrupt
        moves.append(name)
        move(self, name, to)

    monkeypatch.setattr(swap.Folder, "move", once)
    with pytest.raises(KeyboardInterrupt):
        swap.reload_slice(df.filter("agency = 'EPA'").withColumn("x", F.lit(7)), path, "agency", "EPA")
    monkeypatch.setattr(swap.Folder, "move", move)
    assert table(spark, path) == [("FDA", 2)]  # set aside, not lost
    swap.recovered(spark, path)
    assert table(spark, path) == [("EPA", 1), ("FDA", 2)]


def test_upserts_rewrite_touched_buckets_only(spark, tmp_path):
    path = f"file://{tmp_path}/u"
    old = spark.range(400).select(F.col("id").alias("k"), F.lit(1).alias("ver"), F.lit("a").alias("v"))
    assert store.upsert_table(old, path, ["k"], "ver", 16) == list(range(16))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "u").rglob("*.parquet")}
    new = spark.createDataFrame([(7, 2, "b"), (7, 1, "c"), (9, 0, "late"), (1000, 1, "n")], "k long, ver int, v string")
    touched = store.upsert_table(new, path, ["k"], "ver", 16)
    assert 1 <= len(touched) <= 3
    kept = {p for p in (tmp_path / "u").rglob("*.parquet") if before.get(p) == p.stat().st_mtime_ns}
    assert {int(p.parent.name.split("=")[1]) for p in kept} == set(range(16)) - set(touched)
    got = {r["k"]: (r["ver"], r["v"]) for r in swap.merged_table(spark, path).collect()}
    assert len(got) == 401 and got[7] == (2, "b") and got[9] == (1, "a") and got[1000] == (1, "n")
    assert store.upsert_table(new.limit(0), path, ["k"], "ver", 16) == []


def test_a_batch_that_is_run_again_counts_once(spark, tmp_path, monkeypatch):
    path, seen = f"file://{tmp_path}/s", []
    merge = lambda old, new: (new if old is None else old.unionByName(new)).groupBy("g").agg(F.sum("n").alias("n"))
    batch = spark.range(40).select((F.col("id") % 20).alias("g"), F.lit(1).alias("n")).groupBy("g").agg(F.sum("n").alias("n"))
    swap.merge_touched(batch, path, ["g"], merge, 8, batch_id=0)
    move = swap.Folder.move

    def some(self, name, to):
        seen.append(name)
        if len(seen) == 6:
            raise KeyboardInterrupt
        move(self, name, to)

    monkeypatch.setattr(swap.Folder, "move", some)
    with pytest.raises(KeyboardInterrupt):
        swap.merge_touched(batch, path, ["g"], merge, 8, batch_id=1)
    monkeypatch.setattr(swap.Folder, "move", move)
    swap.merge_touched(batch, path, ["g"], merge, 8, batch_id=1)
    swap.merge_touched(batch, path, ["g"], merge, 8, batch_id=1)
    assert {r["g"]: r["n"] for r in swap.merged_table(spark, path).collect()} == dict.fromkeys(range(20), 4)


def test_event_time_windows_with_a_flush(spark, tmp_path):
    df = spark.range(240).select(F.timestamp_seconds(1_700_000_000 + F.col("id") * 3600).alias("ts"), (F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("value"))
    path, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    run = lambda: ST.event_time_summary(ST.files(spark, path, df.schema, per_batch=1), out, state, "ts", ["g"], "value", "1 day", "6 hours")
    want = lambda rows: sorted(map(tuple, rows.groupBy(F.window("ts", "1 day").start.alias("window_start"), "g").agg(F.count("*").alias("n"), F.sum("value").alias("t")).collect()))
    for k in range(2):
        df.filter(f"floor(value / 60) = {k}").coalesce(1).write.mode("append").parquet(path)
    assert sorted(map(tuple, run().collect())) == want(df.filter("value < 120"))
    for k in range(2, 4):
        df.filter(f"floor(value / 60) = {k}").coalesce(1).write.mode("append").parquet(path)
    # resumed after the flush, nothing is lost or counted twice
    assert sorted(map(tuple, run().collect())) == want(df)
    # what the watermark has passed isn't kept in the state
    held = ST.open_windows(spark, state, ["g"])
    closed = df.agg(F.max("ts")).first()[0] - datetime.timedelta(hours=6)
    assert 0 < held.count() < len(want(df)) / 2
    assert held.filter(F.col("window_start") + F.expr("interval 1 day") < F.lit(closed)).isEmpty()


def test_late_rows_are_told(spark, tmp_path):
    df = spark.createDataFrame([(datetime.datetime(2024, 1, d), 1.0) for d in (1, 20, 21, 2)], "ts timestamp, value double")
    path = f"file://{tmp_path}/in"
    for d in (1, 20, 21, 2):
        df.filter(F.dayofmonth("ts") == d).coalesce(1).write.mode("append").parquet(path)
    stream = ST.running_summary(ST.files(spark, path, df.schema, per_batch=1), "ts", [], "value", "1 day", "2 days")
    query = ST.run_to_parquet(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    assert ST.late_rows(query) == 1


def test_summary_rewrites_the_buckets_of_a_batch(spark, tmp_path):
    df = spark.range(300).select(F.col("id").alias("g"), F.col("id").cast("double").alias("value"))
    path, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "sum", "state"))
    run = lambda: ST.upsert_summary(ST.files(spark, path, df.schema, per_batch=1), out, state, ["g"], "value", 16)[0]
    df.coalesce(1).write.parquet(path)
    assert run().count() == 300
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "sum").rglob("*.parquet")}
    df.filter("g = 5").coalesce(1).write.mode("append").parquet(path)
    assert {r["g"]: r["violation_count"] for r in run().filter("g in (5, 6)").collect()} == {5: 2, 6: 1}
    fresh = [p for p in (tmp_path / "sum").rglob("*.parquet") if p not in before]
    assert len({p.parent.name for p in fresh}) == 1


def test_progress_has_rates_and_goes_on(spark, tmp_path):
    path, out, state, log = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state", "log"))
    run = lambda: ST.load_progress(ST.files(spark, path, spark.range(1).schema, per_batch=1), out, state, log)
    spark.range(6).repartition(3).write.parquet(path)
    first = run()
    batches = first.count()
    assert first.filter("rows_per_second > 0").count() == batches >= 3 and first.agg({"rows": "sum"}).first()[0] == 6
    spark.range(4).coalesce(1).write.mode("append").parquet(path)
    again = run()
    assert again.agg({"rows": "sum"}).first()[0] == 10 and again.count() == batches + 1
    assert spark.read.parquet(out).count() == 10


def test_intermediate_tables_are_removed(spark):
    kept = store.written(spark.range(3), "kept")
    assert kept.count() == 3 and store.clean(spark) >= 1
    assert store.clean(spark) == 0 and not store.has_rows(spark, kept.inputFiles()[0])
