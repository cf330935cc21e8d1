"""Structured Streaming forms of loading, enriching and summarising.

Queries run with ``availableNow`` over file sources, so a stream run to its end
equals the batch result, except where a function has a watermark: it tells which
rows it drops.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from docketry.functions import scalars as S
from docketry.sources import swap
from docketry.sources.store import has_rows, scratch, written


def files(spark: SparkSession, path: str, schema, fmt: str = "parquet", per_batch: int | None = None) -> DataFrame:
    """A stream of the files of a folder; the schema is given, not inferred."""
    reader = spark.readStream.schema(schema).format(fmt)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.load(path)


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str):
    """Appends all that is there to Parquet, then stops; the finished query."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return query


def ingest(spark: SparkSession, source: str, schema, transform: Callable[[DataFrame], DataFrame] = lambda d: d, per_batch: int = 2) -> DataFrame:
    """Reads a folder as a stream, transforms and stores it; the stored rows."""
    out = scratch(spark, "stream-out")
    run_to_parquet(transform(files(spark, source, schema, per_batch=per_batch)), out, scratch(spark, "stream-state"))
    return spark.read.parquet(out)


def deduplicated(stream: DataFrame, key: list[str], time: str, delay: str = "10 days") -> DataFrame:
    """One row a key among rows within ``delay`` of each other; state older than that is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def enriched(stream: DataFrame, static: DataFrame, key: str) -> DataFrame:
    """Each row with the static table's columns, or nulls."""
    return stream.join(static, key, "left")


def running_summary(stream: DataFrame, time: str, keys: list[str], value: str, every: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Counts and sums by window; rows later than ``delay`` behind the newest are dropped, as is the state of windows that end before.

    In append mode a window is given out once, when the watermark has passed it.  ``event_time_summary`` also gives those that are still open.
    """
    grouped = stream.withWatermark(time, delay).groupBy(F.window(time, every).alias("w"), *keys)
    out = grouped.agg(F.count(F.lit(1)).alias("violation_count"), F.sum(S.cents(value)).alias("cents"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "violation_count", "cents")


def open_windows(spark: SparkSession, checkpoint: str, keys: list[str]) -> DataFrame:
    """The windows of a stopped ``running_summary`` that aren't given out yet, read from its state, which stays as it is."""
    state = spark.read.format("statestore").load(checkpoint)
    # the state's value holds the count and the sum, in the order of the aggregation
    count, cents = (F.col(f"value.`{n}`") for n in state.schema["value"].dataType.names[:2])
    names = [n for n in state.schema["key"].dataType.names]
    window, rest = F.col(f"key.`{names[0]}`"), [F.col(f"key.`{n}`").alias(k) for n, k in zip(names[1:], keys, strict=True)]
    return state.select(window["start"].alias("window_start"), *rest, count.alias("violation_count"), cents.alias("cents"))


def late_rows(query) -> int:
    """Rows that the watermark dropped in the batches that Spark remembers."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])


def event_time_summary(stream: DataFrame, path: str, checkpoint: str, time: str, keys: list[str], value: str, every: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Counts and sums of every window so far: those that the watermark closed, from the sink, and the open ones, from the state.

    Reading the state is the final flush; the stream can be resumed afterwards, as its windows stay open.  Rows later than
    ``delay`` are dropped; rows without a time are in no window.
    """
    spark = stream.sparkSession
    summed = running_summary(stream.filter(F.col(time).isNotNull()), time, keys, value, every, delay)
    run_to_parquet(summed, path, checkpoint)
    closed = spark.read.schema(summed.schema).parquet(path)
    # both may hold a window that the last batch closed
    still = open_windows(spark, checkpoint, keys).join(closed, ["window_start", *keys], "left_anti") if keys else open_windows(spark, checkpoint, keys).join(closed, "window_start", "left_anti")
    return closed.union(still).select("window_start", *keys, "violation_count", (F.col("cents").cast("double") / 100).alias("total"))


def upsert_summary(stream: DataFrame, path: str, checkpoint: str, keys: list[str], value: str, buckets: int = swap.BUCKETS):
    """Keeps counts and sums by ``keys`` in a table bucketed by them; a batch rewrites the buckets of its keys only.

    New buckets are staged and change places with the old ones, and each remembers the last batch that it took, so a batch that is
    run again, whole or in part, is counted once.  The table is given back with the query, also where a resumed
    stream finds nothing new.
    """
    spark = stream.sparkSession

    def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
        both = new if old is None else old.unionByName(new)
        return both.groupBy(*keys).agg(F.sum("violation_count").alias("violation_count"), F.sum("cents").alias("cents"))

    def put(batch: DataFrame, batch_id: int) -> None:
        now = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("violation_count"), F.sum(S.cents(value)).alias("cents"))
        now = written(now, "batch")
        swap.merge_touched(now, path, keys, merge, buckets, batch_id)

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if not has_rows(spark, path):
        return spark.createDataFrame([], stream.select(*keys).schema.add("violation_count", "long").add("cents", "long")), query
    return swap.merged_table(spark, path), query


def windowed_summary(stream: DataFrame, path: str, checkpoint: str, time: str, keys: list[str], value: str, every: str = "1 day") -> DataFrame:
    """Counts and sums of every window, however late its rows come; rows without a time are in none.

    Windows are merged batch by batch as in ``upsert_summary``, so no watermark is needed.
    """
    placed = stream.filter(F.col(time).isNotNull()).withColumn("window_start", F.window(time, every).start)
    found, _ = upsert_summary(placed, path, checkpoint, ["window_start", *keys], value)
    return found.select("window_start", *keys, "violation_count", (F.col("cents").cast("double") / 100).alias("total"))


def alerts(stream: DataFrame, column: str, threshold: float) -> DataFrame:
    return stream.filter(F.col(column) > threshold)


def progress(query) -> list[dict]:
    """Rows and rate of the newest batches of a query, as many as Spark keeps (spark.sql.streaming.numRecentProgressUpdates)."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "rows_per_second": p.get("processedRowsPerSecond")} for p in query.recentProgress]


_LOGGED = "batch long, rows long, rows_per_second double, at string"


class ProgressLog(StreamingQueryListener):
    """Writes rows and rate of every batch of one query, known by its name, to a table; ``ended`` is set when the query has."""

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.path, self.name = spark, path, name
        self.run, self.ended, self.failed = None, threading.Event(), None

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.run = event.runId

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name != self.name or not p.numInputRows:
            return
        try:
            row = [(p.batchId, p.numInputRows, p.processedRowsPerSecond, p.timestamp)]
            self.spark.createDataFrame(row, _LOGGED).coalesce(1).write.mode("append").parquet(self.path)
        except Exception as e:  # a listener's errors are lost unless they are kept
            self.failed = e

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.runId == self.run:
            self.ended.set()


def load_progress(stream: DataFrame, path: str, checkpoint: str, log: str | None = None, patience: float = 120) -> DataFrame:
    """Appends all that is there to Parquet; ``batch, rows, rows_per_second`` of every batch that ``log`` holds, however many.

    A listener writes them as batches end, so the log goes on where a stream is resumed and doesn't depend on what Spark remembers; a batch that
    was run again counts once, as last told.
    """
    spark, log = stream.sparkSession, log or f"{path}-progress"
    listener = ProgressLog(spark, log, f"load-{uuid.uuid4().hex}")
    spark.streams.addListener(listener)
    try:
        writer = stream.writeStream.queryName(listener.name).format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()
        if not listener.ended.wait(patience):
            raise TimeoutError("the listener wasn't told of the query's end")
    finally:
        spark.streams.removeListener(listener)
    if listener.failed is not None:
        raise listener.failed
    if not has_rows(spark, log):
        return spark.createDataFrame([], "batch long, rows long, rows_per_second double")
    last = F.max_by(F.struct("rows", "rows_per_second"), "at").alias("p")
    return spark.read.schema(_LOGGED).parquet(log).groupBy("batch").agg(last).select("batch", "p.*")
