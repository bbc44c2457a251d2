"""Structured Streaming forms of the weekly counts, the edge dedupe and the cleaning report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ebbtide.operators.events import REASONS, reject_reason

LATE = "48 hours"


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def in_time_order(spark: SparkSession, folder: str) -> int:
    """Date a folder's part files by their names, a second apart; their number.

    A file source takes files by modification time, which parallel tasks leave
    in any order.  Where the parts are ranges of time, no row is late then.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted((f for f in store.listStatus(path) if f.getPath().getName().startswith("part-")), key=lambda f: f.getPath().getName())
    last = max((f.getModificationTime() for f in parts), default=0)
    for k, part in enumerate(parts):
        store.setTimes(part.getPath(), last - 1000 * (len(parts) - 1 - k), -1)
    times = [store.getFileStatus(f.getPath()).getModificationTime() for f in parts]
    if any(a >= b for a, b in zip(times, times[1:])):
        raise RuntimeError(f"the store of {folder} does not keep modification times; replay from one that does")
    return len(parts)


def weekly_counts(events: DataFrame, ts: str = "ts", by: tuple[str, ...] = ()) -> DataFrame:
    """Tumbling Monday weeks.

    The window is over the watermarked time itself: once the latest time seen is further than the lateness allowed
    past a week's end, the week is final, its state goes, append mode hands it out, and rows that come later are dropped.
    """
    marked = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, LATE)
    week = F.window(ts, "7 days", "7 days", "4 days")  # windows start on Mondays
    return marked.groupBy(week.alias("week"), *by).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value")).select(F.to_date("week.start").alias("week_start"), *by, "events", "value")


def without_repeats(events: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """Each key once, if its repeats come within the lateness allowed; the state holds that much."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, LATE).dropDuplicatesWithinWatermark([key])


def cleaning_counts(trips: DataFrame) -> DataFrame:
    """Rows per week and reject reason."""
    start = F.col("started_at").cast("timestamp")
    marked = trips.withColumn("reason", F.coalesce(reject_reason(), F.lit("kept"))).withColumn("at", start).withWatermark("at", LATE)
    return marked.groupBy(F.window("at", "7 days", "7 days", "4 days").alias("week"), "reason").agg(F.count(F.lit(1)).alias("rows")).select(F.to_date("week.start").alias("week_start"), "reason", "rows")


def start(df: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write a stream to Parquet; restarts go on from the checkpoint."""
    return df.writeStream.outputMode(mode).format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_batches(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    return df.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = ["LATE", "REASONS", "cleaning_counts", "read_stream", "start", "start_batches", "weekly_counts", "without_repeats"]
