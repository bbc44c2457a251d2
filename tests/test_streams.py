"""Replayed streams in several triggers."""

import os
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ebbtide.plans import adapters as A
from ebbtide.plans import q_learning
from ebbtide.streaming import jobs


def drained(spark, folder, schema, path):
    stream = jobs.read_stream(spark, str(folder), schema, 1)
    jobs.start(jobs.without_repeats(stream, "event_id"), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out").count()


def test_write_order_does_not_make_rows_late(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartitionByRange(4, "ts").write.parquet(f"{tmp_path}/events")
    parts = sorted(Path(f"{tmp_path}/events").glob("part-*"))
    for k, part in enumerate(parts):  # as if the last range had been written first
        os.utime(part, (1_700_000_000 - 60 * k,) * 2)
    assert drained(spark, tmp_path / "events", events.schema, tmp_path / "before") < events.count()
    assert jobs.in_time_order(spark, f"{tmp_path}/events") == 4
    assert drained(spark, tmp_path / "events", events.schema, tmp_path / "after") == events.count()


@pytest.mark.parametrize("per_trigger", [1, 3])
def test_queries_in_several_triggers(spark, sf, per_trigger):
    events, trips = spark.read.parquet(f"{sf}/events.parquet"), A.trips(spark, sf)
    assert q_learning.q1_weekly_counts(spark, sf, per_trigger, 7).agg(F.sum("events")).first()[0] == events.count()
    assert q_learning.q2_without_repeats(spark, sf, per_trigger, 7).count() == events.select("event_id").distinct().count()
    assert q_learning.q3_cleaning_counts(spark, sf, per_trigger, 7).agg(F.sum("rows")).first()[0] == trips.filter("started_at is not null").count()


def test_weeks_are_final_once_the_watermark_has_passed_them(spark, tmp_path):
    start = datetime(2024, 1, 1)  # a Monday
    batches = [
        [(1, start + timedelta(days=d), 1.0) for d in range(7)],
        [(2, start + timedelta(days=20 + d), 1.0) for d in range(7)],  # the watermark goes far beyond the first week
        [(3, start + timedelta(days=24), 1.0)],
        [(4, start + timedelta(days=1), 5.0), (4, start + timedelta(days=60), 1.0)],  # one row is late, by the watermark of the batch before
        [(5, start + timedelta(days=61), 1.0)],
    ]
    schema = "event_id long, ts timestamp, value double"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        newest = max(Path(f"{tmp_path}/events").glob("part-*"), key=lambda p: p.stat().st_mtime_ns)
        os.utime(newest, (1_700_000_000 + 60 * k,) * 2)
    counts = jobs.weekly_counts(jobs.read_stream(spark, f"{tmp_path}/events", spark.createDataFrame([], schema).schema, 1))
    query = jobs.start(counts, f"{tmp_path}/out", f"{tmp_path}/checkpoint", "append")
    query.awaitTermination()
    state = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert sum(s["numRowsDroppedByWatermark"] for s in state) == 1
    assert max(s["numRowsTotal"] for s in state) > state[-1]["numRowsTotal"] and state[-1]["numRowsTotal"] <= 1
    found = {r["week_start"].isoformat(): (r["events"], r["value"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert found == {"2024-01-01": (7, 7.0), "2024-01-15": (1, 1.0), "2024-01-22": (7, 7.0)}  # the last week is still open
