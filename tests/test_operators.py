"""Operators on small literal frames: boundaries, ties, nulls, and recovery of known truths."""

import hashlib
import math
import os
import random
from collections import Counter
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.operators import calendars, closures, events, geo, graph, joins, leaving, living, models, panel, presence, ranking, reports, resample, timeline, whatif, windows
from ebbtide.plans import q_learning, q_models, scratch
from ebbtide.sources import files

LEGACY = ["tripduration", "starttime", "stoptime", "start station id", "start station name", "start station latitude", "start station longitude", "end station id", "end station name", "bikeid", "usertype", "birth year"]
MODERN = ["ride_id", "rideable_type", "started_at", "ended_at", "start_station_name", "start_station_id", "end_station_name", "end_station_id", "start_lat", "start_lng", "member_casual"]


def text_frame(spark, rows, columns):
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))


def legacy(spark, rows):
    return text_frame(spark, rows, LEGACY)


def test_legacy_layout_is_cleaned_in_order(spark):
    def row(begin, end, station="7", name="Park", end_name="Hill", user="Subscriber", year="1990"):
        return ("1", begin, end, station, name, "42.3", "-71.1", "9", end_name, "5", user, year)

    raw = legacy(spark, [
        row("2019-05-01 08:00:00.1234", "2019-05-01 08:10:00"), row("2019-05-01 08:00:00", "2019-05-01 08:00:30"), row("2019-05-01 08:00:00", "2019-05-01 08:20:00", end_name="Main warehouse", user="Customer"),
        row("bad", "2019-05-01 08:20:00"), row("2019-05-01 08:00:00", "2019-05-02 08:00:01"), row("2019-05-01 08:00:00", "2019-05-01 08:05:00", station=" ", name="", user="Guest", year="\\N"),
    ])
    trips = events.standardize(raw)
    report = {r["month"]: r.asDict() for r in events.cleaning_report(trips).collect()}["201905"]
    assert (report["rows_raw"], report["rows_too_short"], report["rows_too_long"], report["rows_non_public_station"], report["rows_kept"], report["rows_no_start_station"]) == (5, 1, 1, 1, 2, 1)
    kept = events.clean(trips).orderBy("birth_year").collect()
    assert [r["rider_type"] for r in kept] == ["other", "member"] and kept[0]["start_station_id"] is None and kept[1]["duration_s"] == 600


def test_modern_layout(spark):
    raw = text_frame(spark, [
        ("a", "docked_bike", "2024-01-01 10:00:00", "2024-01-01 10:20:00", "X", "1", "Y", "2", "42.3", "-71", "Member"), ("b", "electric_bike", "2024-01-01 10:00:00", "2024-01-01 10:20:00", "", "", "", "", "x", None, "casual"),
        ("c", "cargo", "2024-11-03 01:50:00", "2024-11-03 01:05:00", "X", "1", "Y", "2", "42.3", "-71", "member"),
    ], MODERN)
    rows = {r["trip_key"]: r for r in events.standardize(raw).collect()}
    assert (rows["a"]["bike_type"], rows["a"]["rider_type"], rows["b"]["start_lat"], rows["b"]["start_station_id"]) == ("classic", "member", None, None)
    assert rows["c"]["duration_s"] == 900 and rows["c"]["bike_type"] == "other"
    with pytest.raises(ValueError):
        events.detect_layout(["a"])


@pytest.mark.parametrize("year,age", [(2000, 19), (1995, 24), (1994, 25), (1969, None), (None, None), (2010, None), (1920, None), (1980, 39)])
def test_rider_age(spark, year, age):
    row = spark.createDataFrame([(datetime(2019, 6, 1), year)], "t timestamp_ntz, y int").select(events.rider_age(F.col("t"), F.col("y"))).first()
    assert row[0] == age


def test_spill_counts_trips_once(spark):
    rows = [("dup", datetime(2024, 6, 1, 0, 10), "202405"), ("dup", datetime(2024, 6, 1, 0, 10), "202406"), ("only", datetime(2024, 6, 1, 0, 20), "202405"), ("mid", datetime(2024, 5, 9), "202405")]
    assert [r["trip_key"] for r in events.unseen_spill(spark.createDataFrame(rows, "trip_key string, started_at timestamp_ntz, month string")).collect()] == ["only"]


def test_network_size_is_the_mean_of_days(spark):
    counts = (1, 0, 0, 0, 0, 0)
    rows = [(date(2024, 1, 1), "old", 5, *counts), (date(2024, 1, 2), "new", 4, *counts), (date(2024, 1, 2), None, 3, *counts)]
    days = spark.createDataFrame(rows, "date date, station_id string, " + ", ".join(f"{c} long" for c in events.COUNTS))
    week = events.build_weekly(days, date(2024, 1, 1), date(2024, 1, 31)).first()
    assert (week["trips"], week["no_station_trips"], week["avg_daily_active_stations"], week["trips_per_active_station"], week["complete_week"], week["college_age_share"]) == (12, 3, 1.0, 9.0, True, None)


def test_weeks_cover_every_day_once(spark):
    weeks = timeline.build_weeks(spark, date(2019, 12, 30), date(2021, 12, 31)).orderBy("week_start").collect()
    assert weeks[0]["week_start"] == date(2019, 12, 30) and len({(w["iso_year"], w["iso_week"]) for w in weeks}) == len(weeks)
    assert all((b["week_start"] - a["week_start"]).days == 7 for a, b in zip(weeks, weeks[1:]))
    by = {w["week_start"]: w for w in weeks}
    assert by[date(2020, 11, 23)]["holiday_names"] == "Thanksgiving Day" and by[date(2021, 7, 5)]["holiday_names"] == "Independence Day (observed)"
    assert (by[date(2020, 12, 28)]["iso_year"], by[date(2020, 12, 28)]["iso_week"]) == (2020, 53)


@pytest.mark.parametrize("day,year,kind", [(date(2020, 7, 27), 2019, "spring"), (date(2020, 8, 3), 2020, "spring"), (date(2020, 11, 23), 2020, "thanksgiving"), (date(2020, 12, 28), 2020, "winter")])
def test_week_labels(spark, day, year, kind):
    row = spark.createDataFrame([(day,)], "w date").select(timeline.fall_year(F.col("w")), timeline.break_kind(F.col("w"))).first()
    assert tuple(row) == (year, kind)


def test_closures_do_not_lower_the_usual_level(spark):
    rows = []
    for stop in range(3):
        for k in range(126):
            day = date(2024, 1, 1).toordinal() + k
            low = (stop == 0 and 40 <= k < 54) or k == 100  # two weeks closed; one holiday for the whole system
            rows.append((date.fromordinal(day), str(stop), 10 if low else 100 + stop))
    flags = closures.closed_days(spark.createDataFrame(rows, "date date, stop_id string, entries long"))
    closed = {(r["stop_id"], r["date"]) for r in flags.filter("closed").collect()}
    assert closed == {("0", date.fromordinal(date(2024, 1, 1).toordinal() + k)) for k in range(40, 54)}
    weekly = closures.weekly_closed_days(flags).filter("stop_id = '0'").agg(F.sum("closed_days")).first()[0]
    assert weekly == 14


def test_missing_stop_ids(spark):
    raw = text_frame(spark, [("2024-01-01T00", "NA", "Park ", "1.2"), ("2024-01-01", "place-p", "Park", "2.3"), ("2024-01-01", "", "New One", "50.4"), ("2024-01-01", "place-q", "Park", "x")], ["service_date", "stop_id", "station_name", "gated_entries"])
    daily = {r["stop_id"]: r["entries"] for r in closures.daily_entries(closures.fill_stop_ids(closures.read_entries(raw))).collect()}
    assert daily == {"place-p": 4, "name-new-one": 50, "place-q": 0}


def calendar_frame(spark, rows):
    return spark.createDataFrame(rows, "unitid string, start_year int, event string, date date, status string")


def test_unknown_breaks_make_unknown_days(spark):
    rows = [("1", 2020, "fall_classes_start", date(2020, 9, 1), "verified"), ("1", 2020, "fall_exams_end", date(2020, 12, 15), "verified"), ("1", 2020, "spring_classes_start", date(2021, 1, 20), "verified"), ("1", 2020, "spring_exams_end", date(2021, 5, 10), "verified"),
            ("1", 2020, "spring_break_start", None, "missing"), ("1", 2020, "spring_break_end", None, "missing")]
    days = {r["date"]: r for r in calendars.session_days(calendar_frame(spark, rows)).collect()}
    assert days[date(2020, 10, 5)]["in_session"] and days[date(2020, 11, 26)]["in_session"] is False and days[date(2021, 3, 1)]["in_session"] is None
    assert days[date(2020, 8, 20)]["summer_break"] and days[date(2021, 5, 11)]["summer_break"] and days[date(2021, 7, 1)]["in_session"] is False
    none = rows[:4] + [("1", 2020, "spring_break_start", None, "none"), ("1", 2020, "spring_break_end", None, "none")]
    assert calendars.session_days(calendar_frame(spark, none)).filter("in_session is null").count() == 0


def test_breaks_take_their_weekends(spark):
    row = spark.createDataFrame([(date(2021, 3, 15), date(2021, 3, 19))], "a date, b date").select(*calendars.widen_to_weekend(F.col("a"), F.col("b"))).first()
    assert tuple(row) == (date(2021, 3, 13), date(2021, 3, 21))


def test_calendar_problems(spark):
    columns = ["unitid", "academic_year", "event", "date", "weekday", "source_url", "note"]
    good = ("1", "2020-21", "fall_classes_start", "2020-09-01", "Tuesday", "http://x", None)
    bad = [("1", "2020-22", "fall_classes_start", "2020-09-01", "Tuesday", "http://x", None), ("1", "2020-21", "feast", "2020-09-01", "Tuesday", "http://x", None), ("1", "2020-21", "fall_classes_start", "2020-09-01", "Monday", "http://x", None),
           ("1", "2020-21", "spring_break_start", "none", None, None, " "), ("1", "2020-21", "fall_classes_start", "soon", None, "http://x", None), ("1", "2020-21", "spring_exams_end", "2020-05-01", "Friday", "http://x", None), ("1", "2020-21", "fall_exams_end", "2020-12-15", "Tuesday", None, None)]
    assert calendars.problems(text_frame(spark, [good], columns)).count() == 0
    found = {r["problem"] for r in calendars.problems(text_frame(spark, bad, columns)).collect()}
    assert found == {"bad academic year", "unknown event", "weekday does not match", "none needs a note", "bad date", "date outside the term's year", "missing source URL"}


def test_own_share_else_typical(spark):
    enrolled = spark.createDataFrame([(date(2020, 1, 6), "a", 100), (date(2020, 1, 6), "b", 300), (date(2020, 1, 6), "c", 50)], "week_start date, unitid string, in_person long")
    session = spark.createDataFrame([(date(2020, 1, 6), "a", 7, 0), (date(2020, 1, 6), "b", 0, 7), (date(2020, 1, 6), "c", None, None)], "week_start date, unitid string, days_in_session int, summer_break_days int")
    rows = {r["unitid"]: r for r in presence.own_else_typical(enrolled, session).collect()}
    assert rows["c"]["session_share"] == pytest.approx(0.25) and rows["c"]["calendar_source"] == "typical calendar" and rows["a"]["session_share"] == 1


@pytest.mark.parametrize("metres,zone", [(400.0, "campus"), (400.5, "near"), (1000.0, "near"), (1001.0, "away"), (None, "unknown")])
def test_zone_bounds(spark, metres, zone):
    assert spark.createDataFrame([(metres,)], "m double").select(geo.zone_of(F.col("m"))).first()[0] == zone


def test_nearest_campus_ties_and_unknown_places(spark):
    points = spark.createDataFrame([(1, 42.35, -71.07), (2, 0.0, 0.0), (3, None, -71.0)], "id int, lat double, lng double")
    campuses = spark.createDataFrame([("s", "Small", 42.35, -71.075, 1500.0), ("l", "Large", 42.35, -71.075, 9000.0), ("m", "Minor", 42.35, -71.07, 10.0)], "unitid string, institution string, lat double, lng double, typical_in_person double")
    rows = {r["id"]: r for r in geo.nearest_campus(points, "id", campuses).collect()}
    assert rows[1]["campus_institution"] == "Large" and rows[1]["campus_zone"] == "near" and rows[2]["campus_zone"] == "unknown" and rows[3]["campus_unitid"] is None


def test_nearest_by_cells_equals_broadcast(spark, monkeypatch):
    rng = random.Random(1)
    points = spark.createDataFrame([(k, 42.3 + rng.random() / 5, -71.2 + rng.random() / 3) for k in range(60)], "id int, lat double, lng double")
    campuses = spark.createDataFrame([(str(k), f"U{k}", 42.3 + rng.random() / 20, -71.2 + rng.random() / 20, 2000.0 + k) for k in range(12)], "unitid string, institution string, lat double, lng double, typical_in_person double")
    want = sorted(geo.nearest_campus(points, "id", campuses).collect())
    monkeypatch.setattr(geo, "BROADCAST_POINTS", 3)
    assert sorted(geo.nearest_campus(points, "id", campuses).collect()) == want


def test_border_points_go_to_the_first_town(spark):
    corners = [("B", 0, 0.0, 0.0), ("B", 1, 1000.0, 0.0), ("B", 2, 1000.0, 1000.0), ("B", 3, 0.0, 1000.0), ("A", 0, 1000.0, 0.0), ("A", 1, 2000.0, 0.0), ("A", 2, 2000.0, 1000.0), ("A", 3, 1000.0, 1000.0)]
    town_edges = geo.edges(spark.createDataFrame(corners, "town string, position int, x double, y double"))
    def at(x, y):
        return geo.LAT0 + y / geo.M_PER_LAT, geo.LNG0 + x / geo.M_PER_LNG
    points = spark.createDataFrame([(1, *at(500, 500)), (2, *at(1999, 500)), (3, *at(-50, 500)), (4, *at(-500, 500)), (5, 0.0, 0.0)], "id int, lat double, lng double")
    rows = {r["id"]: r for r in geo.assign_towns(points, "id", town_edges).collect()}
    assert [rows[k]["municipality"] for k in range(1, 6)] == ["B", "A", "B", "unknown", "unknown"]
    assert rows[1]["border_distance_m"] == 500 and rows[1]["nearest_other_municipality"] == "A"


def test_components_of_chains_hubs_and_loops(spark):
    edges = [(k, k + 1) for k in range(200, 260)] + [(5, k) for k in range(300, 400)] + [(7, 7), (8, 9), (9, 8)]
    found = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(found[k] == 200 for k in range(200, 261)) and all(found[k] == 5 for k in range(300, 400)) and found[9] == 8 and 7 not in found
    assert graph.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_global_rank(spark):
    rows = spark.createDataFrame([(k % 7, k) for k in range(500)], "v int, id int")
    got = {r["id"]: r["rank"] for r in ranking.global_rank(rows, ["v", "id"]).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(range(500), key=lambda k: (k % 7, k)) and sorted(got.values()) == list(range(500))


def test_interpolation_is_flat_outside(spark):
    rows = spark.createDataFrame([(date(2019, 1, 1),), (date(2020, 7, 1),), (date(2020, 12, 30),), (date(2023, 1, 1),)], "day date")
    anchors = spark.createDataFrame([(date(2020, 7, 1), 100.0), (date(2021, 7, 1), 465.0)], "anchor date, value double")
    got = [(r["v"], r["extrapolated"]) for r in joins.interpolate(rows, "day", anchors, "anchor", "value", "v").orderBy("day").collect()]
    assert got == [(100.0, True), (100.0, False), (282.0, False), (465.0, True)]


def test_fallback_keeps_null_keys(spark):
    rows = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), (None, "1")], "station string, month string")
    fine, coarse = spark.createDataFrame([("a", "1", "M")], "station string, month string, town string"), spark.createDataFrame([("a", "O"), ("b", "O")], "station string, town string")
    got = {r["station"]: r["town"] for r in joins.fallback_lookup(rows, fine, ["station", "month"], coarse, ["station"], {"town": "unknown"}).collect()}
    assert got == {"a": "M", "b": "O", "c": "unknown", None: "unknown"}


def test_runs_and_fills(spark):
    rows = spark.createDataFrame([(1, k, f) for k, f in enumerate([True, True, False, None, None, True])], "u int, t int, f boolean")
    got = [(r["f"], r["first"], r["last"], r["n"]) for r in windows.runs(rows, ["u"], "t", "f").orderBy("first").collect()]
    assert got == [(True, 0, 1, 2), (False, 2, 2, 1), (None, 3, 4, 2), (True, 5, 5, 1)]
    constant = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double").agg(windows.corr_from_sums(F.col("x"), F.col("y"))).first()[0]
    assert constant is None


# --- panels


def panel_frame(spark, effect=0.2, units=12, weeks=60, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(units):
        for w in range(weeks):
            if rng.random() < 0.1:
                continue
            x = float(rng.normal())
            rows.append((f"u{u}", w, x, float(effect * x + u * 0.3 + math.sin(w) + rng.normal() * 0.05)))
    return spark.createDataFrame(rows, "unit string, week int, x double, y double")


def test_demeaning_equals_dummies(spark):
    rows = panel_frame(spark)
    got = panel.fixed_effects(rows, ["x"], "y", [["unit"], ["week"]], "unit")
    data = rows.collect()
    units, weeks = sorted({r["unit"] for r in data}), sorted({r["week"] for r in data})
    design = np.array([[r["x"], *(r["unit"] == u for u in units), *(r["week"] == w for w in weeks)] for r in data], float)
    beta = np.linalg.lstsq(design, np.array([r["y"] for r in data]), rcond=None)[0]
    assert got["beta"][0] == pytest.approx(beta[0], abs=1e-8) and abs(got["beta"][0] - 0.2) < 0.01 and got["r2_within"] > 0.8


def test_clustered_by_row_equals_robust_and_no_lags_equal_robust(spark):
    rows = panel_frame(spark, units=1, weeks=80).withColumn("one", F.lit(1.0))
    beta = panel.fit(rows, ["one", "x"], "y")
    data = rows.orderBy("week").collect()
    x, y = np.array([[1.0, r["x"]] for r in data]), np.array([r["y"] for r in data])
    e = y - x @ beta
    bread, meat = np.linalg.inv(x.T @ x), (x * e[:, None]).T @ (x * e[:, None])
    robust, n = bread @ meat @ bread, len(data)
    assert panel.clustered_covariance(rows, ["one", "x"], "y", beta, "week") == pytest.approx(robust * n / (n - 1), rel=1e-8)
    assert panel.newey_west_covariance(rows, ["one", "x"], "y", beta, "week", lags=0) == pytest.approx(robust, rel=1e-8)


def test_held_out_months_do_not_see_their_neighbours(spark):
    days = [date.fromordinal(date(2020, 1, 6).toordinal() + 7 * k) for k in range(52)]
    def predictions(spike):
        rows = [(d, d.month, 1.0, float(k), 2.0 * k + (1000.0 if spike and d.month == 6 else 0.0)) for k, d in enumerate(days)]
        frame = spark.createDataFrame(rows, "week_start date, month int, one double, x double, y double")
        return {r["week_start"]: r["predicted"] for r in panel.held_out_scores(frame, ["one", "x"], "y", "month", "week_start").filter("month = 6").collect()}
    calm, spiked = predictions(False), predictions(True)
    assert all(calm[d] == pytest.approx(spiked[d], abs=1e-6) for d in calm)


def test_stack_weights_are_not_negative(spark):
    rows = spark.createDataFrame([(float(k), 0.5 * k, -float(k), 0.0) for k in range(1, 30)], "y double, a double, b double, c double")
    weights = models.stack_weights(rows, ["a", "b", "c"])
    assert weights["a"] == pytest.approx(1) and weights["b"] == 0 and sum(weights.values()) == pytest.approx(1)


def test_neighbours_weigh_by_distance(spark):
    train = spark.createDataFrame([(1, 0.0, 10.0), (2, 1.0, 20.0), (3, 50.0, 0.0)], "k int, x double, l double")
    queries = spark.createDataFrame([(1, 0.0), (2, 0.25)], "id int, x double")
    got = {r["id"]: r["predicted"] for r in models.nearest_neighbours(queries, "id", train, "k", ["x"], "l", 2).collect()}
    assert got[1] == 10 and got[2] == pytest.approx((10 / 0.25 + 20 / 0.75) / (1 / 0.25 + 1 / 0.75))


def test_neighbours_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(models, "QUERY_ROWS", 7)
    monkeypatch.setattr(models, "TRAIN_ROWS", 20)
    rng = random.Random(8)
    train = [(k, float(rng.randint(0, 9)), float(rng.randint(0, 9)), float(k)) for k in range(200)]
    queries = [(k, rng.randint(0, 9) + 0.5, float(rng.randint(0, 9))) for k in range(40)] + [(99, 3.0, 4.0)]
    frame = models.nearest_neighbours(spark.createDataFrame(queries, "id int, a double, b double"), "id", spark.createDataFrame(train, "k int, a double, b double, l double"), "k", ["a", "b"], "l", 5)
    got = {r["id"]: r["predicted"] for r in frame.collect()}
    for i, a, b in queries:
        best = sorted((math.hypot(a - x, b - y), k, v) for k, x, y, v in train)[:5]
        same = [v for d, _, v in best if d == 0]
        assert got[i] == pytest.approx(sum(same) / len(same) if same else sum(v / d for d, _, v in best) / sum(1 / d for d, _, _ in best))


def test_neighbours_have_no_row_cap(spark):
    train = spark.range(120_000).selectExpr("id as k", "cast(id as double) as x", "cast(id as double) as l")
    queries = spark.createDataFrame([(1, 110_000.0), (2, 50.25)], "id int, x double")
    got = {r["id"]: r["predicted"] for r in models.nearest_neighbours(queries, "id", train, "k", ["x"], "l", 1).collect()}
    assert got == {1: 110_000.0, 2: 50.0}


def test_draws_take_as_many_blocks_as_asked(spark):
    for blocks, picks in ((12, None), (12, 4), (7, 3)):
        total = resample.draw_blocks(spark, 20, blocks, picks, seed=3).groupBy("draw").agg(F.sum("times").alias("n")).select("n").distinct().collect()
        assert [r["n"] for r in total] == [picks or blocks]


@pytest.mark.parametrize("many, run", [(10, 3), (5, 1), (4, 9), (1, 2)])
def test_moving_runs_lie_inside_the_months(spark, many, run):
    cells = spark.createDataFrame([(k, float(k * k), 1) for k in range(many)], "block int, v double, n int")
    runs, starts, picks = resample.moving_runs(cells, run, ["v", "n"])
    length = min(run, many)
    assert (starts, picks) == (many - length + 1, -(-many // length))
    want = {s: (sum(k * k for k in range(s, s + length)), length) for s in range(starts)}
    assert {r["block"]: (r["v"], r["n"]) for r in runs.collect()} == want


def test_placebo_rotates_all_units(spark, sf):
    many = spark.read.parquet(f"{sf.rsplit('/', 1)[0]}/sf0.01/lineitem.parquet").select("l_suppkey").distinct().count()
    rows = q_learning.m8_placebo_rotations(spark, f"{sf.rsplit('/', 1)[0]}/sf0.01").collect()
    assert many > 50 and sorted(r["k"] for r in rows) == list(range(1, many))


def test_registered_families_have_the_studys_trees():
    assert q_learning.TREES == 300


def test_seeded_draws_resample_and_can_be_repeated(spark):
    rows = {(r["draw"], r["block"]): r["times"] for r in resample.draw_blocks(spark, 50, 36, seed=3).collect()}
    want = Counter((d, int(hashlib.md5(f"3-{d}-{i}".encode()).hexdigest()[:15], 16) % 36) for d in range(50) for i in range(36))
    assert rows == want
    assert len(set(rows.values())) > 2 and len(rows) < 50 * 30  # about 1 - 1/e of the blocks in a draw


def test_seeded_bootstraps_have_width(spark, sf):
    slopes = {round(r["slope"], 9) for r in q_models.u1_block_bootstrap(spark, sf, draws=1000, seed=1).collect()}
    assert len(slopes) > 900
    row = q_models.u5_interval(spark, sf, seed=1).first()
    assert row["draws"] == 1000 and row["high"] - row["low"] > 0.005


def test_two_way_draws_keep_months_outside_the_study(spark, sf, tmp_path):
    old = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("l_shipdate", F.expr("l_shipdate - interval 20 years"))
    old.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert q_models.u3_two_way(spark, str(tmp_path)).count() == 1000


def test_housing_is_capped_by_beds(spark):
    areas = spark.createDataFrame([("1", 100.0, 50.0, 10.0)], "area string, students double, group_quarters double, with_parents double")
    shares = spark.createDataFrame([("1", "A", 0.5), ("1", "B", 0.5)], "area string, town string, share double")
    beds = spark.createDataFrame([("A", 20.0)], "town string, beds double")
    rows = {r["town"]: r for r in living.split_over_towns(areas, shares, beds).collect()}
    assert (rows["A"]["in_university_housing"], rows["A"]["elsewhere"], rows["B"]["in_university_housing"]) == (20, 25, 0)


def test_changes_and_scenarios(spark):
    base = spark.createDataFrame([(date(2020, 1, 6), 5.0), (date(2020, 1, 13), 3.0)], "week_start date, v double")
    rows = whatif.against_baseline(base.withColumn("scenario", F.lit("same")), base, "v")
    got = whatif.summary(rows, "v").first()
    assert (got["mean"], got["lowest_week"], got["changed_weeks"]) == (4.0, date(2020, 1, 13), 0)


def test_report_helpers(spark):
    rows = spark.createDataFrame([("a", 3), ("b", 3), ("c", 1), ("d", 1)], "g string, v int")
    assert [r["g"] for r in reports.largest(rows, "v", "g", 2).collect()] == ["a", "b"]
    labels = {r["g"]: r["label"] for r in ranking.top_groups(rows, "g", "v", 2).collect()}
    assert labels == {"a": "a", "b": "b", "c": "All other (2)", "d": "All other (2)"}
    text = spark.createDataFrame([(1234.0, 1000.4, 1500.6), (None, None, None)], "v double, a double, b double").select(reports.interval_text(F.col("v"), F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in text] == ["1,234 (1,000–1,501)", "not known"]
    assert [r[0] for r in spark.createDataFrame([(" 12,345 ",), ("",), (None,)], "t string").select(files.thousands(F.col("t"))).collect()] == [12345, None, None]


def test_components_leave_one_round_on_disk(spark):
    folder = scratch.shared_folder(spark).removeprefix("file://").removeprefix("file:")
    before = {p for p in os.listdir(folder) if p.startswith("ebbtide-")}
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    found = graph.connected_components(edges, "a", "b")
    assert {r["component"] for r in found.collect()} == {0}
    assert len({p for p in os.listdir(folder) if p.startswith("ebbtide-")} - before) <= 1


def test_demeaning_leaves_one_round_on_disk(spark):
    folder = scratch.shared_folder(spark).removeprefix("file://").removeprefix("file:")
    before = {p for p in os.listdir(folder) if p.startswith("ebbtide-")}
    rows = spark.createDataFrame([(k % 3, k % 5, float(k * k % 7)) for k in range(23)], "a int, b int, y double")
    assert abs(panel.demean(rows, ["y"], [["a"], ["b"]]).agg(F.sum("y")).first()[0]) < 1e-6
    assert len({p for p in os.listdir(folder) if p.startswith("ebbtide-")} - before) <= 1


def test_stations_of_one_place_and_of_chains(spark):
    rng = random.Random(3)
    places = [(rng.uniform(42.30, 42.3008), rng.uniform(-71.15, -71.1492)) for _ in range(60)]
    rows = [(k, *places[k % 60]) for k in range(400)] + [(900, None, None)]
    found = {r["id"]: r["station"] for r in geo.same_station(spark.createDataFrame(rows, "id int, lat double, lng double"), "id", 10.0).collect()}
    xy = {k: ((lng - geo.LNG0) * geo.M_PER_LNG, (lat - geo.LAT0) * geo.M_PER_LAT) for k, lat, lng in rows if lat is not None}
    root = {k: k for k in xy}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(60):
        for b in range(a):
            if math.dist(xy[a], xy[b]) <= 10.0:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert found == {k: top(k % 60) for k in xy} | {900: 900}
    assert 1 < len(set(found.values())) < 60


def test_interpolation_with_many_rows_a_day(spark):
    days = spark.range(5000).select(F.date_add(F.lit(date(2020, 1, 1)), (F.col("id") % 400).cast("int")).alias("day"), "id").unionByName(spark.createDataFrame([(None, -1)], "day date, id long"))
    anchors = spark.createDataFrame([(date(2020, 3, 1), 10.0), (date(2020, 12, 1), 285.0)], "d date, v double")
    rows = joins.interpolate(days, "day", anchors, "d", "v", "value").collect()
    assert len(rows) == 5001
    for r in rows:
        if r["day"] is None:
            assert r["value"] is None
            continue
        n = min(max((r["day"] - date(2020, 3, 1)).days, 0), 275)
        assert r["value"] == pytest.approx(10.0 + n) and r["extrapolated"] == (not date(2020, 3, 1) <= r["day"] <= date(2020, 12, 1))
