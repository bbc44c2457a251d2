"""Slopes after two levels, two-equation and joint fits, size checks and forward scores, on planted data."""

import random
import tracemalloc
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ebbtide.operators import events, joins, leaving, models, panel, resample, tables
from ebbtide.plans import adapters, q_events
from ebbtide.sources import files


def station_rows(seed=0, units=9, weeks=25):
    rng = random.Random(seed)
    rows = []
    for u in range(units):
        for w in range(weeks):
            if rng.random() < 0.8:  # unbalanced
                day = date(2022, 8, 1) + timedelta(weeks=w)
                rows.append((f"s{u}", day.year, day, rng.random(), rng.random(), u * 0.01 + 0.001 * u * u))
    return rows


STATION = "unit string, year int, week date, a double, b double, m double"


def test_two_levels_are_absorbed_as_by_dummies(spark):
    rows = station_rows()
    frame = spark.createDataFrame(rows, STATION).withColumn("__note", F.lit("x"))
    columns = [pd.get_dummies([(r[0], r[1]) for r in rows]).to_numpy(float), pd.get_dummies([r[2] for r in rows]).to_numpy(float)]
    dummies = np.concatenate(columns, axis=1)
    y = np.array([r[3:5] for r in rows])
    want = y - dummies @ np.linalg.lstsq(dummies, y, rcond=None)[0]
    got = {(r["unit"], r["week"]): (r["a"], r["b"]) for r in panel.absorb(frame, ["a", "b"], ["unit", "year"], "week").collect()}
    assert all(got[r[0], r[2]] == pytest.approx(tuple(w), abs=1e-9) for r, w in zip(rows, want))
    turns = {(r["unit"], r["week"]): r["a"] for r in panel.demean(frame.select("unit", "year", "week", "a"), ["a"], [["unit", "year"], ["week"]]).collect()}
    assert all(turns[k] == pytest.approx(v[0], abs=1e-6) for k, v in got.items())


def test_a_task_adds_its_groups_to_one_system():
    rng = np.random.default_rng(0)
    groups = [np.sort(rng.choice(52, 40, replace=False)) for _ in range(3_000)]
    part = pd.DataFrame({"places": groups, "counts": [rng.integers(1, 4, 40) for _ in groups], "sums0": [rng.random(40) for _ in groups], "sums1": [rng.random(40) for _ in groups]})
    tracemalloc.start()
    found = pd.concat(panel._short_system(52, 2)(iter([part, part[:0], part[:1]])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10e6  # not an entry for each pair of places of each group
    left, right = np.zeros((52, 52)), np.zeros((52, 2))
    for t, n, a, b in [*part.itertuples(index=False), *part[:1].itertuples(index=False)]:
        y = np.array([a, b]).T
        left[np.ix_(t, t)] += np.diag(n) - np.outer(n, n) / n.sum()
        right[t] += y - np.outer(n, y.sum(axis=0)) / n.sum()
    got = {(i, j): v for i, j, v in found[["i", "j", "value"]].itertuples(index=False)}
    assert all(got.get((i, j), 0) == pytest.approx(left[i, j], abs=1e-9) for i in range(52) for j in range(52))
    assert all(got.get((i, -1 - j), 0) == pytest.approx(right[i, j], abs=1e-9) for i in range(52) for j in range(2))


def test_many_short_levels_are_removed_by_turns(spark, monkeypatch):
    frame = spark.createDataFrame(station_rows(1), STATION)
    exact = {(r["unit"], r["week"]): r["a"] for r in panel.absorb(frame, ["a"], ["unit", "year"], "week").collect()}
    monkeypatch.setattr(panel, "SHORT", 3)
    turns = {(r["unit"], r["week"]): r["a"] for r in panel.absorb(frame, ["a"], ["unit", "year"], "week").collect()}
    assert turns == pytest.approx(exact, abs=1e-6)


def test_slopes_recover_each_weeks_slope(spark):
    rng = np.random.default_rng(0)
    rows = []
    for u in range(12):
        share, level = rng.random() * 0.05, rng.normal(8, 1)
        for w in range(20):
            slope = -5.0 * (w % 4)
            y = level + 0.1 * w + slope * share
            rows.append((f"s{u}", 2023, date(2023, 1, 2) + timedelta(weeks=w), y, y - 1 + slope * share, share))
    rows.append(("s0", 2023, date(2023, 6, 5), None, 1.0, 0.1))
    found = panel.weekly_slopes(spark.createDataFrame(rows, STATION), {"share": "m"}, ["a", "b"], "unit", "year", "week").orderBy("week").collect()
    got, want = np.array([(r["a"], r["b"]) for r in found]), np.array([-5.0 * (w % 4) for w in range(20)])
    assert got[:, 0] - got[:, 0].mean() == pytest.approx(want - want.mean(), abs=1e-6)
    assert got[:, 1] - got[:, 1].mean() == pytest.approx(2 * (want - want.mean()), abs=1e-6)


def planted(spark, k=-6.0, summer=0.8, breaks=0.4, weeks=156, noise=0.0, spike=None):
    rng = np.random.default_rng(1)
    rows = []
    for n in range(weeks):
        day = date(2022, 1, 3) + timedelta(weeks=n)
        s, b = float(day.month in (6, 7)), 0.5 * (day.month in (1, 3))
        rows.append((day, s + b, s, b, 0.0, b * (day.month == 1), b * (day.month == 3), 0.3 * (s + b), 0.85 * (s + b), s + b))
    frame = pd.DataFrame(rows, columns=["week_start", *leaving.INPUTS, "out_level"])
    year = [d.year for d in frame["week_start"]]
    for c in leaving.INPUTS:
        frame[c] -= frame.groupby(year)[c].transform("mean")
    frame["weekday"] = k * frame["out"] + rng.normal(0, 1, weeks) * noise
    frame["weekend"] = k * (summer * frame["summer"] + breaks * frame["breaks"]) + rng.normal(0, 1, weeks) * noise
    if spike is not None:
        frame.loc[spike - 1 : spike + 1, "weekend"] += 1000
    return spark.createDataFrame(frame).withColumn("cell", F.lit("c")), frame


def metrics(found):
    return {(r["version"], r["metric"]): r["estimate"] for r in found.collect()}


def test_k_and_shares_are_recovered(spark):
    frame, _ = planted(spark)
    rows = leaving.fit_grid(frame, ["cell"], draws=30).collect()
    got = {(r["version"], r["metric"]): (r["estimate"], r["low"], r["high"]) for r in rows}
    assert got["summer and breaks", "k"] == pytest.approx((-6, -6, -6)) and got["summer and breaks", "summer"] == pytest.approx((0.8, 0.8, 0.8))
    assert got["summer and breaks", "breaks"] == pytest.approx((0.4, 0.4, 0.4))
    assert {v for v, _ in got} == {"weekly slopes", *leaving.VERSIONS} and ("closed halls only", "summer") not in got
    assert got["weekly slopes", "correlation_weekday"][0] == pytest.approx(-1, abs=0.01) and rows[0]["weeks"] == 156


def test_the_planted_version_predicts_held_out_months_best(spark):
    got = metrics(leaving.fit_grid(planted(spark, noise=0.3)[0], ["cell"], draws=2))
    rmse = {v: got[v, "held_out_rmse"] for v in leaving.VERSIONS if v != "by kind of break"}
    assert min(rmse, key=rmse.get) == "summer and breaks"
    assert rmse["nobody leaves"] > rmse["closed halls only"] > rmse["summer and breaks"]
    assert got["nobody leaves", "rmse_change_percent"] == 0 and got["summer and breaks", "rmse_change_percent"] < -50


def test_held_out_months_see_neither_themselves_nor_their_neighbours(spark):
    # a spike in one week and its neighbours: the month's own predictions stay small, so its error is the spike's
    _, frame = planted(spark, spike=60)
    month = frame["week_start"][60].strftime("%Y-%m")
    z = frame.assign(one=1.0)[list(leaving.NUMBERS)].to_numpy(float)
    inside = np.array([d.strftime("%Y-%m") == month for d in frame["week_start"]])
    days = np.array(frame["week_start"], "datetime64[D]")
    near = (days >= days[inside].min() - 7) & (days <= days[inside].max() + 7)
    beta = leaving.solve_version(z[~near].T @ z[~near], "one share")
    assert np.abs(z[inside] @ leaving.equations("one share")[1] @ beta).max() < 100
    found = metrics(leaving.fit_grid(spark.createDataFrame(frame).withColumn("cell", F.lit("c")), ["cell"], draws=2))
    assert found["one share", "held_out_rmse"] > 100


def test_later_years_are_predicted_from_earlier_ones(spark):
    frame, weeks = planted(spark, weeks=208)
    splits = spark.createDataFrame([("validation", 2022, y - 1, y, y) for y in (2023, 2024, 2025)], "evaluation string, train_from int, train_to int, test_from int, test_to int")
    rows = {(r["test_from"], r["version"]): r for r in leaving.forward_scores(frame, splits, ["cell"]).collect()}
    assert len(rows) == 18
    for year in (2023, 2024, 2025):
        best = rows[year, "summer and breaks"]
        assert best["shares"] == pytest.approx([0.8, 0.4]) and best["k"] == pytest.approx(-6) and best["change_percent"] < -90
        assert rows[year, "nobody leaves"]["change_percent"] == 0 and rows[year, "nobody leaves"]["shares"] is None
        train = weeks[[d.year < year for d in weeks["week_start"]]].assign(one=1.0)[list(leaving.NUMBERS)].to_numpy(float)
        test = weeks[[d.year == year for d in weeks["week_start"]]].assign(one=1.0)
        beta = leaving.solve_version(train.T @ train, "one share")
        error = test["weekend"] - test[list(leaving.NUMBERS)].to_numpy(float) @ leaving.equations("one share")[1] @ beta
        assert rows[year, "one share"]["rmse"] == pytest.approx(float(np.sqrt((error**2).mean()))) and rows[year, "one share"]["weeks"] == len(test)


@pytest.mark.parametrize("scale", [1.0, 0.5])
def test_size_is_one_where_travel_moves_as_fitted(spark, scale):
    frame, weeks = planted(spark, summer=0.85, breaks=0.85, noise=0.05)
    z = weeks.assign(one=1.0)[list(leaving.NUMBERS)].to_numpy(float)
    beta = leaving.solve_version(z.T @ z, leaving.MAIN)
    moved = frame.withColumn("weekend", scale * F.col("weekend"))
    found = {r["day"]: r for r in leaving.size_check(moved, beta, ["cell"], draws=200).collect()}
    assert found["weekday"]["size"] == pytest.approx(1, abs=0.03) and found["weekend"]["size"] == pytest.approx(scale, abs=0.03)
    for r in found.values():
        assert r["low"] < r["size"] < r["high"] and r["weeks"] == 156


def test_joint_shares_and_sizes_are_recovered(spark):
    rng = np.random.default_rng(4)
    rows = []
    for n in range(200):
        month = (date(2020, 1, 6) + timedelta(weeks=n)).strftime("%Y-%m")
        summer, breaks = rng.normal(size=2)
        for signal, k, noise in (("rail", -6.0, 0.02), ("bike", -2.0, 0.2)):
            rows.append((signal, "weekday", month, float(k * (summer + breaks) + rng.normal() * noise), float(summer + breaks), 0.0))
            rows.append((signal, "weekend", month, float(k * (0.8 * summer + 0.4 * breaks) + rng.normal() * noise), float(summer), float(breaks)))
    pieces = spark.createDataFrame(rows, "signal string, day string, month string, y double, x1 double, x2 double")
    found = {(r["signals"], r["parameter"]): r for r in leaving.joint_shares(pieces, {"both": ["rail", "bike"], "bike": ["bike"]}, draws=200).collect()}
    for (label, parameter), want in {("both", "share_summer"): 0.8, ("both", "share_breaks"): 0.4, ("both", "k_rail"): -6.0, ("both", "k_bike"): -2.0, ("bike", "share_summer"): 0.8}.items():
        row = found[label, parameter]
        assert row["estimate"] == pytest.approx(want, abs=0.03) and row["low"] <= row["estimate"] <= row["high"]
    width = {label: found[label, "share_summer"]["high"] - found[label, "share_summer"]["low"] for label in ("both", "bike")}
    assert width["both"] < width["bike"] / 3  # the quiet signal decides
    assert found["both", "share_summer"]["signal_weeks"] == 800


def test_draws_are_those_of_the_block_table(spark):
    counts = leaving.draw_counts(20, 7, seed=5)
    table = {(r["draw"], r["block"]): r["times"] for r in resample.draw_blocks(spark, 20, 7, seed=5).collect()}
    assert {(d, b): counts[d, b] for d, b in zip(*np.nonzero(counts))} == table


def test_month_records_are_written_as_json_and_replaced(spark, tmp_path):
    def trip(month, start, station, minutes=10, layout="modern"):
        begin = datetime.fromisoformat(start)
        return (month, layout, begin, begin + timedelta(minutes=minutes), station, "Stop", "Stop", minutes * 60)

    schema = "month string, layout string, started_at timestamp, ended_at timestamp, start_station_id string, start_station_name string, end_station_name string, duration_s long"
    rows = [
        trip("202001", "2020-01-02 10:00", "a"), trip("202001", "2020-01-05 10:00", "a"), trip("202001", "2020-01-06 10:00", "b"), trip("202001", "2020-01-07 10:00", None),
        trip("202001", "2020-02-01 00:10", "c"), trip("202001", "2020-01-08 10:00", "d", 0), trip("202002", "2020-02-03 10:00", "c", layout="legacy"), trip("202002", "2020-02-03 11:00", "c"),
    ]
    records = events.month_records(spark.createDataFrame(rows, schema))
    files.write_json_records(records, f"{tmp_path}/qa")
    files.write_json_records(records.filter("month = '202002'"), f"{tmp_path}/qa")  # the other month stays
    found = {r["month"]: r for r in files.read_json_records(spark, f"{tmp_path}/qa", records.schema).collect()}
    first, second = found["202001"], found["202002"]
    assert (first["rows_raw"], first["rows_too_short"], first["rows_kept"], first["rows_no_start_station"], first["rows_out_of_month"], first["n_stations"], first["layout"]) == (6, 1, 5, 1, 1, 2, "modern")
    assert (first["first_start"], first["last_start"]) == (datetime(2020, 1, 2, 10), datetime(2020, 2, 1, 0, 10))
    assert (second["rows_raw"], second["n_stations"], second["layout"]) == (2, 1, "mixed")


def rotated_by_hand(rows, least=3):
    units = sorted({r[0] for r in rows})
    at = {(u, w): (y, x) for u, w, y, x in rows}
    out = {}
    for k in range(1, len(units)):
        pairs = [(at[u, w][0], at[d, w][1]) for n, u in enumerate(units) for d in [units[(n + k) % len(units)]] for w in range(60) if (u, w) in at and (d, w) in at]
        pairs = np.array([p for p in pairs if None not in p], float).reshape(-1, 2)
        if len(pairs) >= least:
            y, x = (pairs - pairs.mean(axis=0)).T
            out[k] = (len(pairs), x @ y / (x @ x) if np.ptp(pairs[:, 1]) else None)
    return out


@pytest.mark.parametrize("units, share", [(301, 0.7), (40, 0.04), (2, 1.0)])
def test_rotation_slopes_need_no_rows_per_rotation(spark, monkeypatch, units, share):
    rng = random.Random(units)
    rows = [(u, w, None if rng.random() < 0.1 else 8 + rng.gauss(0, 1), None if u % 9 == 5 else 0.07 * rng.random()) for u in range(units) for w in range(60) if rng.random() < share]
    asked = []
    monkeypatch.setattr(panel, "rotations", lambda rows, unit, only: asked.append(only.count()) or joins.rotations(rows, unit, only))
    monkeypatch.setattr(panel, "SPECTRUM", 16)
    found = panel.rotation_slopes(spark.createDataFrame(rows, "u long, w int, y double, x double"), "u", "w", "y", "x")
    got, want = {r["k"]: (r["n"], r["slope"]) for r in found.collect()}, rotated_by_hand(rows)
    assert sum(asked) < 5  # only rotations without a spread are joined
    assert set(got) == set(want) and all(got[k] == (n, v if v is None else pytest.approx(v, rel=1e-7)) for k, (n, v) in want.items())


def test_rotations_of_one_giver_or_one_value_have_no_slope(spark):
    alone = [("a", w, float(w * w), 0.1) for w in range(4)] + [("b", w, float(w), None) for w in range(4)] + [("c", 9, 1.0, 0.7), ("d", 8, 2.0, 0.2), ("e", 1, 5.0, None)]
    frame = spark.createDataFrame(alone, "u string, w int, y double, x double")
    got = {r["k"]: (r["n"], r["slope"]) for r in panel.rotation_slopes(frame, "u", "w", "y", "x").collect()}
    assert got == rotated_by_hand(alone) == {4: (4, None)}
    same = panel.rotation_slopes(frame.withColumn("x", F.lit(0.3)), "u", "w", "y", "x").collect()
    assert same and all(r["slope"] is None for r in same)
    assert panel.rotation_slopes(frame.filter("false"), "u", "w", "y", "x").count() == 0


def test_station_days_of_many_rows_are_dealt_over_more_tasks(spark, sf, monkeypatch):
    days = {tuple(r) for r in adapters.station_days(spark, sf).collect()}
    monkeypatch.setattr(events, "TASK_ROWS", 300)
    found = adapters.station_days(spark, sf)
    assert {tuple(r) for r in found.collect()} == days and len(days) > 3_000
    rows = found.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(rows) > 4 and max(r["n"] for r in rows) < 450  # more tasks than the session's shuffle partitions, as many rows in each
    days_twice = tables.load_station_days(found, events.clean(adapters.trips(spark, sf)))
    assert {(r["date"], r["station_id"], r["trips"] / 2) for r in days_twice.collect()} == {(d[0], d[1], d[2]) for d in days}


def test_spilled_trips_are_found_in_one_pass(spark, sf):
    text = q_events.k6_unseen_spill(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan parquet") == 2  # a scan of each layout
    at = datetime(2023, 5, 1, 7)
    rows = [("seen", at, "202304"), ("seen", at, "202305"), ("late", at, "202304"), ("late", at + timedelta(1), "202304"), (None, at, "202304"), (None, at, "202305"), ("none", None, None), ("own", at, "202305")]
    got = events.unseen_spill(spark.createDataFrame(rows, "trip_key string, started_at timestamp_ntz, month string"))
    assert sorted((r["trip_key"] or "", r["started_at"]) for r in got.collect()) == [("", at), ("late", at)]


def test_equal_points_meet_once_as_neighbours(spark, monkeypatch):
    rng = random.Random(2)
    asked = [(n, rng.choice([0.0, 1.0, 2.5, None])) for n in range(300)]
    given = [(n, rng.choice([0.0, 3.0, 4.0, None]), float(rng.randrange(9))) for n in range(200)]
    packed, met = models._packed, []
    monkeypatch.setattr(models, "_packed", lambda df, *rest: met.append(df.count()) or packed(df, *rest))
    found = models.nearest_neighbours(spark.createDataFrame(asked, "id int, a double"), "id", spark.createDataFrame(given, "k int, a double, l double"), "k", ["a"], "l", 3)
    got = {r["id"]: r["predicted"] for r in found.collect()}
    assert len(got) == 300 and met == [4, 12]  # points asked for, and three training rows of each point
    for n, a in asked:
        near = sorted((abs(a - b), k, v) for k, b, v in given if b is not None)[:3] if a is not None else []
        alone = [v for d, _, v in near if d == 0]
        want = sum(alone) / len(alone) if alone else sum(v / d for d, _, v in near) / sum(1 / d for d, _, v in near) if near else None
        assert got[n] == (want if want is None else pytest.approx(want))
