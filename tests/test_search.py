"""Model search, splines and panel reports against fits on rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.operators import models, panel, reports, search
from ebbtide.plans import q_learning, q_models, q_search, q_tables


def ridge(x, y, penalty, constant=0):
    scale = penalty * x.var(axis=0)
    scale[constant] = 0
    return np.linalg.pinv(x.T @ x + np.diag(scale)) @ x.T @ y


@pytest.fixture(scope="module")
def weeks(spark, sf):
    return q_search._weeks(spark, sf)


def test_search_equals_refits_on_rows(spark, weeks):
    kinds = search.designs(["rain", "snow"], ["sin_1", "cos_1"], ["rain_2", "rain_k1"])
    members = [search.Member("linear", tuple(kinds["linear"])), search.Member("ridge", tuple(kinds["linear"]), 10.0), search.Member("splines", tuple(kinds["smooth"]), 1.0),
               search.Member("hybrid", ("one", "rain"), 0.0, tuple(kinds["smooth"]), 5.0)]
    got = {(r["week_start"], r["model"]): r["predicted"] for r in search.model_search(weeks, members, ["ridge", "splines"], "y", "month", "week_start", "inner").collect()}
    data = weeks.toPandas().sort_values("week_start").reset_index(drop=True)
    y, when = data["y"].to_numpy(), data["week_start"].to_numpy().astype("datetime64[D]")

    def guess(member, fit, at):
        x = data[list(member.columns)].to_numpy()
        beta = ridge(x[fit], y[fit], member.penalty)
        out, left = x[at] @ beta, y[fit] - x[fit] @ beta
        if member.then:
            z = data[list(member.then)].to_numpy()
            out = out + z[at] @ ridge(z[fit], left, member.then_penalty)
        return out

    for month in sorted(data["month"].unique())[::9]:
        test = (data["month"] == month).to_numpy()
        train = np.flatnonzero((when < when[test].min() - np.timedelta64(7, "D")) | (when > when[test].max() + np.timedelta64(7, "D")))
        at = np.flatnonzero(test)
        single = np.column_stack([guess(m, train, at) for m in members])
        oof = np.zeros((len(train), len(members)))
        for g in range(3):
            held = (data["inner"].to_numpy()[train] == g)
            oof[held] = np.column_stack([guess(m, train[~held], train[held]) for m in members])
        few = [1, 2]
        w = models.non_negative(oof.T @ oof, oof.T @ y[train])
        v = models.non_negative(oof[:, few].T @ oof[:, few], oof[:, few].T @ y[train])
        want = dict(zip([m.name for m in members], single.T)) | {
            "stacked, all": single @ (w / w.sum()), "stacked, few": single[:, few] @ (v / v.sum()), "mean of all": single.mean(axis=1), "mean of few": single[:, few].mean(axis=1),
            "chosen by cross-validation": single[:, np.argmin(((oof - y[train, None]) ** 2).mean(axis=0))],
        }
        for name, values in want.items():
            for n, value in zip(at, values):
                assert got[data["week_start"][n], name] == pytest.approx(value, rel=1e-5), (month, name)


def test_splines_equal_fits_on_rows(spark, sf, weeks):
    got = {r["year"]: r["rmse"] for r in q_tables.l8_splines(spark, sf).collect()}
    data = weeks.toPandas()
    x, y, when = data[["one", "rain", "rain_2", "rain_k0", "rain_k1", "rain_k2"]].to_numpy(), data["y"].to_numpy(), data["week_start"].to_numpy().astype("datetime64[D]")
    error = np.zeros(len(y))
    for month in data["month"].unique():
        test = (data["month"] == month).to_numpy()
        train = (when < when[test].min() - np.timedelta64(7, "D")) | (when > when[test].max() + np.timedelta64(7, "D"))
        error[test] = y[test] - x[test] @ np.linalg.lstsq(x[train], y[train], rcond=None)[0]
    for year, rmse in got.items():
        assert rmse == pytest.approx(np.sqrt(np.mean(error[data["year"] == year] ** 2)), rel=1e-4)


def test_permutation_of_a_useless_input_costs_nothing(spark, sf):
    rows = {r["input"]: r["rmse"] for r in q_learning.l13_permutation_importance(spark, sf).collect()}
    data = q_learning._learning(spark, sf).toPandas()
    x = np.column_stack([np.ones(len(data)), data[q_learning._FEATURES]])
    full = np.sqrt(np.mean((data["y"] - x @ np.linalg.lstsq(x, data["y"], rcond=None)[0]) ** 2))
    assert set(rows) == set(q_learning._FEATURES) and all(v >= full * (1 - 1e-6) for v in rows.values()) and rows["rain"] > full


def test_chosen_penalty_is_one_of_the_grid(spark, sf):
    assert q_learning.l9_grouped_choice(spark, sf).first()["penalty"] in (0.01, 1.0, 100.0)


def test_tree_families_run_with_few_trees(spark, sf, monkeypatch):
    monkeypatch.setattr(q_learning, "TREES", 3)
    scores = {r["family"]: r["rmse"] for r in q_learning.l18_family_scores(spark, sf).collect()}
    assert set(scores) == {"linear", "ridge", "lasso", "forest", "boosting"} and all(v > 0 for v in scores.values())
    weights = {r["member"]: r["weight"] for r in q_learning.l11_stack_weights(spark, sf).collect()}
    assert sum(weights.values()) == pytest.approx(1) and min(weights.values()) >= 0


def test_demeaned_rows_keep_null_groups_and_lose_their_means(spark):
    rows = spark.createDataFrame([(a, b, float(3 * (a or 7) + 5 * b + k)) for k, (a, b) in enumerate([(1, 1), (1, 2), (2, 1), (None, 2), (None, 1), (2, 3)])], "a int, b int, y double")
    out = panel.demean(rows, ["y"], [["a"], ["b"]]).toPandas()
    assert len(out) == 6
    for key in ("a", "b"):
        assert np.allclose(out.groupby(key, dropna=False)["y"].mean(), 0, atol=1e-9)


def test_combined_effect_of_two_coefficients():
    effect, se = panel.combination(np.array([1.0, 2.0, 3.0]), np.diag([1.0, 4.0, 9.0]), {"b": 1.0, "c": -1.0}, ["a", "b", "c"])
    assert (effect, se) == (-1.0, pytest.approx(13**0.5))


def test_panel_report_equals_dummy_regression(spark, sf):
    rows = q_tables.b19_panel_units(spark, sf)
    got = {(r["model"], r["term"], r["metric"]): r["value"] for r in q_tables.m19_panel_report(spark, sf).collect()}
    data = rows.toPandas()
    year = data["week_start"].map(lambda d: d.year)
    dummies = [((data["unit"] == u) & (year == y)).astype(float) for u in data["unit"].unique() for y in year.unique()] + [(data["week_start"] == w).astype(float) for w in data["week_start"].unique()]
    d = np.column_stack(dummies)
    d = d[:, d.any(axis=0)]
    beta = np.linalg.lstsq(np.column_stack([data["session_share"], d]), data["y"], rcond=None)[0][0]
    assert got["pooled", "session_share", "effect_pct"] == pytest.approx(100 * (np.exp(beta) - 1), rel=1e-5)
    units = sorted(data["unit"].unique())
    each = np.column_stack([np.where(data["unit"] == u, data["session_share"], 0) for u in units])
    betas = np.linalg.lstsq(np.column_stack([each, d]), data["y"], rcond=None)[0][: len(units)]
    for u, b in zip(units, betas):
        assert got["by unit", u, "effect_pct"] == pytest.approx(100 * (np.exp(b) - 1), rel=1e-4, abs=1e-6)
        shares = [v for (m, t, k), v in got.items() if m == "by unit" and t == u and k.endswith("_week_share")]
        assert sum(shares) == pytest.approx(1)
    assert got["placebo", "session_share", "rotations"] == len(units) - 1
    slopes = {r["k"]: r["beta"] for r in reports.placebo_slopes(rows, "session_share", "y", "unit", "week_start").collect()}
    assert got["placebo", "session_share", "rotations_at_least_own"] == sum(b >= beta for b in slopes.values())


def test_fewer_students_away_when_all_stay(spark, sf):
    rows = q_models._series(spark, sf)
    assert rows.filter(F.col("one") != 1).count() == 0
    runs = q_search.b9_scenarios(spark, sf).groupBy("scenario").agg(F.avg("population").alias("p")).collect()
    mean = {r["scenario"]: r["p"] for r in runs}
    assert len(mean) == 5 and mean["remote fall"] < mean["baseline"] and mean["more students"] > mean["fewer students"]
