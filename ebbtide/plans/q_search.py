"""Queries over model search, input sets, scenarios and the modelling table."""

from pyspark.sql import functions as F

from ebbtide.operators import joins, panel, search, tables, timeline, whatif
from ebbtide.plans import adapters as A
from ebbtide.plans import registry
from ebbtide.plans.q_calendars import a7_weather_weekly, p13_week_terms
from ebbtide.plans.q_events import a13_by_zone
from ebbtide.plans.q_models import _SERIES, _series
from ebbtide.plans.q_presence import _PRESENCE, _halls, _per_institution, a10_presence_index
from ebbtide.plans.registry import query
from ebbtide.plans.scratch import materialize

#: Newey-West lags of the weekly regressions and their Bartlett weights.
_LAGS = {k: 1 - k / 5 for k in range(1, 5)}


def _robust(score: str) -> str:
    """SQL of a robust variance from a column of scores in order of weeks."""
    return f"sum({score} * {score}) + " + " + ".join(f"2 * {w!r}::DOUBLE * coalesce(sum({score} * {score}_{k}), 0)" for k, w in _LAGS.items())


def _lagged(score: str) -> str:
    return ", ".join(f"lag({score}, {k}) OVER (ORDER BY week_start) AS {score}_{k}" for k in _LAGS)


@query(
    "m5_newey_west",
    f"""WITH {_SERIES}, f AS (SELECT regr_slope(y, rain) AS b, regr_intercept(y, rain) AS a, count(*) AS n, sum(rain) AS sx, sum(rain * rain) AS sxx FROM dat),
    e AS (SELECT week_start, (sxx - sx * rain) / (n * sxx - sx * sx) * (y - a - b * rain) AS s0, (n * rain - sx) / (n * sxx - sx * sx) * (y - a - b * rain) AS s1 FROM dat, f), l AS (SELECT *, {_lagged('s0')}, {_lagged('s1')} FROM e),
    v AS (SELECT {_robust('s0')} AS v0, {_robust('s1')} AS v1 FROM l) SELECT 'one' AS input, a AS beta, sqrt(v0) AS se FROM f, v UNION ALL SELECT 'rain', b, sqrt(v1) FROM f, v""",
)
def m5_newey_west(spark, sf_dir):
    """A weekly regression with errors robust to autocorrelation (M3, M5)."""
    rows = materialize(_series(spark, sf_dir).select("week_start", "one", "rain", "y"), "series")
    beta = panel.fit(rows, ["one", "rain"], "y")
    covariance = panel.newey_west_covariance(rows, ["one", "rain"], "y", beta, "week_start")
    return spark.createDataFrame([(c, float(b), float(v) ** 0.5) for c, b, v in zip(("one", "rain"), beta, covariance.diagonal())], "input string, beta double, se double")


@query(
    "m9_combined_effect",
    f"""WITH {_SERIES}, z AS (SELECT week_start, y - avg(y) OVER () AS y, rain - avg(rain) OVER () AS p, rain * rain / 100 - avg(rain * rain / 100) OVER () AS q FROM dat),
    s AS (SELECT sum(p * p) AS pp, sum(p * q) AS pq, sum(q * q) AS qq, sum(p * y) AS py, sum(q * y) AS qy FROM z), f AS (SELECT *, pp * qq - pq * pq AS det FROM s),
    b AS (SELECT (qq * py - pq * qy) / det AS b1, (pp * qy - pq * py) / det AS b2, (20 * qq - 4 * pq) / det AS u1, (4 * pp - 20 * pq) / det AS u2 FROM f),
    t AS (SELECT week_start, (u1 * p + u2 * q) * (y - b1 * p - b2 * q) AS t FROM z, b), l AS (SELECT *, {_lagged('t')} FROM t), v AS (SELECT sqrt({_robust('t')}) AS se FROM l)
    SELECT 20 * b1 + 4 * b2 AS effect, se, 20 * b1 + 4 * b2 - 1.96 * se AS low, 20 * b1 + 4 * b2 + 1.96 * se AS high FROM b, v""",
)
def m9_combined_effect(spark, sf_dir):
    """Change from 0 to 20 mm of rain through both of its terms, with its robust error (M9)."""
    rows = materialize(_series(spark, sf_dir).select("week_start", "one", "rain", (F.col("rain") * F.col("rain") / 100).alias("rain_2"), "y"), "series")
    x = ["one", "rain", "rain_2"]
    beta = panel.fit(rows, x, "y")
    effect, se = panel.combination(beta, panel.newey_west_covariance(rows, x, "y", beta, "week_start"), {"rain": 20.0, "rain_2": 4.0}, x)
    return spark.createDataFrame([(effect, se, effect - 1.96 * se, effect + 1.96 * se)], "effect double, se double, low double, high double")


# --- model search


def _weeks(spark, sf_dir):
    """The weekly series with harmonics, a spline basis of rain and inner folds of whole calendar months."""
    rows = tables.splines(_series(spark, sf_dir), "rain", [20.0, 60.0, 100.0]).withColumns(timeline.harmonics(F.col("week_start")))
    return materialize(rows.withColumns({"inner": F.month("week_start") % 3, "year": F.year("week_start")}), "weeks")


_WEATHER, _SEASON, _BASIS = ["rain", "snow"], ["sin_1", "cos_1", "sin_2", "cos_2"], ["rain_2", "rain_k0", "rain_k1", "rain_k2"]
_MONTHS = "f AS (SELECT month AS held, min(week_start) - 7 AS lo, max(week_start) + 7 AS hi FROM dat GROUP BY ALL), tr AS (SELECT held, d.*, month(week_start) % 3 AS inn FROM f JOIN dat d ON d.week_start < lo OR d.week_start > hi)"


@query(
    "l12_combinations",
    f"""WITH {_SERIES}, {_MONTHS}, g AS (SELECT unnest([0, 1, 2]) AS g),
    b AS (SELECT held, regr_slope(y, rain) AS rb, regr_intercept(y, rain) AS ra, regr_slope(y, snow) AS sb, regr_intercept(y, snow) AS sa FROM tr GROUP BY held),
    r AS (SELECT b.held, regr_slope(y - ra - rb * rain, snow) AS hb, regr_intercept(y - ra - rb * rain, snow) AS ha FROM tr JOIN b USING (held) GROUP BY b.held),
    i AS (SELECT held, g, regr_slope(y, rain) AS rb, regr_intercept(y, rain) AS ra, regr_slope(y, snow) AS sb, regr_intercept(y, snow) AS sa FROM tr, g WHERE inn <> g GROUP BY ALL),
    ih AS (SELECT i.*, hb, ha FROM i JOIN (SELECT i.held, i.g, regr_slope(y - ra - rb * rain, snow) AS hb, regr_intercept(y - ra - rb * rain, snow) AS ha FROM tr JOIN i ON i.held = tr.held AND inn <> i.g GROUP BY ALL) USING (held, g)),
    c AS (SELECT tr.held, sum((y - ra - rb * rain) ** 2) AS ce, sum((y - sa - sb * snow) ** 2) AS se, sum((y - ra - rb * rain - ha - hb * snow) ** 2) AS he FROM tr JOIN ih ON ih.held = tr.held AND ih.g = inn GROUP BY tr.held),
    p AS (SELECT y, ra + rb * rain AS p1, sa + sb * snow AS p2, ra + rb * rain + ha + hb * snow AS p3, CASE WHEN ce <= se AND ce <= he THEN 1 WHEN se <= he THEN 2 ELSE 3 END AS pick FROM dat JOIN b ON b.held = month JOIN r ON r.held = month JOIN c ON c.held = month),
    u AS (SELECT y, unnest(['rain', 'snow', 'rain, then snow', 'mean of all', 'mean of few', 'chosen by cross-validation']) AS model, unnest([p1, p2, p3, (p1 + p2 + p3) / 3, (p1 + p2) / 2, CASE pick WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END]) AS p FROM p)
    SELECT model, count(*) AS n, avg(abs(y - p)) AS mae, sqrt(avg((y - p) ** 2)) AS rmse, 1 - sum((y - p) ** 2) / (sum(y * y) - sum(y) * sum(y) / count(*)) AS r2 FROM u GROUP BY model""",
)
def l12_combinations(spark, sf_dir):
    """Means, the choice by cross-validation and a fit to what another leaves, each month held out."""
    members = [search.Member("rain", ("one", "rain")), search.Member("snow", ("one", "snow")), search.Member("rain, then snow", ("one", "rain"), then=("one", "snow"))]
    found = search.model_search(_weeks(spark, sf_dir), members, ["rain", "snow"], "y", "month", "week_start", "inner")
    return panel.scores(found.filter("model not like 'stacked%'"), "y", "predicted", ["model"])


@query(
    "l14_feature_sets",
    f"""WITH {_SERIES}, o AS (SELECT *, row_number() OVER (ORDER BY week_start) % 2 AS half FROM dat), pc AS (SELECT (corr(y, snow) - corr(y, rain) * corr(snow, rain)) ** 2 / ((1 - corr(y, rain) ** 2) * (1 - corr(snow, rain) ** 2)) AS pc FROM dat)
    SELECT 'weather' AS features, 2 AS inputs, 1 - (1 - regr_r2(y, rain)) * (1 - any_value(pc)) AS r2 FROM dat, pc UNION ALL SELECT 'season', 1, regr_r2(y, month(week_start)) FROM dat UNION ALL SELECT 'students', 1, regr_r2(y, (month(week_start) IN (6, 7))::INT) FROM dat""",
)
def l14_feature_sets(spark, sf_dir):
    """R2 of named sets of inputs, from one set of sums of products."""
    rows = _series(spark, sf_dir).withColumns({"month_of": F.month("week_start").cast("double"), "summer": F.month("week_start").isin(6, 7).cast("double")})
    sets = search.feature_sets(["rain", "snow"], ["month_of"], ["summer"])
    inputs = ["rain", "snow", "month_of", "summer"]
    return search.r2_of_sets(rows, {name: sets[name] for name in ("weather", "season", "students")}, inputs, "y")


@query("l17_model_search")
def l17_model_search(spark, sf_dir):
    """All members, stacks, means and choices, each month held out with a buffer, from sums of products."""
    kinds = search.designs(_WEATHER, _SEASON, _BASIS)
    members = [
        search.Member("linear", tuple(kinds["linear"])), search.Member("ridge", tuple(kinds["linear"]), 10.0), search.Member("splines", tuple(kinds["smooth"]), 1.0),
        search.Member("weather only", ("one", *_WEATHER)), search.Member("ridge, then splines", tuple(kinds["linear"]), 10.0, tuple(kinds["smooth"]), 10.0),
    ]
    found = search.model_search(_weeks(spark, sf_dir), members, ["ridge", "splines", "ridge, then splines"], "y", "month", "week_start", "inner")
    return panel.scores(found, "y", "predicted", ["model"])


_GRID = f"""{_SERIES}, sg AS (SELECT date_trunc('week', l_shipdate)::DATE AS week_start, sum(l_quantity) AS z FROM lineitem GROUP BY ALL), d AS (SELECT dat.*, z, year(week_start) AS year FROM dat JOIN sg USING (week_start)),
    long AS (SELECT week_start, year, month, unnest(['trips', 'quantity']) AS signal, unnest([y, z]) AS y, rain, snow FROM d), x AS (SELECT * EXCLUDE (rain, snow), unnest(['rain', 'snow']) AS features, unnest([rain, snow]) AS x FROM long),
    h AS (SELECT 'month' AS split, month AS held, min(week_start) - 7 AS lo, max(week_start) + 7 AS hi FROM d GROUP BY ALL UNION ALL SELECT 'year', year::VARCHAR, min(week_start), max(week_start) FROM d GROUP BY ALL),
    b AS (SELECT split, held, signal, features, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(y) AS m FROM h JOIN x ON x.week_start < lo OR x.week_start > hi GROUP BY ALL),
    p AS (SELECT b.split, x.signal, x.features, year, y, unnest(['linear', 'level']) AS model, unnest([a + b * x, m]) AS p FROM x JOIN b ON b.signal = x.signal AND b.features = x.features AND b.held = CASE b.split WHEN 'month' THEN x.month ELSE x.year::VARCHAR END),
    w AS (SELECT split, signal, features, model, quantile_cont(abs(y - p), 0.95) AS w FROM p WHERE year % 2 = 0 GROUP BY ALL), cv AS (SELECT split, signal, features, model, avg((abs(y - p) <= w)::INT) AS coverage FROM p JOIN w USING (split, signal, features, model) WHERE year % 2 = 1 GROUP BY ALL),
    s AS (SELECT split, signal, features, model, count(*) AS n, avg(abs(y - p)) AS mae, sqrt(avg((y - p) ** 2)) AS rmse, 1 - sum((y - p) ** 2) / (sum(y * y) - sum(y) * sum(y) / count(*)) AS r2 FROM p GROUP BY ALL)"""


@query("l18_signal_grid", f"WITH {_GRID} SELECT * FROM s JOIN cv USING (split, signal, features, model)")
def l18_signal_grid(spark, sf_dir):
    """Scores and coverage over signal, set of inputs, family and split."""
    quantity = A.table(spark, sf_dir, "lineitem").groupBy(timeline.week_of(F.to_date("l_shipdate")).alias("week_start")).agg(F.sum("l_quantity").alias("quantity"))
    rows = _series(spark, sf_dir).withColumnRenamed("y", "trips").join(quantity, "week_start").withColumns({"inner": F.month("week_start") % 3, "year": F.year("week_start")})
    rows, out = materialize(rows.withColumn("each_year", F.col("year").cast("string")), "signals"), None
    for split, held, buffer in (("month", "month", 7), ("year", "each_year", 0)):
        for signal in ("trips", "quantity"):
            for features in ("rain", "snow"):
                members = [search.Member("linear", ("one", features)), search.Member("level", ("one",))]
                part = search.model_search(rows.withColumn("y", F.col(signal)), members, ["linear", "level"], "y", held, "week_start", "inner", buffer)
                part = part.filter("model in ('linear', 'level')").select("year", "y", "predicted", "model", *(F.lit(v).alias(c) for c, v in (("split", split), ("signal", signal), ("features", features))))
                out = part if out is None else out.unionByName(part)
    out, by = materialize(out, "grid"), ["split", "signal", "features", "model"]
    return panel.scores(out, "y", "predicted", by).join(search.coverage(out, "y", "year", by), by)


# --- scenarios

_YEAR, _SHARES, _CENSUS = 1998, (0.66, 0.72), 50_000.0
_RUNS = (("baseline", 0.0), ("fewer students", -0.1), ("more students", 0.1), ("aligned breaks", 0.0), ("remote fall", 0.0))


def _runs(spark, sf_dir):
    base = materialize(_per_institution(spark, sf_dir), "institutions")
    enrolled = A.enrollment(spark, sf_dir).groupBy(F.col("fall_year").alias("acs_year"))
    arrangements = materialize(enrolled.agg(F.sum("dorm_capacity").cast("double").alias("in_university_housing"), F.sum("distance_only").cast("double").alias("elsewhere"), F.sum("total").cast("double").alias("with_parents")), "arrangements")
    remote = A.table(spark, sf_dir, "nation").filter("n_nationkey % 3 = 0").select(F.col("n_nationkey").cast("string").alias("unitid"))
    changed = {"aligned breaks": whatif.align_breaks(base), "remote fall": whatif.remote_fall(base, remote, _YEAR)}
    out = None
    for name, change in _RUNS:
        run = whatif.population(materialize(changed[name], "scenario") if name in changed else base, arrangements, _halls(spark, sf_dir), _SHARES, _CENSUS, change)
        run = run.filter(timeline.fall_year(F.col("week_start")) == _YEAR).select(F.lit(name).alias("scenario"), "*")
        out = run if out is None else out.unionByName(run)
    return out


_FY = "year(week_start + 3) - (month(week_start + 3) < 8)::INT"
_RUN_SQL = f"""{_PRESENCE}, base AS (SELECT *, {_FY} AS fy FROM pi),
    spr AS (SELECT unitid, fy, week_start, round(1 - session_share - summer_share, 6) AS breaks, in_person::DOUBLE AS weight FROM base WHERE month(week_start + 3) BETWEEN 2 AND 4),
    g1 AS (SELECT *, CASE WHEN date_diff('day', lag(week_start) OVER w, week_start) = 7 THEN 0 ELSE 1 END AS b FROM spr WHERE breaks > 0 WINDOW w AS (PARTITION BY unitid, fy ORDER BY week_start)), r1 AS (SELECT *, sum(b) OVER (PARTITION BY unitid, fy ORDER BY week_start) AS run FROM g1),
    p1 AS (SELECT * FROM (SELECT unitid, fy, week_start AS peak, run, row_number() OVER (PARTITION BY unitid, fy ORDER BY breaks DESC, week_start) AS n FROM r1) WHERE n = 1), w1 AS (SELECT unitid, fy, max(weight) AS weight FROM r1 GROUP BY ALL),
    c1 AS (SELECT fy, peak AS common FROM (SELECT *, row_number() OVER (PARTITION BY fy ORDER BY votes DESC, peak) AS n FROM (SELECT fy, peak, sum(weight) AS votes FROM p1 JOIN w1 USING (unitid, fy) GROUP BY ALL)) WHERE n = 1),
    mv AS (SELECT r1.unitid, r1.week_start, r1.breaks, r1.week_start + date_diff('day', p1.peak, c1.common)::INT AS moved_to FROM r1 JOIN p1 ON r1.unitid = p1.unitid AND r1.fy = p1.fy AND r1.run = p1.run JOIN c1 ON c1.fy = r1.fy),
    sf AS (SELECT unitid, week_start, sum(x) AS x FROM (SELECT unitid, week_start, breaks AS x FROM mv UNION ALL SELECT unitid, moved_to, -breaks FROM mv) GROUP BY ALL),
    sc AS (SELECT name AS scenario, change, base.* REPLACE (CASE name WHEN 'aligned breaks' THEN least(greatest(session_share + coalesce(x, 0), 0), 1) WHEN 'remote fall' THEN CASE WHEN base.unitid::INT % 3 = 0 AND fy = {_YEAR} AND month(base.week_start + 3) BETWEEN 8 AND 12 THEN 0 ELSE session_share END ELSE session_share END AS session_share)
        FROM base LEFT JOIN sf ON sf.unitid = base.unitid AND sf.week_start = base.week_start, (VALUES {', '.join(map(str, _RUNS))}) v(name, change)),
    ar AS (SELECT fall_year AS acs_year, sum(dorm_capacity)::DOUBLE AS housing, sum(distance_only)::DOUBLE AS elsewhere FROM enr GROUP BY ALL), sq AS (SELECT min(acs_year) AS lo, max(acs_year) AS hi FROM ar),
    wk1 AS (SELECT scenario, change, week_start, fy, 1 - sum(in_person * session_share) / sum(normal_in_person) AS out, sum(in_person * summer_share) / sum(in_person) AS sb, 1 - sum(dorm_capacity * session_share) / sum(dorm_capacity) AS hout,
        sum(dorm_capacity * (summer_share + greatest(1 - session_share - summer_share, 0) * (coalesce(CASE WHEN month(week_start + 3) = 11 THEN thanksgiving WHEN month(week_start + 3) IN (12, 1) THEN winter ELSE spring END, 'unknown') = 'closed')::INT)) / sum(dorm_capacity) AS closed FROM sc LEFT JOIN halls USING (unitid) GROUP BY ALL),
    wk2 AS (SELECT wk1.*, housing * (1 + change) AS housing, elsewhere * (1 + change) AS elsewhere, least(sb, out) AS summer, CASE WHEN out - least(sb, out) > 1e-12 THEN out - least(sb, out) ELSE 0 END AS breaks FROM wk1, sq JOIN ar ON acs_year = least(greatest(fy, lo), hi)),
    aw AS (SELECT *, least(greatest((housing + elsewhere) * ({_SHARES[0]}::DOUBLE * summer + {_SHARES[1]}::DOUBLE * breaks), housing * closed), housing * hout + elsewhere * out) AS away FROM wk2 WHERE fy = {_YEAR}),
    po AS (SELECT scenario, week_start, away AS students_away, {_CENSUS}::DOUBLE + change::DOUBLE / (1 + change::DOUBLE) * (housing + elsewhere) - away AS population FROM aw)"""


@query("b9_scenarios", f"WITH {_RUN_SQL} SELECT * FROM po")
def b9_scenarios(spark, sf_dir):
    """Five what-ifs through the presence functions: as it is, fewer and more students, breaks aligned, a remote fall."""
    return _runs(spark, sf_dir)


@query("b9_scenario_summary", f"WITH {_RUN_SQL} SELECT p.scenario, avg(p.population) AS mean, min(p.population) AS lowest, avg(p.population - b.population) AS mean_change, max(p.students_away) AS most_away FROM po p JOIN po b ON b.scenario = 'baseline' AND b.week_start = p.week_start GROUP BY ALL")
def b9_scenario_summary(spark, sf_dir):
    """Means and changes of the five what-ifs against the first."""
    runs = materialize(_runs(spark, sf_dir), "runs")
    changes = whatif.against_baseline(runs, runs.filter("scenario = 'baseline'"), "population")
    return changes.groupBy("scenario").agg(F.avg("population").alias("mean"), F.min("population").alias("lowest"), F.avg("change").alias("mean_change"), F.max("students_away").alias("most_away"))


# --- the modelling table

_SOURCES = ("p13_week_terms", "a7_weather_weekly", "a13_by_zone", "a10_presence_index")


@query("b6_modelling_weekly", "SELECT * FROM " + " JOIN ".join(f"({registry.oracle_of(name)}) s{n}" if n == 0 else f"({registry.oracle_of(name)}) s{n} USING (week_start)" for n, name in enumerate(_SOURCES)).replace(" JOIN (", " LEFT JOIN ("))
def b6_modelling_weekly(spark, sf_dir):
    """Calendar terms, weather, trips by zone and presence of every week of the spine."""
    return joins.onto_spine(p13_week_terms(spark, sf_dir), [a7_weather_weekly(spark, sf_dir), a13_by_zone(spark, sf_dir), a10_presence_index(spark, sf_dir)])
