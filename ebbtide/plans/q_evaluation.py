"""Queries of evaluations: models by subset, summer change, bounds and the tables read from them."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ebbtide import config
from ebbtide.operators import evaluation, timeline
from ebbtide.plans import adapters as A
from ebbtide.plans.q_models import _SERIES, _series
from ebbtide.plans.q_population import _CALENDAR, _products_sql, _solved_sql, calendar_inputs
from ebbtide.plans.q_presence import a27_within_year_corr, a28_break_summary, a29_street_rows
from ebbtide.plans.q_search import _LAGS, _lagged, _robust
from ebbtide.plans.registry import oracle_of, query
from ebbtide.plans.scratch import materialize

# --- models by subset

_FAMILIES = {"weather": ["rain", "snow"], "weather and season": ["rain", "snow", "sin_1", "cos_1"]}
_EXTRA = {"baseline": [], "index": ["out"], "index and summer": ["out", "summer"]}
_EFFECT = -0.3
_SUBSETS = {"all weeks": "true", "not fully in session": "out > 0", "fully in session": "out = 0", "summer": "summer >= 0.5", "breaks": "out > 0 AND summer < 0.5"}


def _target_weeks(spark, sf_dir):
    """Logarithm of the week's shipments, lower when customers are out of session; weather, season and calendar beside it."""
    rows = _series(spark, sf_dir).join(calendar_inputs(spark, sf_dir).select("week_start", "out", "summer"), "week_start")
    rows = rows.withColumns(timeline.harmonics(F.col("week_start"), 1)).withColumn("y", F.ln("y") + _EFFECT * F.col("out"))
    return rows.withColumn("inner", F.month("week_start") % 3)


_MODELS = {f"{f}|{m}": ["one", *columns, *more] for f, columns in _FAMILIES.items() for m, more in _EXTRA.items()}
_ANGLE = "(date_diff('day', make_date(year(week_start + 3), 1, 1), week_start + 3)) * 2 * pi() / 365.25"
_MEMBERS = " UNION ALL ".join(f"SELECT '{name}' AS member, week_start, month, [{', '.join(columns)}, y]::DOUBLE[] AS x FROM tw" for name, columns in _MODELS.items())
_DEALT = " UNION ALL ".join(f"SELECT '{name}' AS member, week_start, [{', '.join('do_' if c == 'out' else c for c in columns)}]::DOUBLE[] AS z FROM td" for name, columns in _MODELS.items())
_SUBSETS_SQL = " UNION ALL ".join(f"SELECT '{name}' AS subset, week_start FROM tw WHERE {condition}" for name, condition in _SUBSETS.items())
_WITH_EXTRA = [(name, columns, c) for name, columns in _MODELS.items() for c in columns if c in ("out", "summer")]
_PICKED = " UNION ALL ".join(f"SELECT DISTINCT '{name}' AS member, '{c}' AS input, i, j, CASE WHEN j = {len(columns) + 1} THEN (i = {columns.index(c) + 1})::INT::DOUBLE ELSE s END AS s FROM ta WHERE member = '{name}'" for name, columns, c in _WITH_EXTRA)
_PLACE = " ".join(f"WHEN member = '{name}' AND input = '{c}' THEN {columns.index(c) + 1}" for name, columns, c in _WITH_EXTRA)
_EVALUATED = f"""WITH RECURSIVE {_SERIES}, {_CALENDAR},
    tw AS (SELECT d.* EXCLUDE (y), ln(d.y) + {_EFFECT}::DOUBLE * out AS y, out, summer, sin({_ANGLE}) AS sin_1, cos({_ANGLE}) AS cos_1 FROM (SELECT * FROM dat) d JOIN inp USING (week_start)),
    xm AS ({_MEMBERS}), {_products_sql('ta', 'xm', 'member')},
    th AS (SELECT month AS held, min(week_start) - 7 AS lo, max(week_start) + 7 AS hi FROM tw GROUP BY ALL), tn AS (SELECT xm.*, held FROM xm JOIN th ON week_start BETWEEN lo AND hi), {_products_sql('tp', 'tn', 'member, held')},
    tq AS (SELECT tp.member, held, i, j, ta.s - tp.s AS s FROM tp JOIN ta USING (member, i, j)), {_solved_sql('tb', 'tq', 'member, held')},
    td AS (SELECT a.*, b.out AS do_ FROM (SELECT *, row_number() OVER (ORDER BY week_start) AS k FROM tw) a JOIN (SELECT out, row_number() OVER (ORDER BY md5('1-' || week_start), week_start) AS k FROM tw) b USING (k)),
    zm AS ({_DEALT}), su AS ({_SUBSETS_SQL}),
    pr AS (SELECT xm.member, xm.week_start, x[-1] AS y, list_sum(list_transform(range(1, len(b) + 1), lambda i: b[i] * x[i])) AS p, list_sum(list_transform(range(1, len(b) + 1), lambda i: b[i] * z[i])) AS q
        FROM xm JOIN tb ON tb.member = xm.member AND tb.held = xm.month JOIN zm ON zm.member = xm.member AND zm.week_start = xm.week_start),
    sc AS (SELECT split_part(member, '|', 1) AS family, split_part(member, '|', 2) AS model, subset, count(*) AS n, avg(abs(y - p)) AS mae, sqrt(avg((y - p) ** 2)) AS rmse, 1 - sum((y - p) ** 2) / (sum(y * y) - sum(y) * sum(y) / count(*)) AS r2, sqrt(avg((y - q) ** 2)) AS dealt
        FROM pr JOIN su USING (week_start) GROUP BY ALL),
    {_solved_sql('tf', 'ta', 'member')}, ti AS ({_PICKED}), {_solved_sql('tv', 'ti', 'member, input')},
    ts AS (SELECT tv.member, input, xm.week_start, list_sum(list_transform(range(1, len(tv.b) + 1), lambda i: tv.b[i] * x[i])) * (x[-1] - list_sum(list_transform(range(1, len(tf.b) + 1), lambda i: tf.b[i] * x[i]))) AS t, CASE {_PLACE} END AS place, tf.b AS beta
        FROM tv JOIN tf USING (member) JOIN xm USING (member)),
    tl AS (SELECT *, {_lagged('t').replace('OVER (ORDER BY', 'OVER (PARTITION BY member, input ORDER BY')} FROM ts),
    co AS (SELECT split_part(member, '|', 1) AS family, split_part(member, '|', 2) AS model, input, any_value(beta[place]) AS b, sqrt({_robust('t')}) AS se, count(*) AS n FROM tl GROUP BY member, input)
    SELECT family, model, subset, metric, value, n FROM (SELECT family, model, subset, n, unnest(['mae', 'rmse', 'r2', 'rmse_change_percent', 'out_permutation_increase_percent']) AS metric,
        unnest([mae, rmse, r2, CASE WHEN model <> 'baseline' THEN 100 * (rmse / max(rmse) FILTER (model = 'baseline') OVER (PARTITION BY family, subset) - 1) END, CASE WHEN model <> 'baseline' THEN 100 * (dealt / rmse - 1) END]) AS value FROM sc) WHERE value IS NOT NULL
    UNION ALL SELECT family, model, 'all weeks', input || '_' || unnest(['coefficient', 'error', 'effect_percent', 'effect_percent_low', 'effect_percent_high']), unnest([b, se, 100 * (exp(b) - 1), 100 * (exp(b - 1.96 * se) - 1), 100 * (exp(b + 1.96 * se) - 1)]), n FROM co"""
assert len(_LAGS) == 4


@query("l19_subset_scores", _EVALUATED)
def l19_subset_scores(spark, sf_dir):
    """Families x models on held-out months by subset, with the index's permutation loss and robust coefficients."""
    subsets = {name: F.expr(condition) for name, condition in _SUBSETS.items()}
    return evaluation.evaluate_models(_target_weeks(spark, sf_dir), _FAMILIES, _EXTRA, "y", "out", subsets, "month", "week_start", "inner")


@query(
    "l15_version_comparison",
    f"SELECT family, subset, max(value) FILTER (model = 'baseline') AS rmse_baseline, max(value) FILTER (model = 'index') AS rmse_index, max(value) FILTER (model = 'index and summer') AS rmse_index_and_summer FROM ({_EVALUATED}) WHERE metric = 'rmse' GROUP BY ALL",
)
def l15_version_comparison(spark, sf_dir):
    """Held-out errors of the versions side by side."""
    rows = l19_subset_scores(spark, sf_dir).filter("metric = 'rmse'")
    wide = rows.groupBy("family", "subset").pivot("model", list(_EXTRA)).agg(F.first("value"))
    return wide.withColumnsRenamed({"baseline": "rmse_baseline", "index": "rmse_index", "index and summer": "rmse_index_and_summer"})


@query(
    "d9_model_results",
    f"""WITH e AS ({_EVALUATED}), w AS (SELECT family, model, max(value) FILTER (metric = 'rmse') AS rmse, max(value) FILTER (metric = 'r2') AS r2, max(value) FILTER (metric = 'rmse_change_percent') AS gain FROM e WHERE subset = 'all weeks' GROUP BY ALL)
    SELECT family, model, 100 * (exp(rmse) - 1) AS typical_error_percent, r2, -gain AS gain_percent, row_number() OVER (PARTITION BY family ORDER BY rmse, model) AS place FROM w""",
)
def d9_model_results(spark, sf_dir):
    """Accuracy, gain over the baseline and place of every version in its family, for display."""
    rows = l19_subset_scores(spark, sf_dir).filter("subset = 'all weeks'")
    value = {m: F.max(F.when(F.col("metric") == m, F.col("value"))) for m in ("rmse", "r2", "rmse_change_percent")}
    wide = rows.groupBy("family", "model").agg(value["rmse"].alias("rmse"), value["r2"].alias("r2"), value["rmse_change_percent"].alias("gain"))
    # a few models per family
    place = F.row_number().over(W.partitionBy("family").orderBy("rmse", "model"))
    return wide.select("family", "model", (100 * (F.exp("rmse") - 1)).alias("typical_error_percent"), "r2", (-F.col("gain")).alias("gain_percent"), place.alias("place"))


# --- change from session to summer


_MIN_WEEKS = config.MIN_KIND_WEEKS
_SURVEY = {"share_a": "m1", "share_b": "0.5 * m1 + (unit % 7) / 200", "share_c": "(unit % 5) / 10"}


@query(
    "b15_summer_change",
    f"""WITH {_CALENDAR}, e AS (SELECT date_trunc('week', l_shipdate)::DATE AS week_start, l_suppkey AS unit, sum(l_quantity) AS entries FROM lineitem GROUP BY ALL),
    u AS (SELECT s_suppkey AS unit, (s_suppkey % 50) / 100 AS m1 FROM supplier),
    k AS (SELECT unit, CASE WHEN out = 0 THEN 'session' WHEN summer >= 0.95 THEN 'summer' END AS kind, avg(entries * exp(-2::DOUBLE * m1 * summer)) AS m, count(*) AS n FROM e JOIN inp USING (week_start) JOIN u USING (unit) GROUP BY ALL HAVING kind IS NOT NULL AND count(*) >= {_MIN_WEEKS}),
    c AS (SELECT unit, ln(max(m) FILTER (kind = 'summer') / max(m) FILTER (kind = 'session')) AS log_change FROM k GROUP BY unit HAVING count(*) = 2),
    s AS (SELECT log_change, {', '.join(f'({v})::DOUBLE AS {n}' for n, v in _SURVEY.items())} FROM c JOIN u USING (unit))
    SELECT 'survey' AS "check", 'stations' AS subset, unnest(['median_summer_change_percent', {', '.join(f"'corr_summer_change_{n}'" for n in _SURVEY)}]) AS metric, unnest([100 * (exp(median(log_change)) - 1), {', '.join(f'corr(log_change, {n})' for n in _SURVEY)}]) AS value, count(*) AS n FROM s""",
)
def b15_summer_change(spark, sf_dir):
    """Stations' change from full session to full summer weeks, and its correlation with survey shares."""
    units = A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("unit"), (F.col("s_suppkey") % 50 / 100).alias("m1"))
    week = timeline.week_of(F.to_date("l_shipdate")).alias("week_start")
    entries = A.table(spark, sf_dir, "lineitem").groupBy(week, F.col("l_suppkey").alias("unit")).agg(F.sum("l_quantity").alias("entries"))
    rows = entries.join(calendar_inputs(spark, sf_dir).select("week_start", "out", "summer"), "week_start").join(units, "unit")
    rows = rows.withColumn("entries", F.col("entries") * F.exp(-2.0 * F.col("m1") * F.col("summer")))
    state = F.when(F.col("out") == 0, "session").when(F.col("summer") >= 0.95, "summer")
    change = evaluation.state_change(rows, "unit", state, "entries", "session", "summer", _MIN_WEEKS)
    survey = materialize(change.join(units, "unit").selectExpr("log_change", *(f"cast({v} as double) as {n}" for n, v in _SURVEY.items())), "survey")
    middle = survey.agg(F.count(F.lit(1)).alias("n"), (100 * (F.exp(F.percentile("log_change", 0.5)) - 1)).alias("v"))
    median = evaluation.metric_rows(middle, "survey", F.lit("stations"), {"median_summer_change_percent": F.col("v")}, F.col("n"))
    return evaluation.assembled(median, evaluation.correlations(survey, "survey", "stations", "log_change", list(_SURVEY), "corr_summer_change"))


# --- bounds and headlines


_TOWNS = {"study area": "true", "area 1": "CAST(unitid AS INT) % 5 = 1", "area 2": "CAST(unitid AS INT) % 5 = 2"}


@query(
    "a30_bound_rows",
    f"""WITH {_CALENDAR}, {A.ENROLLMENT.strip()}, y AS (SELECT year(o_orderdate) AS year, count(DISTINCT o_custkey) AS residents FROM orders GROUP BY ALL),
    w AS (SELECT year(week_start) AS year, max(min_share * residents) AS least, max(max_share * residents) AS most, any_value(residents) * 8 AS census, count(*) AS n FROM inp JOIN y ON year = year(week_start) GROUP BY ALL),
    t AS ({' UNION ALL '.join(f"SELECT '{name}, ' || fall_year AS subset, sum(total) AS total, sum(dorm_capacity) AS housing, sum(distance_only) AS home, sum(total - distance_only) AS elsewhere, count(*) AS n FROM enr WHERE {condition} GROUP BY fall_year" for name, condition in _TOWNS.items())})
    SELECT 'students_away_bounds' AS "check", 'study area, ' || year AS subset, unnest(['max_students_away', 'max_students_away_percent_of_census', 'min_students_away', 'min_students_away_percent_of_census']) AS metric, unnest([most, 100 * most / census, least, 100 * least / census])::DOUBLE AS value, n FROM w
    UNION ALL SELECT 'living_arrangements', subset, unnest(['college_students', 'in_university_housing', 'with_parents', 'elsewhere']), unnest([total, housing, home, elsewhere])::DOUBLE, n FROM t
    UNION ALL SELECT 'students_away_bounds', subset, unnest(['min_share_away', 'max_share_away']), unnest([housing / total, 1 - home / total])::DOUBLE, n FROM t
    UNION ALL SELECT 'university_housing', subset, unnest(['housing_beds', 'housing_beds_share_of_resident_students']), unnest([housing, housing / total])::DOUBLE, n FROM t WHERE subset LIKE 'study area%'""",
)
def a30_bound_rows(spark, sf_dir):
    """Bounds on students away, living arrangements by area and housing as metric rows of several sources."""
    residents = A.table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count_distinct("o_custkey").alias("residents"))
    weekly = calendar_inputs(spark, sf_dir).withColumn("year", F.year("week_start")).join(residents, "year")
    bounds = weekly.groupBy("year").agg(F.max(F.col("min_share") * F.col("residents")).alias("least"), F.max(F.col("max_share") * F.col("residents")).alias("most"), (F.first("residents") * 8).alias("census"), F.count(F.lit(1)).alias("n"))
    enrolled = materialize(A.enrollment(spark, sf_dir), "enrolled")
    towns = None
    for name, condition in _TOWNS.items():
        part = enrolled.filter(condition).groupBy(F.concat(F.lit(f"{name}, "), F.col("fall_year")).alias("subset")).agg(
            F.sum("total").alias("total"), F.sum("dorm_capacity").alias("housing"), F.sum("distance_only").alias("home"), F.sum(F.col("total") - F.col("distance_only")).alias("elsewhere"), F.count(F.lit(1)).alias("n")
        )
        towns = part if towns is None else towns.unionByName(part)
    n, subset = F.col("n"), F.col("subset")
    census = {f"{k}_students_away{end}": (100 * F.col(c) / F.col("census") if end else F.col(c)) for k, c in (("max", "most"), ("min", "least")) for end in ("", "_percent_of_census")}
    share = F.col("housing") / F.col("total")
    return evaluation.assembled(
        evaluation.metric_rows(bounds, "students_away_bounds", F.concat(F.lit("study area, "), F.col("year")), census, n),
        evaluation.metric_rows(towns, "living_arrangements", subset, {"college_students": F.col("total"), "in_university_housing": F.col("housing"), "with_parents": F.col("home"), "elsewhere": F.col("elsewhere")}, n),
        evaluation.metric_rows(towns, "students_away_bounds", subset, {"min_share_away": share, "max_share_away": 1 - F.col("home") / F.col("total")}, n),
        evaluation.metric_rows(towns.filter("subset like 'study area%'"), "university_housing", subset, {"housing_beds": F.col("housing"), "housing_beds_share_of_resident_students": share}, n),
    )


@query(
    "d7_dips_and_streets",
    f"""SELECT 'break dips' AS "check", kind AS subset, unnest(['median_change_percent', 'share_with_a_drop']) AS metric, unnest([100 * median_change, share_down]) AS value, n FROM ({oracle_of('a28_break_summary')})
    UNION ALL SELECT 'streets', zone::VARCHAR, 'june_to_september_percent', percent, n FROM ({oracle_of('a29_street_rows')})""",
)
def d7_dips_and_streets(spark, sf_dir):
    """Dips in breaks and changes on streets in one long form, with the rows each rests on."""
    dips, streets, n = a28_break_summary(spark, sf_dir), a29_street_rows(spark, sf_dir), F.col("n")
    return evaluation.assembled(
        evaluation.metric_rows(dips, "break dips", F.col("kind"), {"median_change_percent": 100 * F.col("median_change"), "share_with_a_drop": F.col("share_down")}, n),
        evaluation.metric_rows(streets, "streets", F.col("zone"), {"june_to_september_percent": F.col("percent")}, n),
    )


@query(
    "d13_headlines",
    f"""SELECT (SELECT median(r) FROM ({oracle_of('a27_within_year_corr')})) AS median_correlation, (SELECT sum(share_down * n) / sum(n) FROM ({oracle_of('a28_break_summary')})) AS share_of_breaks_down,
    (SELECT median(percent) FROM ({oracle_of('a29_street_rows')})) AS median_street_change, b.* FROM (SELECT max(value) FILTER (metric = 'max_students_away') AS most_away, max(value) FILTER (metric = 'min_students_away') AS least_away,
    avg(value) FILTER (metric = 'housing_beds_share_of_resident_students') AS housing_share FROM ({oracle_of('a30_bound_rows')})) b""",
)
def d13_headlines(spark, sf_dir):
    """Headline numbers as one row, each from its own operator: correlation, dips, streets, bounds, housing."""
    bounds = a30_bound_rows(spark, sf_dir)

    def of(name):
        return F.when(F.col("metric") == name, F.col("value"))

    parts = [
        a27_within_year_corr(spark, sf_dir).agg(F.percentile("r", 0.5).alias("median_correlation")),
        a28_break_summary(spark, sf_dir).agg((F.sum(F.col("share_down") * F.col("n")) / F.sum("n")).alias("share_of_breaks_down")),
        a29_street_rows(spark, sf_dir).agg(F.percentile("percent", 0.5).alias("median_street_change")),
        bounds.agg(F.max(of("max_students_away")).alias("most_away"), F.max(of("min_students_away")).alias("least_away"), F.avg(of("housing_beds_share_of_resident_students")).alias("housing_share")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)  # one row each
    return out
