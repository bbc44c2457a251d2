"""Queries of the chain from station weeks to the share away: slopes, two-equation fits, and what is read from them.

Station weeks are suppliers' shipped quantities, to whose logarithms an effect of
a calendar is added: weekdays move with all customers out of session, weekends
with 0.8 of those in summer and 0.4 of those on other breaks.  So the fits have
something to find, in noise.
"""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ebbtide.operators import leaving, panel, timeline
from ebbtide.operators.whatif import away
from ebbtide.plans import adapters as A
from ebbtide.plans.registry import query
from ebbtide.plans.scratch import materialize

_K, _K2, _SUMMER, _BREAKS = -30.0, -0.5, 0.8, 0.4
_PERIODS = (("early", 1995, 1997), ("late", 1998, 2001))
_IN_SUMMER = "m IN (6, 7) OR (m = 8 AND n % 2 = 0) OR (m = 5 AND n % 3 = 0)"
_ON_BREAK = "(m = 1 AND n % 2 = 1) OR (m = 12 AND d >= 15) OR (m = 11 AND d >= 20 AND n % 4 <> 0) OR (m = 3 AND (d + n) % 4 = 0)"
#: Plain text that both engines read.
_INPUTS = (
    "out", "summer", "breaks", "CASE WHEN m = 11 THEN breaks ELSE 0 END AS thanksgiving", "CASE WHEN m IN (12, 1) THEN breaks ELSE 0 END AS winter",
    "CASE WHEN m = 3 THEN breaks ELSE 0 END AS spring", "min_share", "max_share",
)
_MEASURES = {"first": "m1", "second": "m2"}


def calendar_inputs(spark, sf_dir):
    """Shares of customers out of session each week, by nation: summer, breaks by kind, and the least and most who leave."""
    nations = A.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    weeks = A.table(spark, sf_dir, "lineitem").select(timeline.week_of(F.to_date("l_shipdate")).alias("week_start")).distinct()
    # a row per week and nation
    states = weeks.selectExpr("week_start", "month(week_start) AS m", "day(week_start) AS d").crossJoin(nations).selectExpr("*", f"{_IN_SUMMER} AS s", f"{_ON_BREAK} AS b")

    def share(condition):
        return F.sum(F.when(F.expr(condition), F.col("w")).otherwise(0.0)) / F.sum("w")

    shares = states.groupBy("week_start", "m").agg(
        share("s OR b").alias("out"), share("s").alias("summer"), share("b AND NOT s").alias("breaks"), share("(s OR b) AND n % 5 = 0").alias("min_share"), share("(s OR b) AND n % 7 <> 0").alias("max_share")
    )
    return shares.selectExpr("week_start", *_INPUTS)


_CALENDAR = f"""nat AS (SELECT c_nationkey AS n, count(*)::DOUBLE AS w FROM customer GROUP BY ALL), wks AS (SELECT DISTINCT date_trunc('week', l_shipdate)::DATE AS week_start FROM lineitem),
    st AS (SELECT *, {_IN_SUMMER} AS s, {_ON_BREAK} AS b FROM (SELECT week_start, month(week_start) AS m, day(week_start) AS d, n, w FROM wks, nat)),
    sh AS (SELECT week_start, m, sum(w) FILTER (s OR b) AS o, coalesce(sum(w) FILTER (s), 0) / sum(w) AS summer, coalesce(sum(w) FILTER (b AND NOT s), 0) / sum(w) AS breaks, coalesce(sum(w) FILTER (s OR b), 0) / sum(w) AS out,
        coalesce(sum(w) FILTER ((s OR b) AND n % 5 = 0), 0) / sum(w) AS min_share, coalesce(sum(w) FILTER ((s OR b) AND n % 7 <> 0), 0) / sum(w) AS max_share FROM st GROUP BY ALL),
    inp AS (SELECT week_start, {', '.join(_INPUTS)} FROM sh)"""


def station_weeks(spark, sf_dir):
    """unit, week_start, year, both measures, and the logarithms of weekday and weekend entries of weeks that have both."""
    supplier = A.table(spark, sf_dir, "supplier")
    span = supplier.agg(F.min("s_acctbal").alias("lo"), F.max("s_acctbal").alias("hi"))
    measure = 0.07 * (F.col("s_acctbal") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    units = supplier.crossJoin(F.broadcast(span)).select(F.col("s_suppkey").alias("unit"), measure.alias("m1")).withColumn("m2", 0.5 * F.col("m1") + F.col("unit") % 7 / 200.0)  # one row
    day = F.to_date("l_shipdate")
    weekend = timeline.is_weekend(day)
    entries = A.table(spark, sf_dir, "lineitem").groupBy(timeline.week_of(day).alias("week_start"), F.col("l_suppkey").alias("unit")).agg(
        F.sum(F.when(~weekend, F.col("l_quantity"))).alias("wd"), F.sum(F.when(weekend, F.col("l_quantity"))).alias("we")
    )
    rows = entries.filter("wd > 0 AND we > 0").join(units, "unit").join(calendar_inputs(spark, sf_dir).select("week_start", "out", "summer", "breaks"), "week_start")
    return rows.select(
        "unit", "week_start", F.year("week_start").alias("year"), "m1", "m2",
        (F.ln("wd") + _K * F.col("m1") * F.col("out")).alias("weekday"),
        (F.ln("we") + _K * F.col("m1") * (_SUMMER * F.col("summer") + _BREAKS * F.col("breaks"))).alias("weekend"),
    )


def second_station_weeks(spark, sf_dir):
    """Counts of shipments instead of quantities, of stations with a median of at least two a week in the year; the measure is 1 near a campus, else 0."""
    day = F.to_date("l_shipdate")
    weekend = timeline.is_weekend(day)
    counts = A.table(spark, sf_dir, "lineitem").groupBy(timeline.week_of(day).alias("week_start"), F.col("l_suppkey").alias("unit")).agg(F.count_if(~weekend).alias("wd"), F.count_if(weekend).alias("we"))
    counts = materialize(counts.withColumn("year", F.year("week_start")), "counts")
    busy = counts.groupBy("unit", "year").agg(F.percentile(F.col("wd") + F.col("we"), 0.5).alias("median")).filter("median >= 2").drop("median")
    rows = counts.filter("wd > 0 AND we > 0").join(busy, ["unit", "year"]).join(calendar_inputs(spark, sf_dir).select("week_start", "out", "summer", "breaks"), "week_start")
    rows = rows.withColumn("m1", (F.col("unit") % 3 == 0).cast("double"))
    return rows.select(
        "unit", "week_start", "year", "m1", (F.ln("wd") + _K2 * F.col("m1") * F.col("out")).alias("weekday"),
        (F.ln("we") + _K2 * F.col("m1") * (_SUMMER * F.col("summer") + _BREAKS * F.col("breaks"))).alias("weekend"),
    )


def slopes_of(spark, sf_dir, periods=_PERIODS, stations=station_weeks, measures=None):
    """Slopes by period, measure and week; a period is a run of years."""
    spans = spark.createDataFrame(list(periods), "period string, low int, high int")
    rows = stations(spark, sf_dir).join(spans, F.col("year").between(F.col("low"), F.col("high"))).drop("low", "high")
    return panel.weekly_slopes(rows, measures or _MEASURES, list(leaving.DAYS), "unit", "year", "week_start", ["period"])


def weekly_table(spark, sf_dir, periods=_PERIODS, stations=station_weeks, measures=None):
    """Slopes and inputs as deviations, by period and measure."""
    joined = slopes_of(spark, sf_dir, periods, stations, measures).filter("weekday IS NOT NULL").join(calendar_inputs(spark, sf_dir), "week_start").withColumn("out_level", F.col("out"))
    return materialize(leaving.deviations(joined, ["period", "measure"]), "weekly")


_UNITS_SQL = """su AS (SELECT unit, m1, 0.5 * m1 + (unit % 7) / 200.0::DOUBLE AS m2 FROM (SELECT s_suppkey AS unit, 0.07::DOUBLE * (s_acctbal - min(s_acctbal) OVER ()) / (max(s_acctbal) OVER () - min(s_acctbal) OVER ()) AS m1 FROM supplier)),
    en AS (SELECT date_trunc('week', l_shipdate)::DATE AS week_start, l_suppkey AS unit, sum(l_quantity) FILTER (isodow(l_shipdate) < 6) AS wd, sum(l_quantity) FILTER (isodow(l_shipdate) >= 6) AS we FROM lineitem GROUP BY ALL)"""
_SECOND_SQL = """ct AS (SELECT date_trunc('week', l_shipdate)::DATE AS week_start, l_suppkey AS unit, count(*) FILTER (isodow(l_shipdate) < 6) AS wd, count(*) FILTER (isodow(l_shipdate) >= 6) AS we FROM lineitem GROUP BY ALL),
    en AS (SELECT * FROM ct QUALIFY median(wd + we) OVER (PARTITION BY unit, year(week_start)) >= 2), su AS (SELECT s_suppkey AS unit, (s_suppkey % 3 = 0)::INT::DOUBLE AS m1, 0::DOUBLE AS m2 FROM supplier)"""


def _slopes_sql(periods=_PERIODS, units=_UNITS_SQL, k=_K, measures=tuple(_MEASURES.items()), rounds=60):
    """The same slopes; levels are removed by turns, in a recursion of windows."""
    return f"""{_CALENDAR}, {units},
    sw AS (SELECT unit, week_start, year(week_start) AS yr, m1, m2, ln(wd) + {k}::DOUBLE * m1 * out AS weekday, ln(we) + {k}::DOUBLE * m1 * ({_SUMMER}::DOUBLE * summer + {_BREAKS}::DOUBLE * breaks) AS weekend FROM en JOIN su USING (unit) JOIN inp USING (week_start) WHERE wd > 0 AND we > 0),
    it AS (SELECT 0 AS k, unit, week_start, yr, m1, m2, weekday, weekend FROM sw
        UNION ALL SELECT k + 1, unit, week_start, yr, m1, m2, a - avg(a) OVER (PARTITION BY week_start), b - avg(b) OVER (PARTITION BY week_start)
        FROM (SELECT k, unit, week_start, yr, m1, m2, weekday - avg(weekday) OVER (PARTITION BY unit, yr) AS a, weekend - avg(weekend) OVER (PARTITION BY unit, yr) AS b FROM it WHERE k < {rounds})),
    ml AS (SELECT period, week_start, weekday, weekend, unnest({[m for m, _ in measures]}) AS measure, unnest([{', '.join(c for _, c in measures)}]) AS x FROM it JOIN (VALUES {', '.join(map(str, periods))}) pe(period, low, high) ON yr BETWEEN low AND high WHERE k = {rounds}),
    sl AS (SELECT period, measure, week_start, sum(x * weekday) / nullif(sum(x * x), 0) AS weekday, sum(x * weekend) / nullif(sum(x * x), 0) AS weekend FROM (SELECT * REPLACE (x - avg(x) OVER (PARTITION BY period, measure) AS x) FROM ml) GROUP BY ALL)"""


_IN = ", ".join(f"{c} - avg({c}) OVER w AS {c}" for c in leaving.INPUTS)


def _weekly_sql(periods=_PERIODS, **stations):
    return f"""{_slopes_sql(periods, **stations)}, wt AS (SELECT period, measure, week_start, strftime(week_start, '%Y-%m') AS month, year(week_start) AS yr, weekday, weekend, out AS out_level, {_IN}
        FROM sl JOIN inp USING (week_start) WHERE weekday IS NOT NULL WINDOW w AS (PARTITION BY period, measure, year(week_start)))"""


def _designs_sql(versions=leaving.VERSIONS):
    """``de``: both rows of every week's design for each version, with the observed slope last."""
    out = []
    for v in versions:
        parts = leaving.ESTIMATED.get(v, ())
        given = leaving.GIVEN.get(v) or "0"
        key = f"SELECT period, measure, '{v}' AS version, week_start, month, yr"
        out.append(f"{key}, 'weekday' AS day, [1, 0, out, {''.join('0, ' for _ in parts)}weekday]::DOUBLE[] AS x FROM wt")
        out.append(f"{key}, 'weekend', [0, 1, {given}, {''.join(f'{p}, ' for p in parts)}weekend]::DOUBLE[] FROM wt")
    return f"de AS ({' UNION ALL '.join(out)})"


def _products_sql(name, source, keys, weight="1"):
    """Sums of products of the design's columns, one row per entry of the normal equations."""
    pairs = "SELECT *, unnest(range(1, len(x) + 1)) AS j"
    return f"{name} AS (SELECT {keys}, i, j, sum({weight} * x[i] * x[j]) AS s FROM ({pairs} FROM (SELECT *, unnest(range(1, len(x))) AS i FROM {source})) GROUP BY ALL)"


def _solved_sql(name, source, keys):
    """Gauss-Jordan elimination of every system in ``source`` (keys, i, j, s) at once, a pivot a round."""
    pivot = "m[k + 1][k + 1]"
    row = f"CASE WHEN i = k + 1 THEN list_transform(m[i], lambda v: v / {pivot}) ELSE list_transform(range(1, len(m[i]) + 1), lambda j: m[i][j] - m[i][k + 1] / {pivot} * m[k + 1][j]) END"
    return f"""{name}_m AS (SELECT {keys}, list(r ORDER BY i) AS m FROM (SELECT {keys}, i, list(s ORDER BY j) AS r FROM {source} GROUP BY ALL) GROUP BY ALL),
    {name}_g AS (SELECT {keys}, 0 AS k, m FROM {name}_m UNION ALL SELECT {keys}, k + 1, list_transform(range(1, len(m) + 1), lambda i: {row}) FROM {name}_g WHERE k < len(m)),
    {name} AS (SELECT {keys}, list_transform(m, lambda r: r[-1]) AS b FROM {name}_g WHERE k = len(m))"""


def _drawn(blocks, seed=1):
    from ebbtide.plans.q_models import drawn

    return drawn(blocks, seed)


_CELL = "period, measure"
_METRICS = {v: ("k", *leaving.ESTIMATED.get(v, ())) for v in leaving.VERSIONS}


def _parameters_sql(source):
    """k and shares of each version as rows (version, metric, value)."""
    parts = []
    for v, names in _METRICS.items():
        values = ["b[3]", *(f"b[{4 + k}] / b[3]" for k in range(len(names) - 1))]
        parts.append(f"SELECT {_CELL}, version, id, unnest({list(names)}) AS metric, unnest([{', '.join(values)}]) AS value FROM {source} WHERE version = '{v}'")
    return " UNION ALL ".join(parts)


def _grid_sql(periods, held_out, **stations):
    """Fits, draws and held-out months of every cell, from sums of products per month."""
    sums = f"""{_weekly_sql(periods, **stations)}, {_designs_sql()}, {_products_sql('pm', 'de', f'{_CELL}, version, month')},
    bl AS (SELECT {_CELL}, month, row_number() OVER (PARTITION BY {_CELL} ORDER BY month) - 1 AS block, count(*) OVER (PARTITION BY {_CELL}) AS nb FROM (SELECT DISTINCT {_CELL}, month FROM wt)),
    dr AS (SELECT {_CELL}, draw, block, count(*) AS times FROM (SELECT {_CELL}, draw, {_drawn('nb')} AS block FROM (SELECT DISTINCT {_CELL}, nb, unnest(range(0, nb)) AS i FROM (SELECT DISTINCT {_CELL}, nb FROM bl)), (SELECT unnest(range(0, {leaving.DRAWS})) AS draw)) GROUP BY ALL),
    al AS (SELECT {_CELL}, version, 'all' AS id, i, j, sum(s) AS s FROM pm GROUP BY ALL)"""
    systems = f"SELECT * FROM al UNION ALL SELECT pm.period, pm.measure, version, draw::VARCHAR, i, j, sum(times * s) FROM pm JOIN bl USING ({_CELL}, month) JOIN dr USING ({_CELL}, block) GROUP BY ALL"
    if held_out:
        sums += f""", he AS (SELECT {_CELL}, month AS held, min(week_start) - 7 AS lo, max(week_start) + 7 AS hi FROM wt GROUP BY ALL),
        nr AS (SELECT de.*, held FROM de JOIN he ON he.period = de.period AND he.measure = de.measure AND week_start BETWEEN lo AND hi), {_products_sql('pn', 'nr', f'{_CELL}, version, held')}"""
        systems += " UNION ALL SELECT pn.period, pn.measure, pn.version, held, i, j, al.s - pn.s FROM pn JOIN al USING (period, measure, version, i, j)"
    return f"{sums}, sy AS ({systems}), {_solved_sql('so', 'sy', f'{_CELL}, version, id')}, pa AS ({_parameters_sql('so')})"


_INTERVALS = f"""e.period, e.measure, e.version, e.metric, e.value AS estimate, low, high FROM (SELECT * FROM pa WHERE id = 'all') e
    JOIN (SELECT {_CELL}, version, metric, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high FROM pa WHERE id <> 'all' AND id NOT LIKE '%-%' GROUP BY ALL) q USING ({_CELL}, version, metric)"""
_WHOLE = (("all", 1995, 2001),)


@query("m2_weekly_slopes", f"WITH RECURSIVE {_slopes_sql()} SELECT period, measure, week_start, weekday, weekend FROM sl")
def m2_weekly_slopes(spark, sf_dir):
    """Slopes of log entries on two measures after station-year and week levels, weekdays and weekends (M2)."""
    return slopes_of(spark, sf_dir)


@query(
    "m10_stacked_shares",
    f"WITH RECURSIVE {_grid_sql(_WHOLE, False)} SELECT version, metric, estimate, low, high FROM (SELECT {_INTERVALS}) WHERE measure = 'first'",
)
def m10_stacked_shares(spark, sf_dir):
    """k and shares away of all six versions of the two equations, with intervals over 1,000 draws of months."""
    weeks = weekly_table(spark, sf_dir, _WHOLE).filter("measure = 'first'")
    found = leaving.fit_grid(weeks, ["period", "measure"])
    return found.filter("version <> 'weekly slopes' AND metric NOT LIKE '%rmse%'").select("version", "metric", "estimate", "low", "high")


@query(
    "m20_fit_grid",
    f"""WITH RECURSIVE {_grid_sql(_PERIODS, True)}, er AS (SELECT de.period, de.measure, de.version, sqrt(avg((x[-1] - list_sum(list_transform(range(1, len(b) + 1), lambda i: b[i] * x[i]))) ** 2)) AS rmse
        FROM de JOIN so ON so.period = de.period AND so.measure = de.measure AND so.version = de.version AND so.id = de.month WHERE day = 'weekend' GROUP BY ALL),
    co AS (SELECT {_CELL}, unnest(['correlation_weekday', 'correlation_weekend']) AS metric, unnest([corr(weekday, out_level), corr(weekend, out_level)]) AS r, NULL::DOUBLE AS none FROM wt GROUP BY {_CELL}),
    ro AS (SELECT {_INTERVALS} UNION ALL SELECT {_CELL}, 'weekly slopes', metric, r, none, none FROM co
        UNION ALL SELECT {_CELL}, version, 'held_out_rmse', rmse, NULL, NULL FROM er
        UNION ALL SELECT er.period, er.measure, er.version, 'rmse_change_percent', (er.rmse / n.rmse - 1) * 100, NULL, NULL FROM er JOIN er n ON n.period = er.period AND n.measure = er.measure AND n.version = '{leaving.VERSIONS[0]}')
    SELECT ro.*, weeks FROM ro JOIN (SELECT {_CELL}, count(*) AS weeks FROM wt GROUP BY ALL) USING ({_CELL})""",
)
def m20_fit_grid(spark, sf_dir):
    """Measure x period x version: k, shares with intervals, held-out error and its change, correlations."""
    return leaving.fit_grid(weekly_table(spark, sf_dir), ["period", "measure"])


# --- shares common to two signals

_COMBINATIONS = {"slopes": ["slopes"], "ratio": ["ratio"], "both": ["slopes", "ratio"]}


def _ratio_weeks(spark, sf_dir):
    """Logarithm of the orders of one half of the customers over those of the other, by week and kind of day, with the calendar's effect."""
    day = F.to_date("o_orderdate")
    kind = F.when(timeline.is_weekend(day), "weekend").otherwise("weekday")
    near = F.col("o_custkey") % 2 == 0
    counts = A.table(spark, sf_dir, "orders").groupBy(timeline.week_of(day).alias("week_start"), kind.alias("day")).agg(F.count_if(near).alias("a"), F.count_if(~near).alias("b")).filter("a > 0 AND b > 0")
    rows = counts.join(calendar_inputs(spark, sf_dir).select("week_start", "out", "summer", "breaks"), "week_start")
    effect = F.when(F.col("day") == "weekday", F.col("out")).otherwise(_SUMMER * F.col("summer") + _BREAKS * F.col("breaks"))
    return rows.withColumn("y", F.ln(F.col("a") / F.col("b")) + 4 * _K2 * effect)


def signal_pieces(spark, sf_dir):
    """signal, day, month, y, x1, x2 of both signals; all are deviations from the year's mean of the signal's day."""
    slopes = slopes_of(spark, sf_dir, _WHOLE).filter("measure = 'first' AND weekday IS NOT NULL").join(calendar_inputs(spark, sf_dir).select("week_start", "out", "summer", "breaks"), "week_start")
    both = F.explode(F.array(*(F.struct(F.lit(d).alias("day"), F.col(d).alias("y")) for d in leaving.DAYS))).alias("v")
    slopes = slopes.select(F.lit("slopes").alias("signal"), "week_start", "out", "summer", "breaks", both).select("signal", "week_start", "v.day", "v.y", "out", "summer", "breaks")
    rows = slopes.unionByName(_ratio_weeks(spark, sf_dir).select(F.lit("ratio").alias("signal"), "week_start", "day", "y", "out", "summer", "breaks"))
    year = W.partitionBy("signal", "day", F.year("week_start"))
    weekday = F.col("day") == "weekday"
    inputs = rows.withColumn("x1", F.when(weekday, F.col("out")).otherwise(F.col("summer"))).withColumn("x2", F.when(weekday, 0.0).otherwise(F.col("breaks")))
    return materialize(inputs.select("signal", "day", F.date_format("week_start", "yyyy-MM").alias("month"), *((F.col(c) - F.avg(c).over(year)).alias(c) for c in ("y", "x1", "x2"))), "pieces")


_PIECES_SQL = f"""ra AS (SELECT week_start, day, ln(a / b::DOUBLE) + {4 * _K2}::DOUBLE * CASE day WHEN 'weekday' THEN out ELSE {_SUMMER}::DOUBLE * summer + {_BREAKS}::DOUBLE * breaks END AS y, out, summer, breaks
        FROM (SELECT date_trunc('week', o_orderdate)::DATE AS week_start, CASE WHEN isodow(o_orderdate) >= 6 THEN 'weekend' ELSE 'weekday' END AS day, count(*) FILTER (o_custkey % 2 = 0) AS a, count(*) FILTER (o_custkey % 2 <> 0) AS b FROM orders GROUP BY ALL) JOIN inp USING (week_start) WHERE a > 0 AND b > 0),
    bo AS (SELECT 'ratio' AS signal, week_start, day, y, out, summer, breaks FROM ra UNION ALL
        SELECT 'slopes', week_start, unnest(['weekday', 'weekend']), unnest([weekday, weekend]), out, summer, breaks FROM sl JOIN inp USING (week_start) WHERE measure = 'first' AND weekday IS NOT NULL),
    pc AS (SELECT signal, day, strftime(week_start, '%Y-%m') AS month, y - avg(y) OVER w AS y, x1 - avg(x1) OVER w AS x1, x2 - avg(x2) OVER w AS x2
        FROM (SELECT *, CASE day WHEN 'weekday' THEN out ELSE summer END AS x1, CASE day WHEN 'weekday' THEN 0 ELSE breaks END AS x2 FROM bo) WINDOW w AS (PARTITION BY signal, day, year(week_start)))"""


def _joint_sql(draws, rounds):
    """Both steps of the bilinear fit for all combinations and draws at once: k and shares are solved for by turns."""
    sums = {"n": "1", "y": "y", "yy": "y * y", "x1": "x1", "x2": "x2", "p1": "x1 * y", "p2": "x2 * y", "q11": "x1 * x1", "q12": "x1 * x2", "q22": "x2 * x2"}
    monthly = ", ".join(f"sum({v}) FILTER (day = '{day}') AS {day[4]}_{c}" for day in leaving.DAYS for c, v in sums.items())  # d_ weekdays, e_ weekends
    columns = [f"{day[4]}_{c}" for day in leaving.DAYS for c in sums]
    labels = ", ".join(f"('{label}', '{s}')" for label, names in _COMBINATIONS.items() for s in names)

    def step(name, start, weights):
        k = "(wd * d_p1 + we * (s1 * e_p1 + s2 * e_p2)) / (wd * d_q11 + we * (s1 * s1 * e_q11 + 2 * s1 * s2 * e_q12 + s2 * s2 * e_q22))"
        turn = f"SELECT *, {k} AS kk FROM (SELECT v.label, v.draw, v.r, v.s1, v.s2, t.* EXCLUDE (label, draw) FROM {name}_r v JOIN {weights} t ON t.label = v.label AND t.draw = v.draw WHERE v.r < {rounds})"
        det = "(sum(we * kk * kk * e_q11) * sum(we * kk * kk * e_q22) - sum(we * kk * kk * e_q12) ** 2)"
        s1 = f"(sum(we * kk * kk * e_q22) * sum(we * kk * e_p1) - sum(we * kk * kk * e_q12) * sum(we * kk * e_p2)) / {det}"
        s2 = f"(sum(we * kk * kk * e_q11) * sum(we * kk * e_p2) - sum(we * kk * kk * e_q12) * sum(we * kk * e_p1)) / {det}"
        return f"""{name}_r AS ({start} UNION ALL SELECT label, draw, r + 1, {s1}, {s2} FROM ({turn}) GROUP BY label, draw, r),
        {name} AS (SELECT t.*, s1, s2, {k} AS kk FROM (SELECT label, draw, s1, s2 FROM {name}_r WHERE r = {rounds}) v JOIN {weights} t USING (label, draw))"""

    def noise(d):
        left = f"({d}_yy - 2 * kk * {d}_l + kk * kk * {d}_s)"
        return f"1 / greatest({left} / {d}_n - (({d}_y - kk * {d}_m) / {d}_n) ** 2, 1e-300)"

    inner = "*, d_p1 AS d_l, d_q11 AS d_s, d_x1 AS d_m, s1 * e_p1 + s2 * e_p2 AS e_l, s1 * s1 * e_q11 + 2 * s1 * s2 * e_q12 + s2 * s2 * e_q22 AS e_s, s1 * e_x1 + s2 * e_x2 AS e_m"
    return f"""{_slopes_sql(_WHOLE)}, {_PIECES_SQL}, la(label, signal) AS (VALUES {labels}),
    ms AS (SELECT signal, month, {monthly} FROM pc GROUP BY ALL),
    jb AS (SELECT label, month, row_number() OVER (PARTITION BY label ORDER BY month) - 1 AS block, count(*) OVER (PARTITION BY label) AS nb FROM (SELECT DISTINCT label, month FROM la JOIN ms USING (signal))),
    jw AS (SELECT label, draw, block, count(*) AS times FROM (SELECT label, draw, {_drawn('nb')} AS block FROM (SELECT label, nb, unnest(range(0, nb)) AS i FROM (SELECT DISTINCT label, nb FROM jb)), (SELECT unnest(range(0, {draws})) AS draw)) GROUP BY ALL
        UNION ALL SELECT label, -1, block, 1 FROM jb),
    j0 AS (SELECT label, draw, signal, {', '.join(f'coalesce(sum(times * {c}), 0) AS {c}' for c in columns)} FROM la JOIN ms USING (signal) JOIN jb USING (label, month) JOIN jw USING (label, block) GROUP BY ALL),
    j1 AS (SELECT *, 1::DOUBLE AS wd, 1::DOUBLE AS we FROM j0),
    {step('f1', 'SELECT DISTINCT label, draw, 0 AS r, 0.8::DOUBLE AS s1, 0.8::DOUBLE AS s2 FROM j1', 'j1')},
    j2 AS (SELECT label, draw, signal, {', '.join(columns)}, {noise('d')} AS wd, {noise('e')} AS we FROM (SELECT {inner} FROM f1)),
    {step('f2', 'SELECT DISTINCT label, draw, 0 AS r, s1, s2 FROM f1', 'j2')},
    jv AS (SELECT DISTINCT label, draw, unnest(['share_summer', 'share_breaks']) AS parameter, unnest([s1, s2]) AS value FROM f2 UNION ALL SELECT label, draw, 'k_' || signal, kk FROM f2)"""


@query(
    "m11_joint_shares",
    f"""WITH RECURSIVE {_joint_sql(leaving.DRAWS, 2000)} SELECT e.label AS signals, e.parameter, e.value AS estimate, quantile_cont(e.value + 1.4 * (d.value - e.value), 0.025) AS low, quantile_cont(e.value + 1.4 * (d.value - e.value), 0.975) AS high,
    (SELECT count(*) FROM pc JOIN la USING (signal) WHERE la.label = e.label) AS signal_weeks FROM jv e JOIN jv d ON d.label = e.label AND d.parameter = e.parameter AND d.draw >= 0 WHERE e.draw = -1 GROUP BY e.label, e.parameter, e.value""",
)
def m11_joint_shares(spark, sf_dir):
    """Shares away common to two signals, each with its own k, with widened intervals over 1,000 draws of months."""
    return leaving.joint_shares(signal_pieces(spark, sf_dir), _COMBINATIONS)


# --- what is read from the fits


def _main_beta(weeks):
    """Coefficients of the main version on the weeks of one cell; one row of sums leaves Spark."""
    row = leaving.product_sums(weeks, []).first()
    many = len(leaving.NUMBERS)
    return leaving.solve_version(np.array(row["sums"], float).reshape(many, many), leaving.MAIN)


_MAIN_SQL = f"so_main AS (SELECT b FROM so WHERE period = 'early' AND measure = 'first' AND version = '{leaving.MAIN}')"


def _fitted_sql(periods=_PERIODS, versions=(leaving.MAIN,)):
    """Coefficients on all weeks of each cell, without draws."""
    return f"{_weekly_sql(periods)}, {_designs_sql(versions)}, {_products_sql('al', 'de', f'{_CELL}, version')}, {_solved_sql('so', 'al', f'{_CELL}, version')}, {_MAIN_SQL}"


@query(
    "m15_size_check",
    f"""WITH RECURSIVE {_fitted_sql()}, pr AS (SELECT period, month, day, x[-1] - CASE day WHEN 'weekday' THEN b[1] ELSE b[2] END AS o, b[3] * x[3] AS p FROM de, so_main WHERE measure = 'first'),
    cl AS (SELECT period, day, month, sum(p * o) AS po, sum(p * p) AS pp, count(*) AS n FROM pr GROUP BY ALL), cb AS (SELECT *, row_number() OVER (PARTITION BY period, day ORDER BY month) - 1 AS block, count(*) OVER (PARTITION BY period, day) AS nb FROM cl),
    cd AS (SELECT period, day, draw, block, count(*) AS times FROM (SELECT period, day, draw, {_drawn('nb')} AS block FROM (SELECT period, day, nb, unnest(range(0, nb)) AS i FROM (SELECT DISTINCT period, day, nb FROM cb)), (SELECT unnest(range(0, {leaving.DRAWS})) AS draw)) GROUP BY ALL),
    ci AS (SELECT period, day, quantile_cont(size, 0.025) AS low, quantile_cont(size, 0.975) AS high FROM (SELECT period, day, draw, sum(times * po) / sum(times * pp) AS size FROM cb JOIN cd USING (period, day, block) GROUP BY ALL) GROUP BY ALL)
    SELECT period, day, sum(po) / sum(pp) AS size, low, high, sum(n)::BIGINT AS weeks FROM cl JOIN ci USING (period, day) GROUP BY ALL""",
)
def m15_size_check(spark, sf_dir):
    """Size of the observed change against the model's, fitted on the early years, with intervals over 1,000 draws of months."""
    weeks = weekly_table(spark, sf_dir).filter("measure = 'first'")
    beta = _main_beta(weeks.filter("period = 'early'"))
    return leaving.size_check(weeks, beta, ["period"]).select("period", "day", "size", "low", "high", "weeks")


_SETS = {
    "as recorded": {c: c for c in leaving.INPUTS},
    "nobody leaves": {c: "0" for c in leaving.INPUTS},
    "summer only": {c: {"out": "summer", "summer": "summer", "max_share": "CASE WHEN out > 0 THEN max_share * summer / out ELSE 0 END"}.get(c, "0") for c in leaving.INPUTS},
}


@query(
    "m16_input_sets",
    f"""WITH RECURSIVE {_fitted_sql()}, se AS ({' UNION ALL '.join(f"SELECT '{name}' AS inputs, week_start, ({v['out']})::DOUBLE AS o, ({v['max_share']})::DOUBLE AS a FROM inp" for name, v in _SETS.items())}),
    ob AS (SELECT week_start, inputs, year(week_start) AS year, weekday, weekend, o - avg(o) OVER w AS o, a - avg(a) OVER w AS a FROM sl JOIN se USING (week_start) WHERE period = 'late' AND measure = 'first' AND weekday IS NOT NULL WINDOW w AS (PARTITION BY inputs, year(week_start)))
    SELECT year, inputs, 'weekday' AS day, sqrt(avg((weekday - b[1] - b[3] * o) ** 2)) AS rmse, count(*) AS weeks FROM ob, so_main GROUP BY ALL UNION ALL
    SELECT year, inputs, 'weekend', sqrt(avg((weekend - b[2] - b[3] * a) ** 2)), count(*) FROM ob, so_main GROUP BY ALL""",
)
def m16_input_sets(spark, sf_dir):
    """RMSE of later years' slopes predicted from three sets of inputs through the fitted coefficients."""
    weeks = weekly_table(spark, sf_dir).filter("measure = 'first'")
    beta = _main_beta(weeks.filter("period = 'early'"))
    inputs = calendar_inputs(spark, sf_dir)
    sets = None
    for name, columns in _SETS.items():
        part = inputs.selectExpr(f"'{name}' AS inputs", "week_start", *(f"CAST({v} AS DOUBLE) AS {c}" for c, v in columns.items()))
        sets = part if sets is None else sets.unionByName(part)
    return leaving.input_set_errors(weeks.filter("period = 'late'").select("week_start", "weekday", "weekend"), sets, beta)


_FACTOR = "(count(*) FILTER (l_partkey % 5 = 0 AND isodow(l_shipdate) >= 6) / count(*) FILTER (isodow(l_shipdate) >= 6)) / (count(*) FILTER (l_partkey % 5 = 0 AND isodow(l_shipdate) < 6) / count(*) FILTER (isodow(l_shipdate) < 6))"


@query(
    "m17_read_off",
    f"""WITH RECURSIVE {_joint_sql(0, 2000)}, wt AS (SELECT period, measure, week_start, strftime(week_start, '%Y-%m') AS month, year(week_start) AS yr, weekday, weekend, {_IN} FROM sl JOIN inp USING (week_start) WHERE weekday IS NOT NULL WINDOW w AS (PARTITION BY period, measure, year(week_start))),
    {_designs_sql((leaving.MAIN,))}, {_products_sql('al', 'de', f'{_CELL}, version')}, {_solved_sql('so', 'al', f'{_CELL}, version')},
    fa AS (SELECT {_FACTOR} AS factor FROM lineitem), js AS (SELECT max(value) FILTER (parameter = 'share_summer') AS s, max(value) FILTER (parameter = 'share_breaks') AS r FROM jv WHERE label = 'both' AND draw = -1),
    aw AS (SELECT week_start, weekend, least(greatest(least(greatest(s / factor, 0), 1) * inp.summer + least(greatest(r / factor, 0), 1) * inp.breaks, inp.min_share), inp.max_share) AS away FROM sl JOIN inp USING (week_start), fa, js WHERE measure = 'first' AND weekend IS NOT NULL)
    SELECT week_start, away AS share_away, (weekend - b[2]) / (b[3] * factor) + avg(away) OVER (PARTITION BY year(week_start)) AS read_off FROM aw, fa, (SELECT b FROM so WHERE measure = 'first')""",
)
def m17_read_off(spark, sf_dir):
    """Share away read from weekend slopes at the year's level, through fitted k, joint shares and a measured weekend factor."""
    weeks = weekly_table(spark, sf_dir, _WHOLE).filter("measure = 'first'")
    beta = _main_beta(weeks)
    found = {r["parameter"]: r["estimate"] for r in leaving.joint_shares(signal_pieces(spark, sf_dir), {"both": ["slopes", "ratio"]}, draws=1).collect()}
    weekend, young = timeline.is_weekend(F.to_date("l_shipdate")), F.col("l_partkey") % 5 == 0
    factor = A.table(spark, sf_dir, "lineitem").agg((F.count_if(young & weekend) / F.count_if(weekend) / (F.count_if(young & ~weekend) / F.count_if(~weekend))).alias("factor")).first()[0]
    slopes = weeks.select("week_start", "weekend").join(calendar_inputs(spark, sf_dir), "week_start")
    share = away(slopes, F.lit(found["share_summer"] / factor), F.lit(found["share_breaks"] / factor), F.lit(1.0), F.col("min_share"), F.col("max_share"))
    read = leaving.read_off(slopes.withColumn("share_away", share), "weekend", F.lit(float(beta[1])), F.lit(float(beta[2])), F.lit(factor), "share_away")
    return read.select("week_start", "share_away", "read_off")


_SPLITS = tuple(("validation", 1995, y - 1, y, y) for y in (1998, 1999, 2000)) + (("long horizon", 1995, 1996, 1998, 2000), ("test", 1998, 2000, 2001, 2001))
_SECOND = {"units": _SECOND_SQL, "k": _K2, "measures": (("second signal", "m1"),)}


def _forward_sql(**stations):
    keys = "measure, evaluation, train_from, train_to, test_from, test_to"
    shares = "CASE version " + " ".join(f"WHEN '{v}' THEN [{', '.join(f'b[{4 + k}] / b[3]' for k in range(len(p)))}]" for v, p in leaving.ESTIMATED.items()) + " END"
    return f"""WITH RECURSIVE {_weekly_sql(_WHOLE, **stations)}, {_designs_sql()}, sp(evaluation, train_from, train_to, test_from, test_to) AS (VALUES {', '.join(map(str, _SPLITS))}),
    ft AS (SELECT * FROM de JOIN sp ON yr BETWEEN train_from AND train_to), {_products_sql('fs', 'ft', f'{keys}, version')}, {_solved_sql('fo', 'fs', f'{keys}, version')},
    sc AS (SELECT fo.measure, evaluation, train_from, train_to, test_from, test_to, fo.version, sqrt(avg((x[-1] - list_sum(list_transform(range(1, len(b) + 1), lambda i: b[i] * x[i]))) ** 2)) AS rmse, count(*) AS weeks, any_value(b) AS b
        FROM fo JOIN de ON de.measure = fo.measure AND de.version = fo.version AND yr BETWEEN test_from AND test_to WHERE day = 'weekend' GROUP BY ALL)
    SELECT {keys}, version, rmse, weeks, 100 * (rmse / max(rmse) FILTER (version = '{leaving.VERSIONS[0]}') OVER (PARTITION BY {keys}) - 1) AS change_percent, {shares} AS shares, b[3] AS k FROM sc"""


def _forward(weeks, spark):
    splits = spark.createDataFrame(list(_SPLITS), "evaluation string, train_from int, train_to int, test_from int, test_to int")
    return leaving.forward_scores(weeks, splits, ["measure"])


@query("l2_forward_versions", _forward_sql(measures=(("first", "m1"),)))
def l2_forward_versions(spark, sf_dir):
    """Every version on each year from the years before it, on a long horizon and on a test year (L2, L3)."""
    return _forward(weekly_table(spark, sf_dir, _WHOLE, measures={"first": "m1"}).drop("period"), spark)


@query("m18_second_signal", _forward_sql(**_SECOND))
def m18_second_signal(spark, sf_dir):
    """Forward scores and learnt shares of every version on the second signal."""
    return _forward(weekly_table(spark, sf_dir, _WHOLE, second_station_weeks, {"second signal": "m1"}).drop("period"), spark)


@query(
    "m18_second_shares",
    f"""WITH RECURSIVE {_grid_sql(_PERIODS, False, **_SECOND)}, rr AS (SELECT {_INTERVALS}), co AS (SELECT period, unnest(['correlation_weekday', 'correlation_weekend']) AS metric, unnest([corr(weekday, out_level), corr(weekend, out_level)]) AS r FROM wt GROUP BY period)
    SELECT period, version, metric, estimate, low, high FROM rr WHERE version = 'summer and breaks' UNION ALL SELECT period, 'weekly slopes', metric, r, NULL, NULL FROM co""",
)
def m18_second_shares(spark, sf_dir):
    """Shares of the second signal with intervals, and how closely its slopes follow the calendar, by period."""
    found = leaving.fit_grid(weekly_table(spark, sf_dir, _PERIODS, second_station_weeks, {"second signal": "m1"}), ["period", "measure"])
    return found.filter("version IN ('summer and breaks', 'weekly slopes') AND metric NOT LIKE '%rmse%'").select("period", "version", "metric", "estimate", "low", "high")
