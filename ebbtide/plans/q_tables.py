"""Queries over composite tables."""

import uuid
from datetime import date

from pyspark.sql import functions as F

from ebbtide.operators import calendars, closures, events, panel, presence, reports, tables, timeline
from ebbtide.plans import adapters as A
from ebbtide.plans.q_calendars import _FLAGS, a6_weekly_closed_days
from ebbtide.plans.q_models import _SERIES, _series
from ebbtide.plans.q_presence import REMOTE, _PRESENCE, _session
from ebbtide.plans.q_reports import _INPUTS, p16_weekly_inputs
from ebbtide.plans.registry import query
from ebbtide.plans.scratch import materialize, shared_folder


@query(
    "b1_trip_months",
    f"WITH {A.TRIPS} SELECT strftime(date, '%Y%m') AS month, sum(trips)::BIGINT AS trips, count(*) AS station_days FROM station_day GROUP BY ALL",
)
def b1_trip_months(spark, sf_dir):
    """The month pipeline's files of both layouts, written and read again."""
    folder = f"{shared_folder(spark)}/ebbtide-months-{uuid.uuid4().hex}"
    tables.write_trip_months([A.legacy_files(spark, sf_dir), A.modern_files(spark, sf_dir)], folder)
    days = spark.read.option("basePath", f"{folder}/station_day").parquet(f"{folder}/station_day")
    return days.groupBy(F.col("month").cast("string").alias("month")).agg(F.sum("trips").alias("trips"), F.count(F.lit(1)).alias("station_days"))


@query(
    "b2_load_station_days",
    f"""WITH {A.TRIPS}, extra AS (SELECT started_at::DATE AS date, start_station_id AS station_id, count(*) AS n FROM kept WHERE trip_key LIKE '%7' AND day(started_at) = 1 GROUP BY ALL)
    SELECT date, station_id, (s.trips + coalesce(e.n, 0))::BIGINT AS trips FROM station_day s LEFT JOIN extra e ON e.date = s.date AND e.station_id IS NOT DISTINCT FROM s.station_id""".replace("SELECT date, station_id, (s", "SELECT s.date, s.station_id, (s"),
)
def b2_load_station_days(spark, sf_dir):
    """Station-days with spilled trips added (B2)."""
    kept = events.clean(A.trips(spark, sf_dir))
    spill = kept.filter(F.col("trip_key").endswith("7") & (F.day("started_at") == 1))
    return tables.load_station_days(events.station_day(kept), spill).select("date", "station_id", "trips")


@query(
    "p6_directory",
    "SELECT c_custkey::VARCHAR AS unitid, c_name AS name, 1990 + c_nationkey AS year, CASE WHEN c_custkey % 3 = 2 THEN 0 WHEN c_custkey % 5 > 0 THEN c_custkey * 2 END AS dorm_capacity, c_custkey * 10 AS total, c_custkey * 10 - CASE WHEN c_custkey % 4 > 0 THEN c_custkey ELSE 0 END AS in_person FROM customer",
)
def p6_directory(spark, sf_dir):
    raw = A.table(spark, sf_dir, "customer").selectExpr(
        "cast(c_custkey as string) as unitid", "c_name as name", "1990 + c_nationkey as year", "c_custkey % 3 as room", "if(c_custkey % 5 > 0, c_custkey * 2, null) as capacity", "c_custkey * 10 as total", "if(c_custkey % 4 > 0, c_custkey, null) as distance_only"
    )
    return tables.directory(raw)


@query(
    "b5_enrollment_table",
    """WITH l AS (SELECT c_nationkey::VARCHAR AS unitid, year(o_orderdate) AS fall_year, count(*) FILTER (o_custkey % 3 = 0)::BIGINT AS undergraduate, count(*) FILTER (o_custkey % 3 = 1)::BIGINT AS graduate, count(*) FILTER (o_custkey % 3 = 2)::BIGINT AS total,
        count(*) FILTER (o_custkey % 7 = 0) AS online, max(o_custkey) AS beds FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
    SELECT unitid, fall_year, undergraduate, graduate, total, CASE WHEN fall_year % 2 = 0 THEN online ELSE 0 END AS distance_only, CASE WHEN fall_year > 1997 THEN beds END AS dorm_capacity, total - CASE WHEN fall_year % 2 = 0 THEN online ELSE 0 END AS in_person FROM l""",
)
def b5_enrollment_table(spark, sf_dir):
    """Levels pivoted, absent ones 0, with online students and beds."""
    rows = A.table(spark, sf_dir, "orders").join(A.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").cast("string").alias("unitid"), F.year("o_orderdate").alias("fall_year"), "o_custkey")
    level = F.element_at(F.array(F.lit("2"), F.lit("12"), F.lit("1")), (F.col("o_custkey") % 3 + 1).cast("int"))
    levels = rows.groupBy("unitid", "fall_year", level.alias("level")).agg(F.count(F.lit(1)).alias("students"))
    online = rows.filter("fall_year % 2 = 0").groupBy("unitid", "fall_year").agg(F.count_if(F.col("o_custkey") % 7 == 0).alias("distance_only"))
    beds = rows.filter("fall_year > 1997").groupBy("unitid", "fall_year").agg(F.max("o_custkey").alias("dorm_capacity"))
    return tables.enrollment_table(levels, online, beds)


@query(
    "g7_campus_points",
    f"""WITH {A.POINTS}, {A.ENROLLMENT}, mn AS (SELECT n_nationkey::VARCHAR AS unitid, n_name AS name FROM nation WHERE n_nationkey < 20), ex AS (SELECT (s_suppkey % 25)::VARCHAR AS unitid, s_name AS name, s_suppkey FROM supplier WHERE s_suppkey % 4 = 0),
    ty AS (SELECT unitid, median(in_person) AS typical_in_person FROM enr GROUP BY ALL), al AS (SELECT unitid, name, 'main' AS source FROM mn UNION ALL SELECT CASE WHEN unitid = '21' THEN '3' ELSE unitid END, name, 'extra' FROM ex)
    SELECT al.unitid, al.name, source, mn.name AS institution, typical_in_person, coalesce(typical_in_person >= 100, false) AS major FROM al JOIN mn USING (unitid) LEFT JOIN ty USING (unitid)""",
)
def g7_campus_points(spark, sf_dir):
    """Points of all sources with successors and a size flag."""
    main = A.campuses(spark, sf_dir).filter("cast(unitid as int) < 20").withColumnRenamed("institution", "name")
    extra = A.table(spark, sf_dir, "supplier").filter("s_suppkey % 4 = 0").selectExpr("cast(s_suppkey % 25 as string) as unitid", "s_name as name", "42.3D as lat", "-71.0D as lng")
    return tables.campus_points(main, extra, A.enrollment(spark, sf_dir), {"21": "3"}, 100).drop("lat", "lng")


@query(
    "f11_station_weeks",
    f"""WITH {_FLAGS}, c AS (SELECT date_trunc('week', date)::DATE AS week_start, stop_id, 7 - count(*) FILTER (NOT closed) AS closed_days FROM flags GROUP BY ALL), b AS (SELECT min(date) AS lo, max(date) AS hi FROM entries),
    w AS (SELECT date_trunc('week', date)::DATE AS week_start, stop_id, coalesce(sum(entries) FILTER (isodow(date) < 6), 0)::BIGINT AS weekday_entries, coalesce(sum(entries) FILTER (isodow(date) >= 6), 0)::BIGINT AS weekend_entries FROM entries GROUP BY ALL)
    SELECT w.* FROM w JOIN c USING (week_start, stop_id), b WHERE week_start >= lo AND week_start + 6 <= hi AND weekday_entries > 0 AND weekend_entries > 0 AND year(week_start + 3) BETWEEN 1996 AND 1999 AND closed_days = 0 AND stop_id <> 'place-4'""",
)
def f11_station_weeks(spark, sf_dir):
    """Station-weeks fit for the model."""
    weekly = closures.weekly_entries(A.daily_entries(spark, sf_dir), by=("stop_id",))
    stations = weekly.select("stop_id").distinct().filter("stop_id <> 'place-4'")
    return tables.station_weeks(weekly, a6_weekly_closed_days(spark, sf_dir), stations, (1996, 1999)).select("week_start", "stop_id", "weekday_entries", "weekend_entries")


@query("b17_labelled_weeks", f"WITH {_INPUTS}, {A.ENTRIES}, e AS (SELECT date_trunc('week', date)::DATE AS week_start, sum(entries)::BIGINT AS entries FROM entries GROUP BY ALL), l AS (SELECT week_start, CASE WHEN out <= 0.1 THEN 'in_session' WHEN summer >= 0.8 THEN 'summer' END AS period FROM inp) SELECT week_start, entries, period FROM e JOIN l USING (week_start) WHERE period IS NOT NULL")
def b17_labelled_weeks(spark, sf_dir):
    """Weeks in session or in summer."""
    weeks = A.daily_entries(spark, sf_dir).groupBy(timeline.week_of(F.col("date")).alias("week_start")).agg(F.sum("entries").alias("entries"))
    return tables.labelled_weeks(weeks, p16_weekly_inputs(spark, sf_dir))


@query(
    "b19_panel_units",
    f"""WITH {A.CALENDAR}, {A.ENTRIES}, act AS (SELECT date_trunc('week', date)::DATE AS week_start, stop_id AS unit, sum(entries)::BIGINT AS activity FROM entries GROUP BY ALL), ss AS (SELECT week_start, unitid, days_in_session / 7 AS session_share FROM wsess),
    ty AS (SELECT week_start, avg(session_share) AS t FROM ss GROUP BY ALL), j AS (SELECT act.*, ss.session_share AS own, t FROM act LEFT JOIN ss ON ss.week_start = act.week_start AND ss.unitid = right(unit, 1) AND right(unit, 1) <> '7' JOIN ty ON ty.week_start = act.week_start),
    r AS (SELECT week_start, unit, activity, coalesce(own, t) AS session_share, CASE WHEN own IS NULL THEN 'typical' ELSE 'own' END AS calendar, ln(activity) AS y FROM j WHERE activity > 0)
    SELECT * FROM r QUALIFY count(*) OVER (PARTITION BY unit) >= 52 AND count(*) FILTER (session_share >= 0.5) OVER (PARTITION BY unit) >= 4 AND count(*) FILTER (session_share < 0.5) OVER (PARTITION BY unit) >= 4""",
)
def b19_panel_units(spark, sf_dir):
    """Unit-weeks with own or typical calendars and enough support."""
    activity = A.daily_entries(spark, sf_dir).groupBy(timeline.week_of(F.col("date")).alias("week_start"), F.col("stop_id").alias("unit")).agg(F.sum("entries").alias("activity"))
    session = _session(spark, sf_dir).withColumn("session_share", F.col("days_in_session") / 7)
    units = activity.select("unit").distinct().filter("unit not like '%7'").withColumn("unitid", F.right("unit", F.lit(1)))
    return tables.panel_units(activity, session, units).drop("unitid")


@query(
    "b7_signals",
    """WITH a AS (SELECT date_trunc('week', o_orderdate)::DATE AS week_start, count(*)::DOUBLE AS orders FROM orders WHERE year(o_orderdate) > 1996 GROUP BY ALL), b AS (SELECT date_trunc('week', l_shipdate)::DATE AS week_start, sum(l_quantity) AS ships FROM lineitem WHERE year(l_shipdate) < 2000 GROUP BY ALL),
    j AS (SELECT coalesce(a.week_start, b.week_start) AS week_start, orders, ships FROM a FULL JOIN b ON a.week_start = b.week_start) SELECT week_start, year(week_start + 3) AS year, orders - avg(orders) OVER w AS orders, ships - avg(ships) OVER w AS ships FROM j WINDOW w AS (PARTITION BY year(week_start + 3))""",
)
def b7_signals(spark, sf_dir):
    """Signals of different spans as deviations from their years."""
    a = A.table(spark, sf_dir, "orders").filter("year(o_orderdate) > 1996").groupBy(timeline.week_of(F.to_date("o_orderdate")).alias("week_start")).agg(F.count(F.lit(1)).cast("double").alias("orders"))
    b = A.table(spark, sf_dir, "lineitem").filter("year(l_shipdate) < 2000").groupBy(timeline.week_of(F.to_date("l_shipdate")).alias("week_start")).agg(F.sum("l_quantity").alias("ships"))
    return tables.signals([a, b])


@query("b14_municipal_estimates", "SELECT n_name AS town, y AS year, (CASE y WHEN 2019 THEN n_nationkey * 10 ELSE n_regionkey * 7 END)::INT AS population FROM nation, (VALUES (2019), (2020)) v(y)")
def b14_municipal_estimates(spark, sf_dir):
    """Yearly columns as rows; other columns that look alike stay out."""
    wide = A.table(spark, sf_dir, "nation").selectExpr("n_name as town", "n_nationkey * 10 as POPESTIMATE2019", "n_regionkey * 7 as POPESTIMATE2020", "1 as POPESTIMATE042020", "2 as CENSUS2020POP")
    return tables.municipal_estimates(wide, r"POPESTIMATE(\d{4})")


@query(
    "b11_normal_calendar",
    f"""WITH {_INPUTS}, t AS (SELECT least((dayofyear(week_start + 3) - 1) // 7, 51)::INT AS week_of_year, median(out) AS t FROM inp WHERE week_start < DATE '1998-01-01' GROUP BY ALL)
    SELECT week_start, CASE WHEN week_start BETWEEN DATE '1998-03-01' AND DATE '1998-12-31' THEN coalesce(t, out) ELSE out END AS out FROM (SELECT *, least((dayofyear(week_start + 3) - 1) // 7, 51)::INT AS week_of_year FROM inp) LEFT JOIN t USING (week_of_year)""",
)
def b11_normal_calendar(spark, sf_dir):
    """What the weeks of a span would have been in a typical year."""
    inputs = p16_weekly_inputs(spark, sf_dir)
    typical = inputs.filter("week_start < '1998-01-01'").groupBy(timeline.week_of_year(F.col("week_start")).alias("week_of_year")).agg(F.percentile("out", 0.5).alias("out"))
    return tables.normal_calendar(inputs, F.lit(date(1998, 3, 1)), F.lit(date(1998, 12, 31)), typical).select("week_start", "out")


@query(
    "b10_forecast",
    f"""WITH {_PRESENCE}, fw AS (SELECT unnest(generate_series(DATE '2001-09-03', DATE '2002-08-26', INTERVAL 7 DAY))::DATE AS week_start), fe AS (SELECT week_start, n.* FROM fw JOIN norm n ON n.fall_year = (SELECT max(fall_year) FROM norm)),
    fs AS (SELECT fe.*, days_in_session / 7 AS os, summer_break_days / 7 AS ob FROM fe JOIN (SELECT week_start + 364 * 2 AS week_start, unitid, days_in_session, summer_break_days FROM wsess) s USING (week_start, unitid)),
    al AS (SELECT fe.*, os, ob FROM fe LEFT JOIN (SELECT week_start, unitid, os, ob FROM fs) USING (week_start, unitid)), ft AS (SELECT week_start, sum(os * in_person) / sum(in_person) FILTER (os IS NOT NULL) AS ts FROM al GROUP BY ALL)
    SELECT week_start, sum(in_person * coalesce(os, ts)) / sum(normal_in_person) AS presence_index FROM al JOIN ft USING (week_start) GROUP BY ALL""",
)
def b10_forecast(spark, sf_dir):
    """The index of weeks ahead with inputs held."""
    weeks = timeline.build_weeks(spark, date(2001, 9, 3), date(2002, 8, 26))
    session = _session(spark, sf_dir).withColumn("week_start", F.date_add("week_start", 728))
    found = tables.forecast(weeks, presence.normal_enrollment(A.enrollment(spark, sf_dir), REMOTE), session)
    return found.select("week_start", "presence_index")


@query("f14_finite_medians", "SELECT l_suppkey % 10 AS zone, count(*) AS n, median(ln(l_quantity - 1)) AS median FROM lineitem WHERE l_quantity > 1 GROUP BY ALL")
def f14_finite_medians(spark, sf_dir):
    """Medians over finite values only; the log of 0 isn't one."""
    value = F.ln(F.col("l_quantity") - 1)
    rows = A.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("zone"), value.alias("v")).filter("v is not null and not isnan(v) and abs(v) < double('infinity')")
    return rows.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.percentile("v", 0.5).alias("median"))


@query("j15_mapping", "WITH m AS (SELECT r_name AS grp, unnest([r_regionkey, r_regionkey + 5, r_regionkey + 10]) AS nation FROM region) SELECT grp, count(*) AS customers, sum(c_custkey)::BIGINT AS keys FROM m JOIN customer ON c_nationkey = nation GROUP BY ALL")
def j15_mapping(spark, sf_dir):
    """One group to several members, by an exploded mapping."""
    mapping = A.table(spark, sf_dir, "region").select(F.col("r_name").alias("grp"), F.explode(F.array(F.col("r_regionkey"), F.col("r_regionkey") + 5, F.col("r_regionkey") + 10)).alias("c_nationkey"))
    joined = A.table(spark, sf_dir, "customer").join(F.broadcast(mapping), "c_nationkey")  # five regions by three
    return joined.groupBy("grp").agg(F.count(F.lit(1)).alias("customers"), F.sum("c_custkey").alias("keys"))


@query("r7_one_hot", "SELECT o_orderkey, (o_orderpriority = '1-URGENT')::INT AS p_1, (o_orderpriority = '2-HIGH')::INT AS p_2, (o_orderpriority = '3-MEDIUM')::INT AS p_3 FROM orders")
def r7_one_hot(spark, sf_dir):
    """Levels as 0/1 columns."""
    levels = ("1-URGENT", "2-HIGH", "3-MEDIUM")
    return A.table(spark, sf_dir, "orders").select("o_orderkey", *((F.col("o_orderpriority") == level).cast("int").alias(f"p_{n}") for n, level in enumerate(levels, 1)))


@query(
    "d2_calendar_data",
    f"""WITH {A.CALENDAR}, e AS (SELECT unitid, string_agg(event, '; ' ORDER BY event) AS estimated FROM complete WHERE status = 'estimated' GROUP BY ALL)
    SELECT week_start, w.unitid, CASE WHEN days_in_session IS NULL THEN 'unknown' WHEN days_in_session = 7 THEN 'in session' WHEN days_in_session > 0 THEN 'partly' WHEN summer_break_days = 7 THEN 'summer' ELSE 'break' END AS state, coalesce(estimated, '') AS estimated FROM wsess w LEFT JOIN e USING (unitid)""",
)
def d2_calendar_data(spark, sf_dir):
    """State of each week and the events that were estimated."""
    session = _session(spark, sf_dir)
    guessed = A.calendar(spark, sf_dir).filter("status = 'estimated'").groupBy("unitid").agg(F.array_join(F.array_sort(F.collect_list("event")), "; ").alias("estimated"))
    days = F.col("days_in_session")
    state = F.when(days.isNull(), "unknown").when(days == 7, "in session").when(days > 0, "partly").when(F.col("summer_break_days") == 7, "summer").otherwise("break")
    return session.join(guessed, "unitid", "left").select("week_start", "unitid", state.alias("state"), F.coalesce("estimated", F.lit("")).alias("estimated"))


@query(
    "d4_typical_year",
    f"WITH {_INPUTS} SELECT make_date(CASE WHEN month(week_start + 3) >= 8 THEN 2003 ELSE 2004 END, month(week_start + 3), day(week_start + 3)) AS day, count(*) AS n, median(out) AS median, min(out) AS low, max(out) AS high FROM inp GROUP BY ALL",
)
def d4_typical_year(spark, sf_dir):
    """Weeks of all years laid over one reference year."""
    day = timeline.reference_day(timeline.thursday(F.col("week_start")))
    return p16_weekly_inputs(spark, sf_dir).groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"), F.percentile("out", 0.5).alias("median"), F.min("out").alias("low"), F.max("out").alias("high"))


@query("d6_parsed_subsets", "SELECT split_part(s, ', ', 1) AS source, split_part(s, ', ', 2) AS period, regexp_full_match(split_part(s, ', ', 2), '[0-9]{4}') AS is_year, count(*) AS n FROM (SELECT o_orderpriority || ', ' || CASE WHEN o_orderkey % 4 = 0 THEN 'all years' ELSE year(o_orderdate)::VARCHAR END AS s FROM orders) GROUP BY ALL")
def d6_parsed_subsets(spark, sf_dir):
    """"source, period" taken apart."""
    text = F.concat(F.col("o_orderpriority"), F.lit(", "), F.when(F.col("o_orderkey") % 4 == 0, "all years").otherwise(F.year("o_orderdate").cast("string")))
    parts = A.table(spark, sf_dir, "orders").select(F.split(text, ", ").alias("p"))
    rows = parts.select(F.col("p")[0].alias("source"), F.col("p")[1].alias("period"))
    return rows.groupBy("source", "period", F.col("period").rlike(r"^\d{4}$").alias("is_year")).agg(F.count(F.lit(1)).alias("n"))


@query("d11_calendar_coverage", f"WITH {A.CALENDAR}, {A.ENROLLMENT} SELECT fall_year, sum(in_person) FILTER (unitid IN (SELECT unitid FROM cal WHERE status = 'verified' AND start_year = fall_year))::DOUBLE / sum(in_person) AS covered FROM enr GROUP BY ALL")
def d11_calendar_coverage(spark, sf_dir):
    """Share of enrollment whose institutions' calendars were collected."""
    known = A.known_calendar(spark, sf_dir).filter("status = 'verified'").select("unitid", F.col("start_year").alias("fall_year"), F.lit(True).alias("known")).distinct()
    joined = A.enrollment(spark, sf_dir).join(known, ["unitid", "fall_year"], "left")
    return joined.groupBy("fall_year").agg((F.sum(F.when(F.col("known"), F.col("in_person"))) / F.sum("in_person")).alias("covered"))


@query("l8_splines")
def l8_splines(spark, sf_dir):
    """Additive splines by sums of products."""
    rows = tables.splines(_series(spark, sf_dir), "rain", [20.0, 60.0, 100.0])
    x = ["one", "rain", "rain_2", "rain_k0", "rain_k1", "rain_k2"]
    guessed = panel.held_out_scores(materialize(rows, "splines"), x, "y", "month", "week_start")
    return panel.scores(guessed.withColumn("year", F.year("week_start")), "y", "predicted", ["year"])


@query(
    "m13_partial_out",
    f"""WITH {_SERIES}, t AS (SELECT f.month AS held, d.* FROM (SELECT DISTINCT month FROM dat) f JOIN (SELECT month AS m, min(week_start) AS lo, max(week_start) AS hi FROM dat GROUP BY ALL) q ON q.m = f.month JOIN dat d ON d.week_start < lo OR d.week_start > hi),
    c AS (SELECT held, avg(y) AS my, avg(rain) AS mr, avg(snow) AS ms, covar_pop(rain, rain) AS rr, covar_pop(rain, snow) AS rs, covar_pop(snow, snow) AS ss, covar_pop(rain, y) AS ry, covar_pop(snow, y) AS sy FROM t GROUP BY held)
    SELECT week_start, y - my - (ss * ry - rs * sy) / (rr * ss - rs * rs) * (rain - mr) - (rr * sy - rs * ry) / (rr * ss - rs * rs) * (snow - ms) AS residual FROM dat JOIN c ON c.held = month""",
)
def m13_partial_out(spark, sf_dir):
    """Cross-fitted residuals of the weather, by months."""
    rows = _series(spark, sf_dir)
    guessed = panel.held_out_scores(rows, ["one", "rain", "snow"], "y", "month", "week_start", 0)
    return guessed.select("week_start", (F.col("y") - F.col("predicted")).alias("residual"))


@query(
    "f4_calendar_problems",
    f"""WITH {A.CALENDAR}, t AS (SELECT unitid, start_year || '-' || lpad(((start_year + CASE WHEN unitid::INT % 9 = 4 THEN 2 ELSE 1 END) % 100)::VARCHAR, 2, '0') AS academic_year, start_year, CASE WHEN unitid::INT % 7 = 3 THEN 'feast' ELSE event END AS event, date FROM cal WHERE date IS NOT NULL)
    SELECT unitid, academic_year, event, problem FROM (SELECT *, unnest(list_filter([CASE WHEN event = 'feast' THEN 'unknown event' END, CASE WHEN unitid::INT % 9 = 4 THEN 'bad academic year' END, CASE WHEN unitid::INT % 5 = 2 THEN 'missing source URL' END, CASE WHEN unitid::INT % 6 = 1 AND dayname(date) <> 'Monday' THEN 'weekday does not match' END,
    CASE WHEN CASE WHEN event LIKE 'fall%' THEN year(date) <> start_year ELSE year(date) <> start_year + 1 END THEN 'date outside the term''s year' END], lambda x: x IS NOT NULL)) AS problem FROM t)""",
)
def f4_calendar_problems(spark, sf_dir):
    """All problems of hand-collected calendars at once."""
    unit = F.col("unitid").cast("int")
    label = F.format_string("%d-%02d", F.col("start_year"), (F.col("start_year") + F.when(unit % 9 == 4, 2).otherwise(1)) % 100)
    rows = A.known_calendar(spark, sf_dir).filter("date is not null").select(
        "unitid", label.alias("academic_year"), F.when(unit % 7 == 3, "feast").otherwise(F.col("event")).alias("event"), F.col("date").cast("string").alias("date"), F.when(unit % 6 == 1, "Monday").otherwise(F.date_format("date", "EEEE")).alias("weekday"),
        F.when(unit % 5 != 2, "http://x").alias("source_url"), F.lit(None).cast("string").alias("note"),
    )
    return calendars.problems(rows)


@query("s9_pruned_read", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'")
def s9_pruned_read(spark, sf_dir):
    """Two columns and a date range of a wide table; both reach the scan."""
    return A.table(spark, sf_dir, "orders").filter("o_orderdate >= timestamp_ntz'2000-01-01'").select("o_orderkey", "o_orderstatus")


@query("j2_known_weeks", f"WITH {A.ENTRIES}, {A.WEATHER}, w AS (SELECT date_trunc('week', date)::DATE AS week_start FROM weather GROUP BY ALL HAVING count(*) = 7), e AS (SELECT date_trunc('week', date)::DATE AS week_start, stop_id, sum(entries)::BIGINT AS entries FROM entries GROUP BY ALL) SELECT e.* FROM e JOIN w USING (week_start)")
def j2_known_weeks(spark, sf_dir):
    """Weeks restricted to those known elsewhere."""
    week = timeline.week_of(F.col("date")).alias("week_start")
    known = A.weather_days(spark, sf_dir).groupBy(week).agg(F.count(F.lit(1)).alias("n")).filter("n = 7").select("week_start")
    return A.daily_entries(spark, sf_dir).groupBy(week, "stop_id").agg(F.sum("entries").alias("entries")).join(known, "week_start")


@query("a21_typical", f"WITH {A.ENROLLMENT} SELECT unitid, median(in_person) AS typical_in_person, avg(total) AS mean_total FROM enr GROUP BY ALL")
def a21_typical(spark, sf_dir):
    """Median and mean per institution."""
    return A.enrollment(spark, sf_dir).groupBy("unitid").agg(F.percentile("in_person", 0.5).alias("typical_in_person"), F.avg("total").alias("mean_total"))


@query("v7_codes", "SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment, c_nationkey) - 1 AS code FROM customer")
def v7_codes(spark, sf_dir):
    return tables.codes(A.table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"], "code").select("c_custkey", F.col("code").cast("long").alias("code"))


@query(
    "g8_institutions_in_area",
    """WITH y AS (SELECT c_nationkey::VARCHAR AS unitid, year(o_orderdate) AS year, max(c_name) AS name, CASE (c_nationkey + year(o_orderdate)) % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS town FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
    SELECT unitid, arg_max(name, year) AS name, min(year) AS first_year, max(year) AS last_year FROM y WHERE town IN ('A', 'B') GROUP BY unitid""",
)
def g8_institutions_in_area(spark, sf_dir):
    """Institutions by each year's place."""
    rows = A.table(spark, sf_dir, "orders").join(A.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    yearly = rows.groupBy(F.col("c_nationkey").cast("string").alias("unitid"), F.year("o_orderdate").alias("year")).agg(F.max("c_name").alias("name"))
    town = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), ((F.col("unitid").cast("int") + F.col("year")) % 3 + 1).cast("int"))
    return tables.institutions_in_area(yearly, yearly.select("unitid", "year", town.alias("municipality")), ["A", "B"])


_TRIP_WEEKS = """tw AS (SELECT date_trunc('week', date)::DATE AS week_start, station_id AS stop_id, coalesce(sum(trips) FILTER (isodow(date) < 6), 0)::BIGINT AS weekday_entries, coalesce(sum(trips) FILTER (isodow(date) >= 6), 0)::BIGINT AS weekend_entries FROM station_day WHERE station_id IS NOT NULL GROUP BY ALL),
    bw AS (SELECT * FROM tw QUALIFY median(weekday_entries + weekend_entries) OVER (PARTITION BY stop_id, year(week_start + 3)) >= 2)"""


@query("b18_trip_station_weeks", f"WITH {A.TRIPS}, {_TRIP_WEEKS} SELECT * FROM bw")
def b18_trip_station_weeks(spark, sf_dir):
    """Trips in the layout of gate entries, busy station-years only."""
    return tables.trip_station_weeks(A.station_days(spark, sf_dir), 2.0)


@query("b20_step_job", "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY ALL")
def b20_step_job(spark, sf_dir):
    """A step that reads by name, builds, and writes one table."""
    folder = f"{shared_folder(spark)}/ebbtide-step-{uuid.uuid4().hex}"
    tables.run_step(spark, lambda orders: orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers")), ["orders.parquet"], sf_dir, folder, "status")
    return spark.read.parquet(f"{folder}/status")


@query("m19_panel_report")
def m19_panel_report(spark, sf_dir):
    """Pooled, by-unit and placebo effects of the share in session, and calendar kinds by unit."""
    return reports.panel_report(b19_panel_units(spark, sf_dir), "session_share", "y", "unit", "week_start", "calendar")


@query("d10_most_who_could_leave", f"WITH {_INPUTS} SELECT median(breaks / nullif(out, 0)) AS ratio, count(*) AS n FROM inp WHERE out >= 0.9")
def d10_most_who_could_leave(spark, sf_dir):
    """Median ratio in weeks when all are away."""
    away = p16_weekly_inputs(spark, sf_dir).filter("out >= 0.9")
    return away.agg(F.percentile(F.try_divide("breaks", "out"), 0.5).alias("ratio"), F.count(F.lit(1)).alias("n"))


@query("d12_presentation", """SELECT c_name AS "Customer", c_acctbal AS "Balance ($)", CASE WHEN c_acctbal < 0 THEN 'in debt' ELSE 'in credit' END AS "State" FROM customer""")
def d12_presentation(spark, sf_dir):
    """Columns renamed with their units, codes as words."""
    state = F.when(F.col("c_acctbal") < 0, "in debt").otherwise("in credit")
    return A.table(spark, sf_dir, "customer").select(F.col("c_name").alias("Customer"), F.col("c_acctbal").alias("Balance ($)"), state.alias("State"))
