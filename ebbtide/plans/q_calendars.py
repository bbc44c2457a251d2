"""Queries over gate entries, weather and calendars."""

from pyspark.sql import functions as F

from ebbtide.operators import calendars, closures, timeline
from ebbtide.plans import adapters as A
from ebbtide.plans.registry import query

_FLAGS = (
    A.ENTRIES
    + """, kinds AS (SELECT *, CASE WHEN isodow(date) <= 5 THEN 'weekday' WHEN isodow(date) = 6 THEN 'saturday' ELSE 'sunday' END AS kind FROM entries),
    usual AS (SELECT *, CASE WHEN kind = 'weekday' THEN CASE WHEN count(*) OVER wd >= 9 THEN median(entries) OVER wd END ELSE CASE WHEN count(*) OVER we >= 5 THEN median(entries) OVER we END END AS typical FROM kinds
        WINDOW wd AS (PARTITION BY stop_id, kind ORDER BY date ROWS BETWEEN 22 PRECEDING AND 22 FOLLOWING), we AS (PARTITION BY stop_id, kind ORDER BY date ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
    ratios AS (SELECT *, entries / nullif(typical, 0) AS ratio FROM usual),
    flags AS (SELECT date, stop_id, entries, coalesce(ratio < 0.5::DOUBLE * median(ratio) OVER (PARTITION BY date), false) AS closed FROM ratios)"""
)


@query("v1_closed_days", f"WITH {_FLAGS} SELECT * FROM flags")
def v1_closed_days(spark, sf_dir):
    """Closure flags by centred rolling medians (V1)."""
    return closures.closed_days(A.daily_entries(spark, sf_dir))


@query("a6_weekly_closed_days", f"WITH {_FLAGS} SELECT date_trunc('week', date)::DATE AS week_start, stop_id, 7 - count(*) FILTER (NOT closed) AS closed_days FROM flags GROUP BY ALL")
def a6_weekly_closed_days(spark, sf_dir):
    return closures.weekly_closed_days(v1_closed_days(spark, sf_dir))


@query(
    "a4_weekly_entries",
    f"""WITH {A.ENTRIES}, b AS (SELECT min(date) AS lo, max(date) AS hi FROM entries)
    SELECT date_trunc('week', date)::DATE AS week_start, stop_id, sum(entries)::BIGINT AS entries, coalesce(sum(entries) FILTER (isodow(date) < 6), 0)::BIGINT AS weekday_entries,
    coalesce(sum(entries) FILTER (isodow(date) >= 6), 0)::BIGINT AS weekend_entries, count(DISTINCT date) AS days_with_data,
    date_trunc('week', date)::DATE >= lo AND date_trunc('week', date)::DATE + 6 <= hi AS complete_week FROM entries, b GROUP BY date_trunc('week', date)::DATE, stop_id, lo, hi""",
)
def a4_weekly_entries(spark, sf_dir):
    return closures.weekly_entries(A.daily_entries(spark, sf_dir), by=("stop_id",))


_RAW = """raw AS (SELECT l_shipdate::DATE AS date, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE 'place-' || (l_suppkey % 40) END AS stop_id, 'Station ' || (l_suppkey % 40) AS station_name, l_quantity / 4 AS entries FROM lineitem),
    one AS (SELECT date, stop_id, station_name, sum(entries) AS entries FROM raw GROUP BY ALL),
    named AS (SELECT station_name, stop_id AS known FROM (SELECT *, row_number() OVER (PARTITION BY station_name ORDER BY m DESC, stop_id) AS n FROM (SELECT station_name, stop_id, count(*) AS m FROM one WHERE stop_id IS NOT NULL GROUP BY ALL)) WHERE n = 1),
    filled AS (SELECT date, coalesce(stop_id, known, 'name-' || regexp_replace(lower(station_name), '[^a-z0-9]+', '-', 'g')) AS stop_id, station_name, entries FROM one LEFT JOIN named USING (station_name)),
    daily AS (SELECT date, stop_id, min(station_name) AS station_name, round(sum(entries))::BIGINT AS entries FROM filled GROUP BY ALL)"""


def _raw_entries(spark, sf_dir):
    rows = A.table(spark, sf_dir, "lineitem")
    return rows.selectExpr(
        "concat(date_format(l_shipdate, 'yyyy-MM-dd'), 'T00:00:00') as service_date", "case when l_suppkey % 14 = 0 then 'NA' when l_suppkey % 7 = 0 then ' ' else concat('place-', l_suppkey % 40) end as stop_id",
        "concat(' Station ', l_suppkey % 40) as station_name", "cast(l_quantity / 4 as string) as gated_entries",
    )


@query("a5_daily_entries", f"WITH {_RAW} SELECT * FROM daily")
def a5_daily_entries(spark, sf_dir):
    """All-text periods to station-days, missing ids filled."""
    return closures.daily_entries(closures.fill_stop_ids(closures.read_entries(_raw_entries(spark, sf_dir))))


@query(
    "j12_name_match",
    f"""WITH {_RAW}, d AS (SELECT date, CASE WHEN stop_id IN ('place-3', 'place-5', 'place-8') THEN 'name-' || stop_id ELSE stop_id END AS stop_id, station_name, entries FROM daily),
    api(stop_id, api_name) AS (VALUES ('place-A', 'STATION 3'), ('place-B', 'station 5'), ('place-C', 'Station 5'), ('place-D', 'Station 9')),
    u AS (SELECT lower(api_name) AS name, min(stop_id) AS api_id FROM api GROUP BY ALL HAVING count(*) = 1)
    SELECT date, CASE WHEN stop_id LIKE 'name-%' THEN coalesce(api_id, stop_id) ELSE stop_id END AS stop_id, min(station_name) AS station_name, sum(entries)::BIGINT AS entries
    FROM d LEFT JOIN u ON lower(station_name) = name GROUP BY ALL""",
)
def j12_name_match(spark, sf_dir):
    """Placeholder ids replaced by the only station of that name."""
    stop = F.when(F.col("stop_id").isin("place-3", "place-5", "place-8"), F.concat(F.lit("name-"), "stop_id")).otherwise(F.col("stop_id"))
    api = spark.createDataFrame([("place-A", "STATION 3"), ("place-B", "station 5"), ("place-C", "Station 5"), ("place-D", "Station 9")], "stop_id string, api_name string")
    return closures.match_by_name(a5_daily_entries(spark, sf_dir).withColumn("stop_id", stop), api)


@query("v11_latest_names", f"WITH {_RAW} SELECT stop_id, arg_max(station_name, date) AS station_name, min(date) AS first_date, max(date) AS last_date, sum(entries)::BIGINT AS total_entries FROM daily GROUP BY stop_id")
def v11_latest_names(spark, sf_dir):
    return closures.latest_names(a5_daily_entries(spark, sf_dir))


@query(
    "a7_weather_weekly",
    f"""WITH {A.WEATHER} SELECT date_trunc('week', date)::DATE AS week_start, avg(temp_c) AS mean_temp_c, sum(rain_mm) AS rain_mm, sum(snow_mm) AS snow_mm, avg(wind_ms) AS wind_ms, count(*) FILTER (rain_mm >= 1) AS rain_days,
    count(*) FILTER (rain_mm >= 10) AS heavy_rain_days, count(*) FILTER (snow_mm >= 10) AS snow_days, count(*) FILTER (temp_min_c < 0) AS ice_days, count(*) FILTER (temp_max_c >= 30) AS hot_days,
    count(*) = 7 AS complete_week FROM weather GROUP BY ALL""",
)
def a7_weather_weekly(spark, sf_dir):
    return closures.weather_weekly(A.weather_days(spark, sf_dir))


@query(
    "a8_weather_by_day_type",
    f"""WITH {A.WEATHER} SELECT date_trunc('week', date)::DATE AS week_start, CASE WHEN isodow(date) >= 6 THEN 'weekend' ELSE 'weekday' END AS day, avg(temp_c) AS temp_c, avg((rain_mm >= 1)::INT) AS rain_share,
    avg((snow_mm >= 10)::INT) AS snow_share, avg((temp_min_c < 0)::INT) AS ice_share, avg((temp_max_c >= 30)::INT) AS hot_share FROM weather GROUP BY ALL""",
)
def a8_weather_by_day_type(spark, sf_dir):
    return closures.weather_by_day_type(A.weather_days(spark, sf_dir))


@query(
    "f9_missing_dates",
    f"WITH {A.WEATHER}, w AS (SELECT date FROM weather WHERE day(date) <> 13) SELECT d::DATE AS date FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d FROM w) WHERE d::DATE NOT IN (SELECT date FROM w)",
)
def f9_missing_dates(spark, sf_dir):
    return timeline.missing_dates(A.weather_days(spark, sf_dir).filter(F.day("date") != 13), "date")


@query(
    "t1_build_weeks",
    """WITH b AS (SELECT min(o_orderdate)::DATE AS lo, max(o_orderdate)::DATE AS hi FROM orders), y AS (SELECT unnest(range(year(lo) - 1, year(hi) + 2))::INT AS y FROM b),
    f AS (SELECT make_date(y, m, d) AS date, name FROM y, (VALUES (1, 1, 'New Year''s Day'), (7, 4, 'Independence Day'), (11, 11, 'Veterans Day'), (12, 25, 'Christmas Day'), (6, 19, 'Juneteenth National Independence Day')) v(m, d, name) WHERE m <> 6 OR y >= 2021),
    n AS (SELECT make_date(y, m, 1) + ((w + 7 - isodow(make_date(y, m, 1))) % 7 + 7 * k)::INT AS date, name FROM y, (VALUES (1, 1, 2, 'Martin Luther King Jr. Day'), (2, 1, 2, 'Washington''s Birthday'), (4, 1, 2, 'Patriots'' Day'), (9, 1, 0, 'Labor Day'), (10, 1, 1, 'Columbus Day'), (11, 4, 3, 'Thanksgiving Day')) v(m, w, k, name)
        UNION ALL SELECT make_date(y, 5, 31) - (isodow(make_date(y, 5, 31)) - 1)::INT, 'Memorial Day' FROM y),
    h AS (SELECT * FROM f UNION ALL SELECT CASE WHEN isodow(date) = 6 THEN date - 1 ELSE date + 1 END, name || ' (observed)' FROM f WHERE isodow(date) >= 6 UNION ALL SELECT * FROM n),
    k AS (SELECT date_trunc('week', date)::DATE AS week_start, count(*) AS n, string_agg(name, '; ' ORDER BY date, name) AS names FROM h GROUP BY ALL),
    s AS (SELECT unnest(generate_series(date_trunc('week', lo), date_trunc('week', hi), INTERVAL 7 DAY))::DATE AS week_start FROM b)
    SELECT week_start, week_start + 6 AS week_end, isoyear(week_start) AS iso_year, weekofyear(week_start) AS iso_week, month(week_start + 3) AS month, coalesce(n, 0) AS n_holidays, coalesce(names, '') AS holiday_names FROM s LEFT JOIN k USING (week_start)""",
)
def t1_build_weeks(spark, sf_dir):
    """The weekly spine over the orders' days, with holidays."""
    low, high = A.table(spark, sf_dir, "orders").agg(F.min(F.to_date("o_orderdate")), F.max(F.to_date("o_orderdate"))).first()
    return timeline.build_weeks(spark, low, high)


@query(
    "p13_week_terms",
    """WITH w AS (SELECT DISTINCT date_trunc('week', o_orderdate)::DATE AS week_start FROM orders), a AS (SELECT *, week_start + 3 AS t, (dayofyear(week_start + 3) - 1) * (2 * pi() / 365.25) AS angle FROM w)
    SELECT week_start, CASE WHEN month(t) >= 8 THEN year(t) ELSE year(t) - 1 END AS fall_year, sin(angle) AS sin_1, cos(angle) AS cos_1, sin(angle * 2) AS sin_2, cos(angle * 2) AS cos_2,
    least((dayofyear(t) - 1) // 7, 51)::INT AS week_of_year, (date_diff('day', make_date(CASE WHEN month(t) >= 8 THEN year(t) ELSE year(t) - 1 END, 8, 1), t) // 7)::INT AS week_of_academic_year,
    CASE WHEN month(t) = 11 THEN 'thanksgiving' WHEN month(t) IN (12, 1) THEN 'winter' ELSE 'spring' END AS break_kind,
    week_start + 6 >= make_date(year(week_start), 12, 24) OR week_start <= make_date(year(week_start), 1, 1) AS year_end_week,
    make_date(CASE WHEN month(t) >= 8 THEN 2003 ELSE 2004 END, month(t), day(t)) AS reference_day,
    (CASE WHEN month(t) >= 8 THEN year(t) ELSE year(t) - 1 END)::VARCHAR || '-' || lpad(((CASE WHEN month(t) >= 8 THEN year(t) ELSE year(t) - 1 END + 1) % 100)::VARCHAR, 2, '0') AS label FROM a""",
)
def p13_week_terms(spark, sf_dir):
    """Labels of a week."""
    week = F.col("week_start")
    weeks = A.table(spark, sf_dir, "orders").select(timeline.week_of(F.to_date("o_orderdate")).alias("week_start")).distinct()
    return weeks.select(
        week, timeline.fall_year(week).alias("fall_year"), *(wave.alias(name) for name, wave in timeline.harmonics(week).items()), timeline.week_of_year(week).alias("week_of_year"),
        timeline.week_of_academic_year(week).alias("week_of_academic_year"), timeline.break_kind(week).alias("break_kind"), timeline.year_end_week(week).alias("year_end_week"),
        timeline.reference_day(timeline.thursday(week)).alias("reference_day"), timeline.academic_year_label(timeline.fall_year(week)).alias("label"),
    )


@query(
    "p10_covid_flags",
    """WITH w AS (SELECT DISTINCT date_trunc('week', o_orderdate + INTERVAL 7300 DAY)::DATE AS week_start FROM orders), a AS (SELECT week_start, week_start + 3 AS t FROM w)
    SELECT week_start, CASE WHEN t BETWEEN DATE '2020-03-16' AND DATE '2020-08-15' THEN 'lockdown' WHEN t BETWEEN DATE '2020-08-16' AND DATE '2021-08-15' THEN 'remote_year' ELSE 'normal' END AS period,
    CASE WHEN t BETWEEN DATE '2020-08-16' AND DATE '2020-12-31' THEN 'fall_2020' WHEN t BETWEEN DATE '2021-01-01' AND DATE '2021-08-15' THEN 'spring_2021' END AS term FROM a""",
)
def p10_covid_flags(spark, sf_dir):
    """Pandemic periods and terms, on days moved by twenty years (P10)."""
    week = F.col("week_start")
    moved = A.table(spark, sf_dir, "orders").select(timeline.week_of(F.to_date(F.expr("o_orderdate + interval 7300 days"))).alias("week_start")).distinct()
    return moved.select(week, timeline.covid_period(week).alias("period"), timeline.covid_term(week).alias("term"))


@query("t3_offsets", f"WITH {A.CALENDAR} SELECT unitid, event, off::INT AS offset_days, n_years FROM offs")
def t3_offsets(spark, sf_dir):
    return calendars.offsets(A.known_calendar(spark, sf_dir).filter("status = 'verified'"))


@query("t4_complete_calendar", f"WITH {A.CALENDAR} SELECT * FROM complete")
def t4_complete_calendar(spark, sf_dir):
    return A.calendar(spark, sf_dir)


@query(
    "t5_leave_one_out_errors",
    f"""WITH {A.CALENDAR}, v AS (SELECT *, date_diff('day', anchor, date) AS o FROM cal WHERE status = 'verified'),
    g AS (SELECT a.unitid, a.event, a.start_year, any_value(a.o) AS o, quantile_disc(b.o, 0.5) AS guess FROM v a JOIN v b ON a.unitid = b.unitid AND a.event = b.event AND a.start_year <> b.start_year GROUP BY ALL)
    SELECT unitid, event, start_year, abs(guess - o)::INT AS error_days FROM g""",
)
def t5_leave_one_out_errors(spark, sf_dir):
    return calendars.leave_one_out_errors(A.known_calendar(spark, sf_dir).filter("status = 'verified'"))


@query("t7_session_days", f"WITH {A.CALENDAR} SELECT * FROM sess")
def t7_session_days(spark, sf_dir):
    """Three-valued session and summer days."""
    return calendars.session_days(A.calendar(spark, sf_dir))


@query("a9_weekly_session", f"WITH {A.CALENDAR} SELECT * FROM wsess")
def a9_weekly_session(spark, sf_dir):
    return calendars.weekly_session(t7_session_days(spark, sf_dir))


@query(
    "f10_verified_weeks",
    f"""WITH {A.CALENDAR} SELECT w.* FROM wsess w WHERE NOT EXISTS (SELECT 1 FROM complete c WHERE c.unitid = w.unitid AND c.status = 'estimated' AND c.event <> 'commencement'
    AND c.start_year = year(w.week_start + 3) - (month(w.week_start + 3) < 8)::INT)""",
)
def f10_verified_weeks(spark, sf_dir):
    return calendars.verified_weeks(a9_weekly_session(spark, sf_dir), A.calendar(spark, sf_dir), timeline.fall_year(F.col("week_start")))


@query(
    "f6_order_problems",
    f"""WITH {A.CALENDAR}, r AS (SELECT *, list_position(['fall_classes_start', 'fall_exams_end', 'spring_classes_start', 'february_break_start', 'february_break_end', 'spring_break_start', 'spring_break_end', 'spring_exams_end', 'commencement'], event) AS k,
    CASE WHEN unitid::INT % 6 = 1 AND event = 'fall_exams_end' THEN date - 120 ELSE date END AS d FROM cal WHERE date IS NOT NULL),
    l AS (SELECT unitid, start_year, event, d AS date, lag(event) OVER w AS before, lag(d) OVER w AS before_date FROM r WINDOW w AS (PARTITION BY unitid, start_year ORDER BY k)) SELECT * FROM l WHERE date < before_date""",
)
def f6_order_problems(spark, sf_dir):
    moved = F.when((F.col("unitid").cast("int") % 6 == 1) & (F.col("event") == "fall_exams_end"), F.date_sub("date", 120)).otherwise(F.col("date"))
    return calendars.order_problems(A.known_calendar(spark, sf_dir).withColumn("date", moved))


@query("a35_status_counts", f"WITH {A.CALENDAR} SELECT unitid, status, count(*) AS n FROM complete GROUP BY ALL")
def a35_status_counts(spark, sf_dir):
    return A.calendar(spark, sf_dir).groupBy("unitid", "status").agg(F.count(F.lit(1)).alias("n"))


@query("f5_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def f5_duplicates(spark, sf_dir):
    return calendars.duplicates(A.table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("f7_not_allowed", "SELECT o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY ALL")
def f7_not_allowed(spark, sf_dir):
    return calendars.not_allowed(A.table(spark, sf_dir, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query("f8_missing_members", "SELECT c_custkey AS o_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def f8_missing_members(spark, sf_dir):
    expected = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return calendars.missing_members(A.table(spark, sf_dir, "orders"), "o_custkey", expected)
