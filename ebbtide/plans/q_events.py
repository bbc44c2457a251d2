"""Queries over trips."""

import uuid
from datetime import date

from pyspark.sql import functions as F

from ebbtide.operators import events, timeline
from ebbtide.operators.ranking import top_groups
from ebbtide.plans import adapters as A
from ebbtide.plans.registry import query
from ebbtide.plans.scratch import shared_folder
from ebbtide.sources import files

_COUNTS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in events.COUNTS)
_WEEKLY = f"""
    daily AS (SELECT date, {{by}} {_COUNTS}, coalesce(sum(trips) FILTER (station_id IS NULL), 0)::BIGINT AS no_station_trips, count(DISTINCT station_id) AS active FROM {{source}} GROUP BY ALL),
    weekly AS (SELECT date_trunc('week', date)::DATE AS week_start, {{by}} count(*) AS days_with_data, {_COUNTS}, sum(no_station_trips)::BIGINT AS no_station_trips,
        avg(active) AS avg_daily_active_stations FROM daily GROUP BY ALL)
    SELECT *, week_start >= DATE '1995-01-01' AND week_start + 6 <= DATE '2001-10-31' AS complete_week,
        (trips - no_station_trips) / nullif(avg_daily_active_stations, 0) AS trips_per_active_station, college_age_trips / nullif(age_known_trips, 0) AS college_age_share
    FROM weekly
"""
_BOUNDS = (date(1995, 1, 1), date(2001, 10, 31))


@query("p2_standardize", f"WITH {A.TRIPS} SELECT * FROM trips")
def p2_standardize(spark, sf_dir):
    """Both raw layouts as typed trips."""
    return A.trips(spark, sf_dir)


@query("p5_rider_age", f"WITH {A.TRIPS} SELECT trip_key, age::BIGINT AS rider_age FROM judged WHERE age IS NOT NULL")
def p5_rider_age(spark, sf_dir):
    return A.trips(spark, sf_dir).select("trip_key", events.rider_age(F.col("started_at"), F.col("birth_year")).alias("rider_age")).filter("rider_age is not null")


@query(
    "f1_cleaning_report",
    f"""WITH {A.TRIPS} SELECT strftime(started_at, '%Y%m') AS month, count(*) AS rows_raw, count(*) FILTER (reason = 'bad_time') AS rows_bad_time,
    count(*) FILTER (reason = 'too_short') AS rows_too_short, count(*) FILTER (reason = 'too_long') AS rows_too_long, count(*) FILTER (reason = 'non_public_station') AS rows_non_public_station,
    count(*) FILTER (reason IS NULL) AS rows_kept, count(*) FILTER (reason IS NULL AND start_station_id IS NULL) AS rows_no_start_station FROM judged GROUP BY ALL""",
)
def f1_cleaning_report(spark, sf_dir):
    """Waterfall of reject reasons per month (F1, F2)."""
    return events.cleaning_report(A.trips(spark, sf_dir))


def file_trips(spark, sf_dir):
    """Trips with the month of the file they came in: some that start in a month's first two days came with the month before."""
    before = F.expr("if(dayofmonth(started_at) <= 2 and coalesce(cast(start_station_id as long), 0) % 3 = 0, started_at - interval 3 days, started_at)")
    return A.trips(spark, sf_dir).withColumn("month", F.date_format(before, "yyyyMM"))


@query(
    "a32_month_records",
    f"""WITH {A.TRIPS}, fm AS (SELECT *, strftime(CASE WHEN day(started_at) <= 2 AND l_mod THEN started_at - INTERVAL 3 DAY ELSE started_at END, '%Y%m') AS month, reason IS NULL AS kept FROM (SELECT *, coalesce(start_station_id::BIGINT, 0) % 3 = 0 AS l_mod FROM judged))
    SELECT month, CASE WHEN min(layout) = max(layout) THEN min(layout) ELSE 'mixed' END AS layout, count(*) AS rows_raw, count(*) FILTER (reason = 'bad_time') AS rows_bad_time, count(*) FILTER (reason = 'too_short') AS rows_too_short,
    count(*) FILTER (reason = 'too_long') AS rows_too_long, count(*) FILTER (reason = 'non_public_station') AS rows_non_public_station, count(*) FILTER (kept) AS rows_kept,
    count(*) FILTER (kept AND start_station_id IS NULL) AS rows_no_start_station, count(*) FILTER (kept AND strftime(started_at, '%Y%m') <> month) AS rows_out_of_month,
    min(started_at) FILTER (kept) AS first_start, max(started_at) FILTER (kept) AS last_start, count(DISTINCT start_station_id) FILTER (kept AND strftime(started_at, '%Y%m') = month) AS n_stations FROM fm GROUP BY month""",
)
def a32_month_records(spark, sf_dir):
    """A quality record per file month, written as JSON and read again."""
    path = f"{shared_folder(spark)}/ebbtide-records-{uuid.uuid4().hex}"
    records = events.month_records(file_trips(spark, sf_dir))
    files.write_json_records(records, path)
    return files.read_json_records(spark, path, records.schema)


@query("a1_station_day", f"WITH {A.TRIPS} SELECT * FROM station_day")
def a1_station_day(spark, sf_dir):
    return A.station_days(spark, sf_dir)


@query(
    "a2_stations",
    f"""WITH {A.TRIPS} SELECT start_station_id AS station_id, min(start_station_name) AS station_name, median(start_lat) AS lat, median(start_lng) AS lng, count(*) AS trips,
    min(started_at)::DATE AS first_date, max(started_at)::DATE AS last_date FROM kept WHERE start_station_id IS NOT NULL GROUP BY ALL""",
)
def a2_stations(spark, sf_dir):
    return events.stations(events.clean(A.trips(spark, sf_dir)))


@query("a3_build_weekly", f"WITH {A.TRIPS}, {_WEEKLY.format(by='', source='station_day')}")
def a3_build_weekly(spark, sf_dir):
    """Weekly totals over all stations."""
    return events.build_weekly(A.station_days(spark, sf_dir), *_BOUNDS)


@query(
    "b3_weekly_by_zone",
    f"""WITH {A.TRIPS}, tagged AS (SELECT *, CASE WHEN station_id IS NULL THEN 'unknown' WHEN station_id::BIGINT % 4 = 0 THEN 'campus' WHEN station_id::BIGINT % 4 = 1 THEN 'near' ELSE 'away' END AS campus_zone
    FROM station_day), {_WEEKLY.format(by='campus_zone,', source='tagged')}""",
)
def b3_weekly_by_zone(spark, sf_dir):
    zone = F.expr("case when station_id is null then 'unknown' when cast(station_id as long) % 4 = 0 then 'campus' when cast(station_id as long) % 4 = 1 then 'near' else 'away' end")
    return events.build_weekly(A.station_days(spark, sf_dir).withColumn("campus_zone", zone), *_BOUNDS, by=("campus_zone",))


_ZONES = (
    A.TRIPS
    + """, z AS (SELECT date_trunc('week', date)::DATE AS week_start, CASE WHEN station_id::BIGINT % 4 = 0 THEN 'campus' WHEN station_id::BIGINT % 4 = 1 THEN 'near' ELSE 'away' END AS zone, trips
    FROM station_day WHERE station_id IS NOT NULL)"""
)


@query(
    "a13_by_zone",
    f"WITH {_ZONES} SELECT week_start, sum(trips)::BIGINT AS trips, coalesce(sum(trips) FILTER (zone = 'campus'), 0)::BIGINT AS trips_campus, coalesce(sum(trips) FILTER (zone = 'near'), 0)::BIGINT AS trips_near, coalesce(sum(trips) FILTER (zone = 'away'), 0)::BIGINT AS trips_away FROM z GROUP BY ALL",
)
def a13_by_zone(spark, sf_dir):
    """One row per week with a column per zone."""
    days = A.station_days(spark, sf_dir).filter("station_id is not null")
    zone = F.expr("case when cast(station_id as long) % 4 = 0 then 'campus' when cast(station_id as long) % 4 = 1 then 'near' else 'away' end")
    zones = ("campus", "near", "away")
    rows = days.select(timeline.week_of(F.col("date")).alias("week_start"), zone.alias("zone"), "trips")
    return rows.groupBy("week_start").agg(F.sum("trips").alias("trips"), *(F.coalesce(F.sum(F.when(F.col("zone") == z, F.col("trips"))), F.lit(0)).alias(f"trips_{z}") for z in zones))


@query(
    "a37_campus_ratio",
    f"WITH {_ZONES}, w AS (SELECT week_start, sum(trips) FILTER (zone = 'campus') AS c, sum(trips) FILTER (zone = 'away') AS a FROM z GROUP BY ALL) SELECT week_start, ln(c / a) AS log_ratio FROM w WHERE c > 0 AND a > 0",
)
def a37_campus_ratio(spark, sf_dir):
    """Log ratio of campus to away activity."""
    wide = a13_by_zone(spark, sf_dir).filter("trips_campus > 0 and trips_away > 0")
    return wide.select("week_start", F.ln(F.col("trips_campus") / F.col("trips_away")).alias("log_ratio"))


@query(
    "a15_member_ages",
    f"""WITH {A.TRIPS} SELECT date_trunc('week', started_at)::DATE AS week_start, CASE WHEN isodow(started_at) >= 6 THEN 'weekend' ELSE 'weekday' END AS day, count(age) AS known,
    count(*) FILTER (age BETWEEN 18 AND 24) AS age_18_24, count(*) FILTER (age BETWEEN 25 AND 34) AS age_25_34, count(*) FILTER (age >= 35) AS age_35_up FROM kept WHERE rider_type = 'member' GROUP BY ALL""",
)
def a15_member_ages(spark, sf_dir):
    return events.member_ages(events.clean(A.trips(spark, sf_dir)))


@query(
    "a19_combine_stations",
    f"""WITH {A.TRIPS}, m AS (SELECT start_station_id AS station_id, strftime(started_at, '%Y%m') AS month, min(start_station_name) AS station_name, median(start_lat) AS lat, median(start_lng) AS lng,
    count(*) AS trips, min(started_at)::DATE AS first_date, max(started_at)::DATE AS last_date FROM kept WHERE start_station_id IS NOT NULL GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY trips DESC, first_date) AS n FROM m)
    SELECT station_id, any_value(station_name) FILTER (n = 1) AS station_name, any_value(lat) FILTER (n = 1) AS lat, any_value(lng) FILTER (n = 1) AS lng, sum(trips)::BIGINT AS total_trips,
    min(first_date) AS first_date, max(last_date) AS last_date FROM r GROUP BY station_id""",
)
def a19_combine_stations(spark, sf_dir):
    """Stations over all months by their busiest month."""
    kept = events.clean(A.trips(spark, sf_dir)).withColumn("month", F.date_format("started_at", "yyyyMM"))
    monthly = kept.filter("start_station_id is not null").groupBy(F.col("start_station_id").alias("station_id"), "month").agg(
        F.mode("start_station_name", True).alias("station_name"), F.percentile("start_lat", 0.5).alias("lat"), F.percentile("start_lng", 0.5).alias("lng"),
        F.count(F.lit(1)).alias("trips"), F.to_date(F.min("started_at")).alias("first_date"), F.to_date(F.max("started_at")).alias("last_date"),
    )
    return events.combine_stations(monthly)


#: A trip's file: its month, or the neighbouring one for every seventh trip near a month's end.
_FILES = """files AS (SELECT trip_key, started_at, strftime(CASE WHEN day(started_at) >= 28 AND birth_year % 7 = 0 THEN started_at + INTERVAL 5 DAY ELSE started_at END, '%Y%m') AS month FROM trips
    UNION ALL SELECT trip_key, started_at, strftime(started_at + INTERVAL 5 DAY, '%Y%m') FROM trips WHERE day(started_at) >= 30),
    parts AS (SELECT *, strptime(month || '01', '%Y%m%d') AS lo, strptime(month || '01', '%Y%m%d') + INTERVAL 1 MONTH AS hi FROM files),
    placed AS (SELECT *, CASE WHEN NOT (started_at >= lo AND started_at < hi) THEN 'spill' WHEN started_at < lo + INTERVAL 48 HOUR OR started_at >= hi - INTERVAL 48 HOUR THEN 'edge' ELSE 'inside' END AS part FROM parts)"""


def _files(spark, sf_dir):
    trips = A.trips(spark, sf_dir).select("trip_key", "started_at", "birth_year")
    later = F.date_format(F.expr("started_at + interval 5 days"), "yyyyMM")
    moved = (F.day("started_at") >= 28) & (F.coalesce(F.col("birth_year") % 7, F.lit(1)) == 0)
    own = F.when(moved, later).otherwise(F.date_format("started_at", "yyyyMM"))
    months = F.when(F.day("started_at") >= 30, F.array(own, later)).otherwise(F.array(own))
    return trips.select("trip_key", "started_at", F.explode(months).alias("month"))


@query("t8_split_month", f"WITH {A.TRIPS}, {_FILES} SELECT month, part, count(*) AS n FROM placed GROUP BY ALL")
def t8_split_month(spark, sf_dir):
    return _files(spark, sf_dir).groupBy("month", events.month_part(F.col("started_at"), F.col("month")).alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "k6_unseen_spill",
    f"WITH {A.TRIPS}, {_FILES} SELECT trip_key, min(started_at) AS started_at FROM placed WHERE part = 'spill' AND trip_key NOT IN (SELECT trip_key FROM placed WHERE part = 'edge') GROUP BY ALL",
)
def k6_unseen_spill(spark, sf_dir):
    """Trips outside their file's month that no file has as its own."""
    return events.unseen_spill(_files(spark, sf_dir))


@query("s12_coverage_bounds", f"WITH {A.TRIPS} SELECT date_trunc('month', min(started_at))::DATE AS first_day, last_day(max(started_at)) AS last_day FROM trips")
def s12_coverage_bounds(spark, sf_dir):
    return timeline.coverage_bounds(A.trips(spark, sf_dir).select(F.date_format("started_at", "yyyyMM").alias("month")))


@query(
    "a16_excess",
    f"""WITH {A.TRIPS}, c AS (SELECT CASE WHEN start_station_id::BIGINT % 4 = 0 THEN 'campus' ELSE 'away' END AS zone, isodow(started_at) >= 6 AS weekend, count(*) FILTER (age BETWEEN 18 AND 24) / nullif(count(age), 0) AS share
    FROM kept WHERE start_station_id IS NOT NULL AND rider_type = 'member' GROUP BY ALL), d AS (SELECT weekend, max(share) FILTER (zone = 'campus') - max(share) FILTER (zone = 'away') AS excess FROM c GROUP BY ALL)
    SELECT max(excess) FILTER (NOT weekend) AS excess_weekday, max(excess) FILTER (weekend) AS excess_weekend, max(excess) FILTER (weekend) / nullif(max(excess) FILTER (NOT weekend), 0) AS factor FROM d""",
)
def a16_excess(spark, sf_dir):
    """How much larger the young riders' share is near campuses, weekend against weekday."""
    kept = events.clean(A.trips(spark, sf_dir)).filter("start_station_id is not null and rider_type = 'member'")
    age = events.rider_age(F.col("started_at"), F.col("birth_year"))
    zone = F.when(F.col("start_station_id").cast("long") % 4 == 0, "campus").otherwise("away")
    shares = kept.groupBy(zone.alias("zone"), timeline.is_weekend(F.to_date("started_at")).alias("weekend")).agg(F.try_divide(F.count_if(age.between(18, 24)), F.count(age)).alias("share"))
    excess = shares.groupBy("weekend").agg((F.max(F.when(F.col("zone") == "campus", F.col("share"))) - F.max(F.when(F.col("zone") == "away", F.col("share")))).alias("excess"))
    wide = excess.agg(F.max(F.when(~F.col("weekend"), F.col("excess"))).alias("excess_weekday"), F.max(F.when(F.col("weekend"), F.col("excess"))).alias("excess_weekend"))
    return wide.withColumn("factor", F.try_divide("excess_weekend", "excess_weekday"))


@query(
    "a23_percent_of_total",
    f"WITH {A.TRIPS}, s AS (SELECT coalesce(start_station_id, 'none') AS station_id, count(*) AS trips FROM kept GROUP BY ALL) SELECT station_id, trips, 100.0::DOUBLE * trips / sum(trips) OVER () AS percent FROM s",
)
def a23_percent_of_total(spark, sf_dir):
    counts = events.clean(A.trips(spark, sf_dir)).groupBy(F.coalesce("start_station_id", F.lit("none")).alias("station_id")).agg(F.count(F.lit(1)).alias("trips"))
    total = counts.agg(F.sum("trips").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("station_id", "trips", (100.0 * F.col("trips") / F.col("total")).alias("percent"))


@query(
    "k1_top_groups",
    f"""WITH {A.TRIPS}, t AS (SELECT coalesce(start_station_id, 'none') AS station_id, year(started_at) AS year, count(*) AS trips FROM kept GROUP BY ALL),
    r AS (SELECT station_id, row_number() OVER (ORDER BY sum(trips) DESC, station_id) AS n, count(*) OVER () AS many FROM t GROUP BY station_id)
    SELECT year, CASE WHEN n <= 5 THEN station_id ELSE 'All other (' || (many - 5) || ')' END AS label, sum(trips)::BIGINT AS trips FROM t JOIN r USING (station_id) GROUP BY ALL""",
)
def k1_top_groups(spark, sf_dir):
    """The five largest stations by name and all others together (K1, D3)."""
    counts = events.clean(A.trips(spark, sf_dir)).groupBy(F.coalesce("start_station_id", F.lit("none")).alias("station_id"), F.year("started_at").alias("year")).agg(F.count(F.lit(1)).alias("trips"))
    return top_groups(counts, "station_id", "trips", 5).groupBy("year", "label").agg(F.sum("trips").alias("trips"))
