"""The operators' inputs, derived from the star-schema tables by plain arithmetic.

Each adapter stands here twice: as a DataFrame, and as SQL text for the twins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.operators import events

#: Ship years before this come in the legacy layout.
LEGACY_BEFORE = 1998


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    return rows.withColumns(
        {
            "begin_text": F.expr("concat(cast(l_shipdate as string), '.000')"),
            "end_text": F.expr("concat(cast(timestampadd(SECOND, cast(l_quantity as int) * 60 - 90 + if(l_partkey % 53 = 0, 90000, 0), l_shipdate) as string), '.000')"),
            "station": F.expr("if(l_partkey % 97 = 0, '', cast(l_suppkey as string))"),
            "station_name": F.expr("if(l_partkey % 97 = 0, '', concat(if(l_suppkey % 25 = 7, 'Depot ', 'Stop '), l_suppkey))"),
            "lat_text": F.expr("cast(42.30D + ((l_suppkey * 7919 + 137) % 1000) / 10000D as string)"),
            "lng_text": F.expr("cast(-71.15D + ((l_suppkey * 104729 + 311) % 1500) / 10000D as string)"),
            "end_name": F.expr("if(l_partkey % 101 = 0, 'Repair shop', concat('Stop ', l_partkey % 97))"),
        }
    )


def legacy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rides(spark, sf_dir).filter(f"year(l_shipdate) < {LEGACY_BEFORE}").selectExpr(
        "cast(l_quantity as string) as tripduration", "begin_text as starttime", "end_text as stoptime", "station as `start station id`", "station_name as `start station name`",
        "lat_text as `start station latitude`", "lng_text as `start station longitude`", "cast(l_partkey % 97 as string) as `end station id`", "end_name as `end station name`",
        "concat_ws('-', l_orderkey, l_partkey, l_linenumber) as bikeid", "case l_returnflag when 'N' then 'Subscriber' when 'R' then 'Customer' else 'Visitor' end as usertype",
        "if(l_partkey % 31 = 0, '\\\\N', cast(1940 + l_partkey % 65 as string)) as `birth year`",
    )


def modern_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rides(spark, sf_dir).filter(f"year(l_shipdate) >= {LEGACY_BEFORE}").selectExpr(
        "concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber) as ride_id", "case l_linestatus when 'O' then 'classic_bike' when 'F' then 'electric_bike' else 'cargo' end as rideable_type",
        "begin_text as started_at", "end_text as ended_at", "station as start_station_id", "station_name as start_station_name", "lat_text as start_lat", "lng_text as start_lng",
        "cast(l_partkey % 97 as string) as end_station_id", "end_name as end_station_name", "case l_returnflag when 'N' then 'member' when 'R' then 'casual' else 'Other' end as member_casual",
    )


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All trips of both layouts, standardised."""
    return events.standardize(legacy_files(spark, sf_dir)).unionByName(events.standardize(modern_files(spark, sf_dir)))


TRIPS = f"""
    trips AS (
        SELECT CASE WHEN year(l_shipdate) < {LEGACY_BEFORE} THEN strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') || '.000|' || l_orderkey || '-' || l_partkey || '-' || l_linenumber || '|'
                || CASE WHEN l_partkey % 97 = 0 THEN '' ELSE l_suppkey::VARCHAR END
                ELSE l_orderkey || '|' || l_partkey || '|' || l_suppkey || '|' || l_linenumber END AS trip_key,
            l_shipdate::TIMESTAMP AS started_at,
            l_shipdate::TIMESTAMP + to_seconds(l_quantity::BIGINT * 60 - 90 + CASE WHEN l_partkey % 53 = 0 THEN 90000 ELSE 0 END) AS ended_at,
            CASE WHEN l_partkey % 97 <> 0 THEN l_suppkey::VARCHAR END AS start_station_id,
            CASE WHEN l_partkey % 97 <> 0 THEN CASE WHEN l_suppkey % 25 = 7 THEN 'Depot ' ELSE 'Stop ' END || l_suppkey END AS start_station_name,
            42.30::DOUBLE + ((l_suppkey * 7919 + 137) % 1000)::DOUBLE / 10000 AS start_lat,
            -71.15::DOUBLE + ((l_suppkey * 104729 + 311) % 1500)::DOUBLE / 10000 AS start_lng,
            (l_partkey % 97)::VARCHAR AS end_station_id,
            CASE WHEN l_partkey % 101 = 0 THEN 'Repair shop' ELSE 'Stop ' || (l_partkey % 97) END AS end_station_name,
            CASE l_returnflag WHEN 'N' THEN 'member' WHEN 'R' THEN 'casual' ELSE 'other' END AS rider_type,
            CASE WHEN year(l_shipdate) < {LEGACY_BEFORE} OR l_linestatus = 'O' THEN 'classic' WHEN l_linestatus = 'F' THEN 'electric' ELSE 'other' END AS bike_type,
            CASE WHEN year(l_shipdate) < {LEGACY_BEFORE} AND l_partkey % 31 <> 0 THEN 1940 + l_partkey % 65 END AS birth_year,
            l_quantity::BIGINT * 60 - 90 + CASE WHEN l_partkey % 53 = 0 THEN 90000 ELSE 0 END
                + CASE WHEN l_quantity = 1 AND l_partkey % 53 <> 0 AND month(l_shipdate) = 11 AND isodow(l_shipdate) = 7 AND day(l_shipdate) <= 7 THEN 3600 ELSE 0 END AS duration_s,
            CASE WHEN year(l_shipdate) < {LEGACY_BEFORE} THEN 'legacy' ELSE 'modern' END AS layout
        FROM lineitem),
    judged AS (
        SELECT *, CASE WHEN duration_s < 0 THEN 'bad_time' WHEN duration_s < 60 THEN 'too_short' WHEN duration_s > 86400 THEN 'too_long'
            WHEN coalesce(start_station_name LIKE 'Depot%', FALSE) OR end_station_name LIKE 'Repair%' THEN 'non_public_station' END AS reason,
            CASE WHEN birth_year <> 1969 AND year(started_at) - birth_year BETWEEN 16 AND 90 THEN year(started_at) - birth_year END AS age
        FROM trips),
    kept AS (SELECT * FROM judged WHERE reason IS NULL),
    station_day AS (
        SELECT started_at::DATE AS date, start_station_id AS station_id, count(*) AS trips, count(*) FILTER (rider_type = 'member') AS member_trips,
            count(*) FILTER (rider_type = 'casual') AS casual_trips, count(*) FILTER (bike_type = 'classic') AS classic_trips, count(*) FILTER (bike_type = 'electric') AS electric_trips,
            count(age) AS age_known_trips, count(*) FILTER (age BETWEEN 18 AND 24) AS college_age_trips
        FROM kept GROUP BY ALL)
"""


def station_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.station_day(events.clean(trips(spark, sf_dir)))


def daily_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries per day and stop; ten stops, so that each has entries on most days."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.to_date("l_shipdate").alias("date"), F.concat(F.lit("place-"), F.col("l_suppkey") % 10).alias("stop_id"))
        .agg(F.sum("l_quantity").cast("long").alias("entries"))
    )


ENTRIES = """
    entries AS (SELECT l_shipdate::DATE AS date, 'place-' || (l_suppkey % 10) AS stop_id, sum(l_quantity)::BIGINT AS entries FROM lineitem GROUP BY ALL)
"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point per supplier."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as point_id", "42.30D + ((s_suppkey * 7919 + 137) % 1000) / 10000D as lat", "-71.15D + ((s_suppkey * 104729 + 311) % 1500) / 10000D as lng"
    )


def campuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A campus per nation."""
    return table(spark, sf_dir, "nation").selectExpr(
        "cast(n_nationkey as string) as unitid", "n_name as institution", "42.30D + ((n_nationkey * 7919) % 1000) / 10000D as lat",
        "-71.15D + ((cast(n_nationkey as long) * 104729) % 1500) / 10000D as lng", "cast(n_nationkey * 200 as double) as typical_in_person",
    )


POINTS = """
    points AS (SELECT s_suppkey AS point_id, 42.30::DOUBLE + ((s_suppkey * 7919 + 137) % 1000)::DOUBLE / 10000 AS lat,
        -71.15::DOUBLE + ((s_suppkey * 104729 + 311) % 1500)::DOUBLE / 10000 AS lng FROM supplier),
    campuses AS (SELECT n_nationkey::VARCHAR AS unitid, n_name AS institution, 42.30::DOUBLE + ((n_nationkey * 7919) % 1000)::DOUBLE / 10000 AS lat,
        -71.15::DOUBLE + ((n_nationkey::BIGINT * 104729) % 1500)::DOUBLE / 10000 AS lng, (n_nationkey * 200)::DOUBLE AS typical_in_person FROM nation)
"""


def weather_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weather day per order day."""
    return table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(
        (F.floor(F.sum(F.floor("o_totalprice")) / F.count(F.lit(1)) / 625) / 16 - 10).alias("temp_c"), F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys")
    ).selectExpr("date", "temp_c", "temp_c - n % 7 as temp_min_c", "temp_c + n % 5 as temp_max_c", "cast((keys % 23) as double) as rain_mm", "cast(greatest(keys % 37 - 22, 0) as double) as snow_mm", "n / 4D as wind_ms")


WEATHER = """
    weather AS (SELECT date, temp_c, temp_c - n % 7 AS temp_min_c, temp_c + n % 5 AS temp_max_c, (keys % 23)::DOUBLE AS rain_mm, greatest(keys % 37 - 22, 0)::DOUBLE AS snow_mm, n / 4::DOUBLE AS wind_ms
        FROM (SELECT o_orderdate::DATE AS date, floor(sum(floor(o_totalprice)::BIGINT)::DOUBLE / count(*) / 625) / 16 - 10 AS temp_c, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY ALL))
"""


#: Years of the derived calendars.
FIRST_YEAR, LAST_YEAR = 1995, 2000
_DAYS = (("fall_classes_start", 0, 0), ("fall_exams_end", 105, 1), ("spring_classes_start", 140, 2), ("spring_break_start", 190, 3), ("spring_break_end", 198, 4), ("spring_exams_end", 250, 5))


def known_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified dates of six events per nation and year; one in eleven is missing, and some units have no spring break."""
    from ebbtide.operators.timeline import nth_weekday

    events_table = spark.createDataFrame(_DAYS, "event string, days int, e int")
    years = spark.range(FIRST_YEAR, LAST_YEAR + 1).select(F.col("id").cast("int").alias("start_year"))
    rows = table(spark, sf_dir, "nation").select("n_nationkey").crossJoin(years).crossJoin(events_table).filter("(n_nationkey * 7 + start_year * 3 + e) % 11 <> 0")
    shift = F.expr("(n_nationkey * 5) % 9 + (n_nationkey + start_year) % 3 + days")
    no_break = F.col("event").startswith("spring_break") & (F.col("n_nationkey") % 8 == 3)
    return rows.select(
        F.col("n_nationkey").cast("string").alias("unitid"), "start_year", "event",
        F.when(~no_break, F.date_add(nth_weekday(F.col("start_year"), 9, "MON", 1), shift)).alias("date"), F.when(no_break, "none").otherwise("verified").alias("status"),
    )


CALENDAR = f"""
    ev(event, days, e) AS (VALUES {', '.join(map(str, _DAYS))}),
    yr AS (SELECT unnest(range({FIRST_YEAR}, {LAST_YEAR + 1}))::INT AS start_year),
    hol AS (SELECT start_year, make_date(start_year, 9, 1) + ((8 - isodow(make_date(start_year, 9, 1))) % 7)::INT AS labor,
        make_date(start_year + 1, 1, 1) + ((8 - isodow(make_date(start_year + 1, 1, 1))) % 7 + 14)::INT AS mlk,
        make_date(start_year, 11, 1) + ((11 - isodow(make_date(start_year, 11, 1))) % 7 + 21)::INT AS thanks FROM yr),
    cal AS (SELECT n_nationkey::VARCHAR AS unitid, start_year, event,
        CASE WHEN NOT (event LIKE 'spring_break%' AND n_nationkey % 8 = 3) THEN labor + ((n_nationkey * 5) % 9 + (n_nationkey + start_year) % 3 + days)::INT END AS date,
        CASE WHEN event LIKE 'spring_break%' AND n_nationkey % 8 = 3 THEN 'none' ELSE 'verified' END AS status,
        CASE WHEN event LIKE 'fall%' THEN labor ELSE mlk END AS anchor
        FROM nation, hol JOIN yr USING (start_year), ev WHERE (n_nationkey * 7 + start_year * 3 + e) % 11 <> 0),
    offs AS (SELECT unitid, event, quantile_disc(date_diff('day', anchor, date), 0.5) AS off, count(*) AS n_years FROM cal WHERE status = 'verified' GROUP BY ALL),
    names(event, optional) AS (VALUES ('fall_classes_start', false), ('fall_exams_end', false), ('spring_classes_start', false), ('february_break_start', true), ('february_break_end', true),
        ('spring_break_start', false), ('spring_break_end', false), ('spring_exams_end', false), ('commencement', false)),
    complete AS (SELECT g.unitid, g.start_year, g.event, CASE WHEN c.status IS NOT NULL THEN c.date ELSE g.anchor + off::INT END AS date,
        coalesce(c.status, CASE WHEN off IS NOT NULL THEN 'estimated' ELSE 'missing' END) AS status
        FROM (SELECT n_nationkey::VARCHAR AS unitid, start_year, event, CASE WHEN event LIKE 'fall%' THEN labor ELSE mlk END AS anchor FROM nation, hol, names WHERE NOT optional) g
        LEFT JOIN cal c USING (unitid, start_year, event) LEFT JOIN offs USING (unitid, event)),
    wide AS (SELECT unitid, start_year, max(date) FILTER (event = 'fall_classes_start') AS fs, max(date) FILTER (event = 'fall_exams_end') AS fe, max(date) FILTER (event = 'spring_classes_start') AS ss,
        max(date) FILTER (event = 'spring_exams_end') AS se, max(date) FILTER (event = 'spring_break_start') AS bs, max(date) FILTER (event = 'spring_break_end') AS be,
        max(status) FILTER (event = 'spring_break_start') AS st FROM complete GROUP BY ALL),
    wider AS (SELECT *, st <> 'none' AND (bs IS NULL OR be IS NULL) AS unknown, CASE WHEN st <> 'none' THEN CASE WHEN isodow(bs) = 1 THEN bs - 2 ELSE bs END END AS b0,
        CASE WHEN st <> 'none' THEN CASE WHEN isodow(be) = 5 THEN be + 2 ELSE be END END AS b1 FROM wide JOIN hol USING (start_year)),
    dayrows AS (SELECT *, unnest(generate_series(make_date(start_year, 8, 1), make_date(start_year + 1, 7, 31), INTERVAL 1 DAY))::DATE AS date FROM wider),
    sess AS (SELECT unitid, date,
        CASE WHEN date BETWEEN make_date(year(date), 6, 15) AND make_date(year(date), 8, 15) THEN false
            WHEN month(date) >= 8 THEN CASE WHEN fs IS NULL OR fe IS NULL THEN NULL WHEN date < fs OR date > fe THEN false ELSE NOT date BETWEEN thanks - 1 AND thanks + 3 END
            ELSE CASE WHEN ss IS NULL OR se IS NULL THEN NULL WHEN date < ss OR date > se THEN false WHEN unknown THEN NULL ELSE NOT coalesce(date BETWEEN b0 AND b1, false) END END AS in_session,
        CASE WHEN date BETWEEN make_date(year(date), 6, 15) AND make_date(year(date), 8, 15) THEN true WHEN month(date) >= 8 THEN date < fs ELSE date > se END AS summer_break FROM dayrows),
    wsess AS (SELECT date_trunc('week', date)::DATE AS week_start, unitid, CASE WHEN count(in_session) = count(*) THEN count(*) FILTER (in_session) END AS days_in_session,
        CASE WHEN count(summer_break) = count(*) THEN count(*) FILTER (summer_break) END AS summer_break_days FROM sess GROUP BY ALL HAVING count(*) = 7)
"""


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ebbtide.operators.calendars import complete_calendar

    units = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("unitid"))
    return complete_calendar(known_calendar(spark, sf_dir), units, FIRST_YEAR, LAST_YEAR)


def enrollment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Institution-years: customers' orders per nation and year stand for students."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
    years = joined.groupBy(F.col("c_nationkey").cast("string").alias("unitid"), F.year("o_orderdate").alias("fall_year")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_custkey") % 5 == 0).alias("distance_only"), F.count_distinct("o_custkey").alias("dorm_capacity")
    )
    return years.filter("fall_year between 1996 and 2000").withColumn("in_person", F.col("total") - F.col("distance_only"))


ENROLLMENT = """
    enr AS (SELECT *, total - distance_only AS in_person FROM (SELECT c_nationkey::VARCHAR AS unitid, year(o_orderdate) AS fall_year, count(*) AS total, count(*) FILTER (o_custkey % 5 = 0) AS distance_only,
        count(DISTINCT o_custkey) AS dorm_capacity FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) WHERE fall_year BETWEEN 1996 AND 2000)
"""
