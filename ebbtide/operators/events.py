"""Trip events: layouts, cleaning, station-days, stations and weekly totals."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide import config
from ebbtide.operators.timeline import week_of
from ebbtide.plans.scratch import materialize

COUNTS = ("trips", "member_trips", "casual_trips", "classic_trips", "electric_trips", "age_known_trips", "college_age_trips")
REASONS = ("bad_time", "too_short", "too_long", "non_public_station")


#: Rows of a task that holds a group for almost every row: about 250 MB of groups.
TASK_ROWS = 400_000


def spread(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows``, written once, over as many partitions by ``keys`` as keep them to about ``TASK_ROWS`` rows.

    For groupings that leave almost as many groups as rows: the session's number of shuffle partitions is fixed, so
    there a task's groups would grow with the input.  A group's rows meet in one task, uncombined.
    """
    held = materialize(rows, "spread")
    parts = -(-held.count() // TASK_ROWS)
    return held.repartition(parts, *keys) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else held


def detect_layout(columns: list[str]) -> str:
    """Name of a raw file's layout by the columns it must have."""
    for layout, needed in (("modern", {"ride_id", "started_at", "member_casual"}), ("legacy", {"tripduration", "starttime", "usertype"})):
        if needed <= set(columns):
            return layout
    raise ValueError(f"no known trip layout has these columns: {columns}")


def _mapped(column: Column, names: dict[str, str], default: str = "other") -> Column:
    pairs = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.try_element_at(pairs, column), F.lit(default))


def parse_time(column: Column) -> Column:
    """Clock time to the second; fractions are cut, bad text is null."""
    text = F.substring(column, 1, 19)
    return F.when(F.length(text) == 19, text.try_cast("timestamp_ntz"))


def standardize(raw: DataFrame) -> DataFrame:
    """Either raw layout, all text, as typed trips; daylight-saving fall-backs are mended."""
    layout = detect_layout(raw.columns)
    if layout == "legacy":
        rows = raw.withColumnsRenamed(config.LEGACY_RENAME)
        rows = rows.withColumns(
            {
                "trip_key": F.concat_ws("|", F.col("started_at"), F.col("bikeid"), F.col("start_station_id")),
                "rider_type": _mapped(F.col("rider_type"), config.LEGACY_RIDER),
                "bike_type": F.lit("classic"),
                "birth_year": F.col("birth year") if "birth year" in raw.columns else F.lit(None).cast("string"),
            }
        )
        rows = rows.withColumn("trip_key", F.when(F.col("started_at").isNotNull() & F.col("bikeid").isNotNull() & F.col("start_station_id").isNotNull(), F.col("trip_key")))
    else:
        rows = raw.withColumns(
            {"trip_key": F.col("ride_id"), "rider_type": F.col("member_casual"), "bike_type": _mapped(F.col("rideable_type"), config.MODERN_BIKE), "birth_year": F.lit(None).cast("string")}
        )

    def named(c: str) -> Column:
        return F.nullif(F.trim(F.col(c)), F.lit("")).alias(c)

    # a generator of one row: filters on the times can't be pushed below it, where every mention of a time would parse it again
    times = F.struct(parse_time(F.col("started_at")).alias("__begin"), parse_time(F.col("ended_at")).alias("__end"))
    typed = rows.select("*", F.inline(F.array(times))).select(
        "trip_key", F.col("__begin").alias("started_at"), F.col("__end").alias("ended_at"),
        named("start_station_id"), named("start_station_name"), F.col("start_lat").try_cast("double").alias("start_lat"), F.col("start_lng").try_cast("double").alias("start_lng"),
        named("end_station_id"), named("end_station_name"), F.lower("rider_type").alias("rider_type"), "bike_type", F.col("birth_year").try_cast("long").alias("birth_year"),
    )
    seconds = F.timestamp_diff("SECOND", F.col("started_at"), F.col("ended_at"))
    start = F.col("started_at")
    fell_back = seconds.between(-3600, -1) & (F.month(start) == 11) & (F.weekday(start) == 6) & (F.day(start) <= 7)
    return typed.withColumns({"duration_s": F.when(fell_back, seconds + 3600).otherwise(seconds), "layout": F.lit(layout)})


def rider_age(start: Column, birth_year: Column) -> Column:
    age = F.year(start) - birth_year
    return F.when(~birth_year.isin(*config.PLACEHOLDER_BIRTH_YEARS) & age.between(*config.VALID_AGE), age)


def reject_reason() -> Column:
    """The first reason against a trip, or null."""
    def private(c: str) -> Column:
        return F.coalesce(F.col(c).rlike(config.NON_PUBLIC_STATION), F.lit(False))

    return (
        F.when(F.col("started_at").isNull() | F.col("ended_at").isNull() | (F.col("duration_s") < 0), REASONS[0])
        .when(F.col("duration_s") < config.MIN_DURATION_S, REASONS[1])
        .when(F.col("duration_s") > config.MAX_DURATION_S, REASONS[2])
        .when(private("start_station_name") | private("end_station_name"), REASONS[3])
    )


def clean(trips: DataFrame) -> DataFrame:
    return trips.filter(reject_reason().isNull())


def cleaning_report(trips: DataFrame) -> DataFrame:
    """Per month of start: raw rows, rows charged to each reason in order, kept rows and kept rows without a start station; one pass."""
    reason = F.col("reason")
    counted = trips.withColumn("reason", reject_reason()).groupBy(F.date_format("started_at", "yyyyMM").alias("month")).agg(
        F.count(F.lit(1)).alias("rows_raw"),
        *(F.count_if(reason == r).alias(f"rows_{r}") for r in REASONS),
        F.count_if(reason.isNull()).alias("rows_kept"),
        F.count_if(reason.isNull() & F.col("start_station_id").isNull()).alias("rows_no_start_station"),
    )
    return counted


def month_records(trips: DataFrame, month: str = "month") -> DataFrame:
    """One record per file month: layout, the cleaning waterfall, rows started out of the month, first and last start, stations.

    ``month`` (yyyyMM) names the file a trip came in.  All counts merge from partial ones; stations are counted
    over the distinct (month, station) pairs, so a month's trips are never gathered.  The waterfall counts every
    row; first and last start and the stations are of kept rows, the stations of those started in the month.
    """
    judged = trips.withColumn("reason", reject_reason())
    kept, inside = F.col("reason").isNull(), F.date_format("started_at", "yyyyMM") == F.col(month)
    reasons = [F.count_if(F.col("reason") == r).alias(f"rows_{r}") for r in REASONS]
    per = judged.groupBy(month, "layout", F.when(kept & inside, F.col("start_station_id")).alias("station")).agg(
        F.count(F.lit(1)).alias("rows_raw"), *reasons, F.count_if(kept).alias("rows_kept"), F.count_if(kept & F.col("start_station_id").isNull()).alias("rows_no_start_station"),
        F.count_if(kept & ~F.coalesce(inside, F.lit(False))).alias("rows_out_of_month"),
        F.min(F.when(kept, F.col("started_at"))).alias("first_start"), F.max(F.when(kept, F.col("started_at"))).alias("last_start"),
    )
    counts = ["rows_raw", *(f"rows_{r}" for r in REASONS), "rows_kept", "rows_no_start_station", "rows_out_of_month"]
    # a station that shows in both layouts of a month counts once
    stations = per.groupBy(month, "station").agg(*(F.sum(c).alias(c) for c in counts), F.min("first_start").alias("first_start"), F.max("last_start").alias("last_start"), F.min("layout").alias("low"), F.max("layout").alias("high"))
    layout = F.when(F.min("low") == F.max("high"), F.min("low")).otherwise(F.lit("mixed"))
    return stations.groupBy(month).agg(layout.alias("layout"), *(F.sum(c).alias(c) for c in counts), F.min("first_start").alias("first_start"), F.max("last_start").alias("last_start"), F.count("station").alias("n_stations"))


def station_day(trips: DataFrame) -> DataFrame:
    """Counts per start day and station; trips without a station stay under a null one."""
    marks = trips.select(F.to_date("started_at").alias("date"), F.col("start_station_id").alias("station_id"), "rider_type", "bike_type", rider_age(F.col("started_at"), F.col("birth_year")).alias("age"))
    return spread(marks, ["date", "station_id"]).groupBy("date", "station_id").agg(
        F.count(F.lit(1)).alias("trips"),
        F.count_if(F.col("rider_type") == "member").alias("member_trips"),
        F.count_if(F.col("rider_type") == "casual").alias("casual_trips"),
        F.count_if(F.col("bike_type") == "classic").alias("classic_trips"),
        F.count_if(F.col("bike_type") == "electric").alias("electric_trips"),
        F.count("age").alias("age_known_trips"),
        F.count_if(F.col("age").between(*config.COLLEGE_AGE)).alias("college_age_trips"),
    )


def stations(trips: DataFrame) -> DataFrame:
    """Usual name (the smallest on a tie), median place, trips and span of each start station."""
    return trips.filter("start_station_id is not null").groupBy(F.col("start_station_id").alias("station_id")).agg(
        F.mode("start_station_name", True).alias("station_name"),
        F.percentile("start_lat", 0.5).alias("lat"), F.percentile("start_lng", 0.5).alias("lng"),
        F.count(F.lit(1)).alias("trips"), F.to_date(F.min("started_at")).alias("first_date"), F.to_date(F.max("started_at")).alias("last_date"),
    )


def combine_stations(months: DataFrame) -> DataFrame:
    """One row per station over all months, with name and place of its busiest month (the earliest on a tie)."""
    best = F.max_by(F.struct("station_name", "lat", "lng"), F.struct("trips", -F.unix_date("first_date")))
    return months.groupBy("station_id").agg(
        best.alias("at"), F.sum("trips").alias("total_trips"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date")
    ).select("station_id", "at.station_name", "at.lat", "at.lng", "total_trips", "first_date", "last_date")


def month_part(started: Column, month: Column) -> Column:
    """inside, edge (inside and within 48 hours of a bound) or spill, of a trip in the file of ``month`` (yyyyMM)."""
    first = F.concat(F.substring(month, 1, 4), F.lit("-"), F.substring(month, 5, 2), F.lit("-01")).cast("date").cast("timestamp_ntz")
    end = F.add_months(first, 1).cast("timestamp_ntz")
    margin = F.expr(f"interval {config.EDGE_HOURS} hours")
    inside = (started >= first) & (started < end)
    return F.when(~inside, "spill").when((started < first + margin) | (started >= end - margin), "edge").otherwise("inside")


def unseen_spill(files: DataFrame) -> DataFrame:
    """Trips outside their file's month that no file counts as its own; one row per key, the smallest start.

    One pass: a key's spilled and edge rows meet in one aggregate.  A null key is no trip's, so no edge row is its own.
    """
    parts = files.select("trip_key", "started_at", month_part(F.col("started_at"), F.col("month")).alias("part")).filter(F.col("part").isin("spill", "edge"))
    spill = F.min(F.when(F.col("part") == "spill", F.col("started_at")))
    keys = parts.groupBy("trip_key").agg(spill.alias("started_at"), F.bool_or(F.col("part") == "edge").alias("__edge"))
    return keys.filter(F.col("started_at").isNotNull() & (F.col("trip_key").isNull() | ~F.col("__edge"))).drop("__edge")


def build_weekly(days: DataFrame, coverage_start: date | Column, coverage_end: date | Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Weekly totals, network size and trips per active station.

    Two levels: the network's size is the mean over days of the stations in
    use, so a station that changes its id within a week isn't counted twice.
    """
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (coverage_start, coverage_end))
    daily = days.groupBy("date", *by).agg(
        *(F.sum(c).alias(c) for c in COUNTS),
        F.coalesce(F.sum(F.when(F.col("station_id").isNull(), F.col("trips"))), F.lit(0)).alias("no_station_trips"),
        F.count_distinct("station_id").alias("active_stations"),
    )
    weekly = daily.groupBy(week_of(F.col("date")).alias("week_start"), *by).agg(
        F.count(F.lit(1)).alias("days_with_data"), *(F.sum(c).alias(c) for c in (*COUNTS, "no_station_trips")), F.avg("active_stations").alias("avg_daily_active_stations")
    )
    return weekly.withColumns(
        {
            "complete_week": (F.col("week_start") >= low) & (F.date_add("week_start", 6) <= high),
            "trips_per_active_station": F.try_divide(F.col("trips") - F.col("no_station_trips"), F.col("avg_daily_active_stations")),
            "college_age_share": F.try_divide("college_age_trips", "age_known_trips"),
        }
    )


def member_ages(trips: DataFrame) -> DataFrame:
    """Members' trips by week, day kind and age band."""
    age = rider_age(F.col("started_at"), F.col("birth_year"))
    day = F.to_date("started_at")
    return trips.filter("rider_type = 'member'").groupBy(week_of(day).alias("week_start"), F.when(F.weekday(day) >= 5, "weekend").otherwise("weekday").alias("day")).agg(
        F.count(age).alias("known"), F.count_if(age.between(18, 24)).alias("age_18_24"), F.count_if(age.between(25, 34)).alias("age_25_34"), F.count_if(age >= 35).alias("age_35_up")
    )
