"""Academic calendars: checks, estimates, and three-valued session days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ebbtide import config
from ebbtide.operators.timeline import nth_weekday, week_of

EVENTS = config.FALL_EVENTS + config.SPRING_EVENTS


def event_rank(event: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, EVENTS)), event).cast("int")


def anchor(event: Column, start_year: Column) -> Column:
    """Labor Day for fall events, Martin Luther King Day for spring events."""
    fall = event.isin(*config.FALL_EVENTS)
    return F.when(fall, nth_weekday(start_year, 9, "MON", 1)).otherwise(nth_weekday(start_year + 1, 1, "MON", 3))


def order_problems(calendar: DataFrame) -> DataFrame:
    """Events that come before an earlier event of their academic year."""
    year = W.partitionBy("unitid", "start_year").orderBy(event_rank(F.col("event")))
    dated = calendar.filter("date is not null").withColumns({"before": F.lag("event").over(year), "before_date": F.lag("date").over(year)})
    return dated.filter("date < before_date").select("unitid", "start_year", "event", "date", "before", "before_date")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def not_allowed(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Values of a column, with their number, that aren't among the allowed ones; null isn't."""
    return df.filter(~F.coalesce(F.col(column).isin(*allowed), F.lit(False))).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def missing_members(df: DataFrame, column: str, expected: DataFrame) -> DataFrame:
    """Expected values that a column lacks."""
    return expected.join(df.select(column).distinct(), column, "left_anti")


def problems(manual: DataFrame) -> DataFrame:
    """All problems of hand-collected rows of text, one row each."""
    year, end = F.substring("academic_year", 1, 4).try_cast("int"), F.substring("academic_year", 6, 2).try_cast("int")
    day = F.col("date").try_cast("date")
    none = F.col("date") == "none"
    fall = F.col("event").isin(*config.FALL_EVENTS)
    term = F.when(fall, F.year(day) != year).otherwise(F.year(day) != year + 1)
    rules = [
        (~F.col("event").isin(*EVENTS), "unknown event"),
        (F.coalesce(year.isNull() | end.isNull() | (F.pmod(year + 1, F.lit(100)) != end), F.lit(True)), "bad academic year"),
        (~none & ~F.coalesce(F.col("source_url").startswith("http"), F.lit(False)), "missing source URL"),
        (~none & day.isNull(), "bad date"),
        (day.isNotNull() & (F.date_format(day, "EEEE") != F.col("weekday")), "weekday does not match"),
        (day.isNotNull() & term, "date outside the term's year"),
        (none & (F.coalesce(F.trim("note"), F.lit("")) == ""), "none needs a note"),
    ]
    found = F.array_compact(F.array(*(F.when(rule, message) for rule, message in rules)))
    return manual.select("unitid", "academic_year", "event", F.explode(found).alias("problem"))


def offsets(verified: DataFrame) -> DataFrame:
    """Lower median of days from the anchor holiday, per unit and event."""
    days = verified.withColumn("__days", F.datediff("date", anchor(F.col("event"), F.col("start_year"))))
    return days.groupBy("unitid", "event").agg(
        F.expr("percentile_disc(0.5) within group (order by __days)").cast("int").alias("offset_days"), F.count(F.lit(1)).alias("n_years")
    )


def complete_calendar(known: DataFrame, units: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Every unit, year and event: verified, none, estimated from other years, or missing.

    Optional events are completed only for units that record them.
    """
    spark = known.sparkSession
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("start_year"))
    names = spark.createDataFrame([(e, e in config.OPTIONAL_EVENTS) for e in EVENTS], "event string, optional boolean")
    grid = units.select("unitid").distinct().crossJoin(F.broadcast(years.crossJoin(names)))  # units by a fixed number of years and events
    recorded = known.select("unitid", "event").distinct().withColumn("recorded", F.lit(True))
    usual = offsets(known.filter("status = 'verified'"))
    rows = (
        grid.join(recorded, ["unitid", "event"], "left").filter("not optional or recorded")
        .join(known.select("unitid", "start_year", "event", "date", "status"), ["unitid", "start_year", "event"], "left")
        .join(usual, ["unitid", "event"], "left")
    )
    estimate = F.date_add(anchor(F.col("event"), F.col("start_year")), F.col("offset_days"))
    return rows.select(
        "unitid", "start_year", "event",
        F.when(F.col("status").isNotNull(), F.col("date")).otherwise(estimate).alias("date"),
        F.coalesce("status", F.when(F.col("offset_days").isNotNull(), "estimated"), F.lit("missing")).alias("status"),
    )


def leave_one_out_errors(verified: DataFrame) -> DataFrame:
    """Absolute error in days of each verified date's estimate from the unit's other years."""
    days = verified.withColumn("offset", F.datediff("date", anchor(F.col("event"), F.col("start_year"))))
    other = days.select(F.col("unitid").alias("u"), F.col("event").alias("e"), F.col("start_year").alias("y"), F.col("offset").alias("o"))
    pairs = days.join(other, (F.col("unitid") == F.col("u")) & (F.col("event") == F.col("e")) & (F.col("start_year") != F.col("y")))
    usual = pairs.groupBy("unitid", "event", "start_year", "offset").agg(F.expr("percentile_disc(0.5) within group (order by o)").cast("int").alias("guess"))
    return usual.select("unitid", "event", "start_year", F.abs(F.col("guess") - F.col("offset")).alias("error_days"))


def widen_to_weekend(start: Column, end: Column) -> tuple[Column, Column]:
    """A Monday start takes the weekend before, a Friday end the one behind."""
    return F.when(F.weekday(start) == 0, F.date_sub(start, 2)).otherwise(start), F.when(F.weekday(end) == 4, F.date_add(end, 2)).otherwise(end)


def is_summer(day: Column) -> Column:
    """Mid-June to mid-August."""
    return day.between(F.make_date(F.year(day), F.lit(6), F.lit(15)), F.make_date(F.year(day), F.lit(8), F.lit(15)))


def terms(calendar: DataFrame) -> DataFrame:
    """One row per unit and academic year with its dates, and whether a spring break's dates are unknown."""
    def date_of(event: str) -> Column:
        return F.max(F.when(F.col("event") == event, F.col("date")))

    def status_of(event: str) -> Column:
        return F.max(F.when(F.col("event") == event, F.col("status")))

    wide = calendar.groupBy("unitid", "start_year").agg(
        *(date_of(e).alias(e) for e in EVENTS), *(status_of(f"{b}_start").alias(f"{b}_status") for b in ("february_break", "spring_break"))
    )
    unknown = F.lit(False)
    for b in ("february_break", "spring_break"):
        exists = F.col(f"{b}_status").isNotNull() & (F.col(f"{b}_status") != "none")
        unknown = unknown | (exists & (F.col(f"{b}_start").isNull() | F.col(f"{b}_end").isNull()))
        start, end = widen_to_weekend(F.col(f"{b}_start"), F.col(f"{b}_end"))
        known = exists & F.col(f"{b}_start").isNotNull() & F.col(f"{b}_end").isNotNull()
        wide = wide.withColumns({f"{b}_from": F.when(known, start), f"{b}_to": F.when(known, end)})
    return wide.withColumn("breaks_unknown", unknown)


def session_days(calendar: DataFrame) -> DataFrame:
    """Per unit and day, whether classes are in session and whether it is summer break; null is unknown.

    Summer counts from the day after spring exams to the day before fall classes.
    """
    year = F.col("start_year")
    term = F.explode(F.array(
        F.struct(F.lit("fall").alias("term"), F.make_date(year, F.lit(8), F.lit(1)).alias("a"), F.make_date(year, F.lit(12), F.lit(31)).alias("b")),
        F.struct(F.lit("spring").alias("term"), F.make_date(year + 1, F.lit(1), F.lit(1)).alias("a"), F.make_date(year + 1, F.lit(7), F.lit(31)).alias("b")),
    ))
    fall = F.col("term") == "fall"
    rows = terms(calendar).select("*", term.alias("t")).select("*", "t.*").select("*", F.explode(F.sequence("a", "b")).alias("date"))
    start = F.when(fall, F.col("fall_classes_start")).otherwise(F.col("spring_classes_start"))
    end = F.when(fall, F.col("fall_exams_end")).otherwise(F.col("spring_exams_end"))
    day = F.col("date")
    thanksgiving = nth_weekday(year, 11, "THU", 4)
    off = F.when(fall, day.between(F.date_sub(thanksgiving, 1), F.date_add(thanksgiving, 3))).otherwise(
        F.coalesce(day.between(F.col("february_break_from"), F.col("february_break_to")), F.lit(False)) | F.coalesce(day.between(F.col("spring_break_from"), F.col("spring_break_to")), F.lit(False))
    )
    status = (
        F.when(is_summer(day), F.lit(False)).when(start.isNull() | end.isNull(), F.lit(None).cast("boolean")).when((day < start) | (day > end), F.lit(False))
        .when(~fall & F.col("breaks_unknown"), F.lit(None).cast("boolean")).otherwise(~off)
    )
    edge = F.when(fall, start).otherwise(end)
    summer = F.when(is_summer(day), F.lit(True)).when(edge.isNull(), F.lit(None).cast("boolean")).otherwise(F.when(fall, day < edge).otherwise(day > edge))
    return rows.select("unitid", "date", status.alias("in_session"), summer.alias("summer_break"))


def weekly_session(days: DataFrame) -> DataFrame:
    """Days in session and of summer break in whole weeks; null if any day is unknown."""
    def whole(c: str) -> Column:
        return F.when(F.count(c) == F.count(F.lit(1)), F.count_if(c))

    weekly = days.groupBy(week_of(F.col("date")).alias("week_start"), "unitid").agg(
        whole("in_session").alias("days_in_session"), whole("summer_break").alias("summer_break_days"), F.count(F.lit(1)).alias("n")
    )
    return weekly.filter("n = 7").drop("n")


def verified_weeks(weekly: DataFrame, calendar: DataFrame, fall_year: Column) -> DataFrame:
    """Weeks of academic years without any estimated date but commencement."""
    guessed = calendar.filter("status = 'estimated' and event <> 'commencement'").select("unitid", F.col("start_year").alias("__year")).distinct()
    return weekly.withColumn("__year", fall_year).join(guessed, ["unitid", "__year"], "left_anti").drop("__year")
