"""The Monday-to-Sunday timeline: weeks, holidays and calendar expressions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide import config


def week_of(day: Column) -> Column:
    """The Monday on or before a day."""
    return F.trunc(day, "week")


def thursday(week: Column) -> Column:
    """The day that decides which month and year a week mostly falls in."""
    return F.date_add(week, 3)


def is_weekend(day: Column) -> Column:
    return F.weekday(day) >= 5


def fall_year(week: Column) -> Column:
    """Fall term a week belongs to: from August on its own year, else the year before."""
    day = thursday(week)
    return F.year(day) - (F.month(day) < 8).cast("int")


def nth_weekday(year: Column, month: int, weekday: str, nth: int) -> Column:
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(F.next_day(F.date_sub(first, 1), weekday), 7 * (nth - 1))


def last_weekday(year: Column, month: int, weekday: str) -> Column:
    end = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    return F.next_day(F.date_sub(end, 7), weekday)


def _fixed(year: Column, month: int, day: int) -> Column:
    return F.make_date(year, F.lit(month), F.lit(day))


def _observed(day: Column) -> Column:
    """Weekday on which a fixed holiday is kept: Friday for a Saturday, Monday for a Sunday."""
    return F.when(F.weekday(day) == 5, F.date_sub(day, 1)).when(F.weekday(day) == 6, F.date_add(day, 1))


def holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """(date, name) of US federal and Massachusetts holidays, with the observed days of fixed ones."""
    year = F.col("year").cast("int")
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    fixed = {
        "New Year's Day": (_fixed(year, 1, 1), 0), "Juneteenth National Independence Day": (_fixed(year, 6, 19), 2021), "Independence Day": (_fixed(year, 7, 4), 0),
        "Veterans Day": (_fixed(year, 11, 11), 0), "Christmas Day": (_fixed(year, 12, 25), 0),
    }
    moving = {
        "Martin Luther King Jr. Day": nth_weekday(year, 1, "MON", 3), "Washington's Birthday": nth_weekday(year, 2, "MON", 3), "Patriots' Day": nth_weekday(year, 4, "MON", 3),
        "Memorial Day": last_weekday(year, 5, "MON"), "Labor Day": nth_weekday(year, 9, "MON", 1), "Columbus Day": nth_weekday(year, 10, "MON", 2), "Thanksgiving Day": nth_weekday(year, 11, "THU", 4),
    }
    entries = [F.struct(F.when(year >= since, day).alias("date"), F.lit(name).alias("name")) for name, (day, since) in fixed.items()]
    entries += [F.struct(F.when(year >= since, _observed(day)).alias("date"), F.lit(f"{name} (observed)").alias("name")) for name, (day, since) in fixed.items()]
    entries += [F.struct(day.alias("date"), F.lit(name).alias("name")) for name, day in moving.items()]
    return years.select(F.explode(F.array(*entries)).alias("h")).select("h.date", "h.name").filter("date is not null")


def build_weeks(spark: SparkSession, start: date = config.STUDY_START, end: date = config.STUDY_END) -> DataFrame:
    """One row per week that covers [start, end], with ISO labels and holidays."""
    span = spark.range(1).select(F.explode(F.sequence(week_of(F.lit(start)), week_of(F.lit(end)), F.expr("interval 7 days"))).alias("week_start"))
    kept = holidays(spark, start.year - 1, end.year + 1).groupBy(week_of(F.col("date")).alias("week_start")).agg(
        F.count(F.lit(1)).alias("n_holidays"), F.array_join(F.array_sort(F.collect_list(F.struct("date", "name")))["name"], "; ").alias("holiday_names")
    )
    weeks = span.join(F.broadcast(kept), "week_start", "left")  # a row per holiday week of the study
    return weeks.select(
        "week_start",
        F.date_add("week_start", 6).alias("week_end"),
        F.extract(F.lit("YEAROFWEEK"), F.col("week_start")).cast("int").alias("iso_year"),
        F.weekofyear("week_start").alias("iso_week"),
        F.month(thursday(F.col("week_start"))).alias("month"),
        F.coalesce("n_holidays", F.lit(0)).alias("n_holidays"),
        F.coalesce("holiday_names", F.lit("")).alias("holiday_names"),
    )


def year_end_week(week: Column) -> Column:
    """Whether the week has a day from December 24 to January 1."""
    end, year = F.date_add(week, 6), F.year(week)
    return (end >= F.make_date(year, F.lit(12), F.lit(24))) | (week <= F.make_date(year, F.lit(1), F.lit(1)))


def break_kind(week: Column) -> Column:
    month = F.month(thursday(week))
    return F.when(month == 11, "thanksgiving").when(month.isin(12, 1), "winter").otherwise("spring")


def covid_period(week: Column) -> Column:
    """lockdown, remote_year or normal, by the week's Thursday."""
    day = thursday(week)
    return (
        F.when(day.between(F.lit(config.COVID_START), F.lit(config.COVID_END)), "lockdown")
        .when((day > F.lit(config.COVID_END)) & (day <= F.lit(config.COVID_YEAR_END)), "remote_year")
        .otherwise("normal")
    )


def covid_term(week: Column) -> Column:
    day = thursday(week)
    return F.when((day > F.lit(config.COVID_END)) & (day <= F.lit(date(2020, 12, 31))), "fall_2020").when(
        day.between(F.lit(date(2021, 1, 1)), F.lit(config.COVID_YEAR_END)), "spring_2021"
    )


def harmonics(week: Column, orders: int = 2) -> dict[str, Column]:
    """Sine and cosine of the week's place in the year."""
    angle = (F.dayofyear(thursday(week)) - 1) * (2 * F.pi() / 365.25)
    return {f"{name}_{k}": wave(angle * k) for k in range(1, orders + 1) for name, wave in (("sin", F.sin), ("cos", F.cos))}


def week_of_year(week: Column) -> Column:
    """Week number from 0; the days left over belong to week 51."""
    return F.least(F.floor((F.dayofyear(thursday(week)) - 1) / 7), F.lit(51)).cast("int")


def week_of_academic_year(week: Column) -> Column:
    """Weeks since the week of August 1."""
    return F.floor(F.datediff(thursday(week), F.make_date(fall_year(week), F.lit(8), F.lit(1))) / 7).cast("int")


def reference_day(day: Column) -> Column:
    """The day in one reference academic year, so that years overlay."""
    return F.make_date(F.when(F.month(day) >= 8, 2003).otherwise(2004), F.month(day), F.day(day))


def academic_year_label(start_year: Column) -> Column:
    return F.format_string("%d-%02d", start_year, F.pmod(start_year + 1, F.lit(100)))


def missing_dates(df: DataFrame, day: str) -> DataFrame:
    """Days between a table's first and last that it doesn't have."""
    span = df.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).filter("lo is not null")
    return span.select(F.explode(F.sequence("lo", "hi")).alias(day)).join(df.select(day).distinct(), day, "left_anti")


def coverage_bounds(months: DataFrame, month: str = "month") -> DataFrame:
    """First and last day covered by monthly files named yyyyMM."""
    first = F.to_date(F.concat(F.min(month), F.lit("01")), "yyyyMMdd")
    return months.agg(first.alias("first_day"), F.last_day(F.to_date(F.concat(F.max(month), F.lit("01")), "yyyyMMdd")).alias("last_day"))
