"""Gate entries: station-days, closures by rolling medians, weekly totals, and daily weather."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ebbtide import config
from ebbtide.operators.timeline import is_weekend, week_of


def read_entries(raw: DataFrame) -> DataFrame:
    """Entries per day, stop and name from all-text periods; a stop id of "NA" or "" is missing."""
    stop = F.trim("stop_id")
    return (
        raw.select(
            F.substring("service_date", 1, 10).try_cast("date").alias("date"),
            F.when(~stop.isin("NA", ""), stop).alias("stop_id"),
            F.trim("station_name").alias("station_name"),
            F.col("gated_entries").try_cast("double").alias("entries"),
        )
        .groupBy("date", "stop_id", "station_name").agg(F.coalesce(F.sum("entries"), F.lit(0.0)).alias("entries"))
    )


def fill_stop_ids(rows: DataFrame) -> DataFrame:
    """A missing stop id comes from other rows of its station name (the smallest on a tie), else from the name itself."""
    known = rows.filter("stop_id is not null").groupBy("station_name").agg(F.mode("stop_id", True).alias("__known"))
    slug = F.concat(F.lit("name-"), F.regexp_replace(F.lower("station_name"), "[^a-z0-9]+", "-"))
    return rows.join(known, "station_name", "left").withColumn("stop_id", F.coalesce("stop_id", "__known", slug)).drop("__known")


def daily_entries(rows: DataFrame) -> DataFrame:
    """Lines and overlapping files of a stop summed and rounded; the smallest of its names."""
    return rows.groupBy("date", "stop_id").agg(F.min("station_name").alias("station_name"), F.round(F.sum("entries")).cast("long").alias("entries"))


def match_by_name(daily: DataFrame, stations: DataFrame) -> DataFrame:
    """Placeholder ids ("name-...") become the id of the only station of that name; rows are summed again."""
    unique = stations.groupBy(F.lower("api_name").alias("__name")).agg(F.count(F.lit(1)).alias("n"), F.min("stop_id").alias("__api")).filter("n = 1").drop("n")
    joined = daily.withColumn("__name", F.lower("station_name")).join(unique, "__name", "left")
    stop = F.when(F.col("stop_id").startswith("name-"), F.coalesce("__api", "stop_id")).otherwise(F.col("stop_id"))
    return joined.withColumn("stop_id", stop).groupBy("date", "stop_id").agg(F.min("station_name").alias("station_name"), F.sum("entries").alias("entries"))


def closed_days(daily: DataFrame, weeks: int = config.TYPICAL_WEEKS, share: float = config.CLOSED_SHARE) -> DataFrame:
    """Flag days on which a stop had less than ``share`` of its usual level, measured against the whole system that day.

    The usual level is the centred median over days of the same kind; frames
    count rows of the kind, and need enough of them.
    """
    kind = F.when(F.weekday("date") <= 4, "weekday").when(F.weekday("date") == 5, "saturday").otherwise("sunday")
    of_kind = W.partitionBy("stop_id", "__kind").orderBy("date")

    def typical(size: int, least: int):
        frame = of_kind.rowsBetween(-(size // 2), size // 2)
        return F.when(F.count("entries").over(frame) >= least, F.percentile("entries", 0.5).over(frame))

    usual = F.when(F.col("__kind") == "weekday", typical(5 * weeks, weeks)).otherwise(typical(weeks, weeks // 2 + 1))
    rated = daily.withColumn("__kind", kind).withColumn("__ratio", F.try_divide(F.col("entries"), usual))
    # per-date medians are over the stops of one system
    system = F.percentile("__ratio", 0.5).over(W.partitionBy("date"))
    flagged = rated.withColumn("closed", F.coalesce(F.col("__ratio") < share * system, F.lit(False)))
    return flagged.drop("__kind", "__ratio")


def weekly_closed_days(flagged: DataFrame) -> DataFrame:
    """Days of each stop's week without an open day's entries: closed, or missing."""
    return flagged.groupBy(week_of(F.col("date")).alias("week_start"), "stop_id").agg((7 - F.count_if(~F.col("closed"))).alias("closed_days"))


def weekly_entries(daily: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    weekend = is_weekend(F.col("date"))
    span = daily.agg(F.min("date").alias("__lo"), F.max("date").alias("__hi"))
    weekly = daily.groupBy(week_of(F.col("date")).alias("week_start"), *by).agg(
        F.sum("entries").alias("entries"),
        F.coalesce(F.sum(F.when(~weekend, F.col("entries"))), F.lit(0)).alias("weekday_entries"),
        F.coalesce(F.sum(F.when(weekend, F.col("entries"))), F.lit(0)).alias("weekend_entries"),
        F.count_distinct("date").alias("days_with_data"),
    )
    complete = (F.col("week_start") >= F.col("__lo")) & (F.date_add("week_start", 6) <= F.col("__hi"))
    return weekly.crossJoin(F.broadcast(span)).withColumn("complete_week", complete).drop("__lo", "__hi")


def latest_names(daily: DataFrame) -> DataFrame:
    """Each stop's last known name, span and total."""
    return daily.groupBy("stop_id").agg(
        F.max_by("station_name", "date").alias("station_name"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.sum("entries").alias("total_entries")
    )


def weather_weekly(days: DataFrame) -> DataFrame:
    """Weekly means, sums and days beyond a threshold."""
    return days.groupBy(week_of(F.col("date")).alias("week_start")).agg(
        F.avg("temp_c").alias("mean_temp_c"), F.sum("rain_mm").alias("rain_mm"), F.sum("snow_mm").alias("snow_mm"), F.avg("wind_ms").alias("wind_ms"),
        F.count_if(F.col("rain_mm") >= config.RAIN_MM).alias("rain_days"), F.count_if(F.col("rain_mm") >= config.HEAVY_RAIN_MM).alias("heavy_rain_days"),
        F.count_if(F.col("snow_mm") >= config.SNOW_MM).alias("snow_days"), F.count_if(F.col("temp_min_c") < config.ICE_C).alias("ice_days"),
        F.count_if(F.col("temp_max_c") >= config.HOT_C).alias("hot_days"), (F.count(F.lit(1)) == 7).alias("complete_week"),
    )


def weather_by_day_type(days: DataFrame) -> DataFrame:
    """Means and shares of days with a condition, weekdays and weekends apart."""
    conditions = {"rain": F.col("rain_mm") >= config.RAIN_MM, "snow": F.col("snow_mm") >= config.SNOW_MM, "ice": F.col("temp_min_c") < config.ICE_C, "hot": F.col("temp_max_c") >= config.HOT_C}
    return days.groupBy(week_of(F.col("date")).alias("week_start"), F.when(is_weekend(F.col("date")), "weekend").otherwise("weekday").alias("day")).agg(
        F.avg("temp_c").alias("temp_c"), *(F.avg(c.cast("double")).alias(f"{n}_share") for n, c in conditions.items())
    )
