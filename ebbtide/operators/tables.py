"""Composite tables that are asked for by name, and the jobs that write them."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ebbtide import config
from ebbtide.operators import events, presence, timeline
from ebbtide.operators.windows import deviations
from ebbtide.sources.files import write_months


def write_trip_months(layouts: list[DataFrame], folder: str) -> None:
    """One job over the months of all layouts: station-days and cleaning report, each written by month."""
    trips = reduce(DataFrame.unionByName, map(events.standardize, layouts))
    kept = events.clean(trips).withColumn("month", F.date_format("started_at", "yyyyMM"))
    write_months(events.station_day(kept).withColumn("month", F.date_format("date", "yyyyMM")), f"{folder}/station_day")
    write_months(events.cleaning_report(trips).filter("month is not null"), f"{folder}/report")


def load_station_days(in_month: DataFrame, spill: DataFrame) -> DataFrame:
    """Station-days of all months with the trips that no file had as its own."""
    return events.spread(in_month.unionByName(events.station_day(spill)), ["date", "station_id"]).groupBy("date", "station_id").agg(*(F.sum(c).alias(c) for c in events.COUNTS))


def directory(raw: DataFrame) -> DataFrame:
    """Institutions: beds are 0 without housing and null where not reported; in person is the total less the online students."""
    beds = F.when(F.col("room") == 2, 0).otherwise(F.col("capacity"))
    return raw.select("unitid", "name", "year", beds.alias("dorm_capacity"), F.col("total"), (F.col("total") - F.coalesce("distance_only", F.lit(0))).alias("in_person"))


def enrollment_table(levels: DataFrame, online: DataFrame, beds: DataFrame) -> DataFrame:
    """Levels as columns, absent ones 0, joined with online students and beds."""
    names = {"2": "undergraduate", "12": "graduate", "1": "total"}
    wide = levels.groupBy("unitid", "fall_year").pivot("level", list(names)).agg(F.sum("students")).fillna(0, list(names)).withColumnsRenamed(names)
    joined = wide.join(online, ["unitid", "fall_year"], "left").join(beds, ["unitid", "fall_year"], "left")
    return joined.withColumn("distance_only", F.coalesce("distance_only", F.lit(0))).withColumn("in_person", F.col("total") - F.col("distance_only"))


def campus_points(main: DataFrame, extra: DataFrame, enrollment: DataFrame, successors: dict[str, str], least: int = config.MAJOR_MIN_STUDENTS) -> DataFrame:
    """Main campuses and extra points; merged institutions' points belong to their successors."""
    moved = F.col("unitid")
    for old, new in successors.items():
        moved = F.when(F.col("unitid") == old, new).otherwise(moved)
    typical = enrollment.groupBy("unitid").agg(F.percentile("in_person", 0.5).alias("typical_in_person"))
    names = main.select("unitid", F.col("name").alias("institution"))
    points = main.select("unitid", "name", "lat", "lng", F.lit("main").alias("source")).unionByName(extra.select("unitid", "name", "lat", "lng", F.lit("extra").alias("source")))
    joined = points.withColumn("unitid", moved).join(names, "unitid").join(typical, "unitid", "left")
    return joined.withColumn("major", F.coalesce(F.col("typical_in_person") >= least, F.lit(False)))


def station_weeks(weekly: DataFrame, closed: DataFrame, stations: DataFrame, years: tuple[int, int]) -> DataFrame:
    """Usable station-weeks: whole weeks without a closed day, both kinds of day in use, within the years, at known stations."""
    year = F.year(timeline.thursday(F.col("week_start")))
    usable = weekly.filter("complete_week and weekday_entries > 0 and weekend_entries > 0").filter(year.between(*years))
    return usable.join(closed.filter("closed_days = 0").select("week_start", "stop_id"), ["week_start", "stop_id"]).join(stations.select("stop_id"), "stop_id", "left_semi")


def labelled_weeks(weeks: DataFrame, inputs: DataFrame, in_session: float = 0.1, summer: float = 0.8) -> DataFrame:
    """Weeks with almost all in session, or mostly summer; others go."""
    label = F.when(F.col("out") <= in_session, "in_session").when(F.col("summer") >= summer, "summer")
    return weeks.join(inputs.select("week_start", label.alias("period")), "week_start").filter("period is not null")


def panel_units(activity: DataFrame, session: DataFrame, calendar_units: DataFrame, least: int = config.MIN_PANEL_WEEKS, kind: int = config.MIN_KIND_WEEKS) -> DataFrame:
    """Unit-weeks with log activity and the share in session, of units with enough weeks of both kinds.

    A unit without a calendar of its own takes the weeks' mean share.
    """
    typical = session.groupBy("week_start").agg(F.avg("session_share").alias("__typical"))
    joined = activity.filter("activity > 0").join(calendar_units, "unit", "left").join(session.select("week_start", "unitid", "session_share"), ["week_start", "unitid"], "left").join(typical, "week_start")
    rows = joined.withColumns({"calendar": F.when(F.col("session_share").isNotNull(), "own").otherwise("typical"), "session_share": F.coalesce("session_share", "__typical"), "y": F.ln("activity")}).drop("__typical")
    unit = W.partitionBy("unit")
    enough = (F.count(F.lit(1)).over(unit) >= least) & (F.count_if(F.col("session_share") >= 0.5).over(unit) >= kind) & (F.count_if(F.col("session_share") < 0.5).over(unit) >= kind)
    return rows.withColumn("__keep", enough).filter("__keep").drop("__keep")


def signals(series: list[DataFrame]) -> DataFrame:
    """Weekly signals joined by week, every week of any kept, as deviations from their year's mean."""
    out = series[0]
    for other in series[1:]:
        out = out.join(other, "week_start", "full")
    names = [c for c in out.columns if c != "week_start"]
    return deviations(out.withColumn("year", F.year(timeline.thursday(F.col("week_start")))), names, ["year"])


def municipal_estimates(wide: DataFrame, pattern: str) -> DataFrame:
    """Year columns that match ``pattern`` as rows; the group gives the year."""
    found = {c: int(m[1]) for c in wide.columns if (m := re.fullmatch(pattern, c))}
    long = wide.unpivot("town", list(found), "__column", "population")
    years = F.create_map(*(F.lit(x) for pair in found.items() for x in pair))
    return long.select("town", F.try_element_at(years, F.col("__column")).alias("year"), "population")


def normal_calendar(inputs: DataFrame, first: Column, last: Column, typical: DataFrame) -> DataFrame:
    """Inputs with the weeks from ``first`` to ``last`` replaced by the typical ones of their week of the year."""
    week = timeline.week_of_year(F.col("week_start"))
    joined = inputs.withColumn("week_of_year", week).join(typical.select("week_of_year", F.col("out").alias("__typical")), "week_of_year", "left")
    changed = F.col("week_start").between(first, last)
    return joined.withColumn("out", F.when(changed, F.coalesce("__typical", "out")).otherwise(F.col("out"))).drop("__typical")


def forecast(weeks: DataFrame, enrollment: DataFrame, session: DataFrame) -> DataFrame:
    """The index for weeks ahead: inputs are held at their last published year."""
    return presence.presence_index(presence.apply_covid(presence.own_else_typical(presence.enrollment_by_week(weeks, enrollment), session)))


def splines(df: DataFrame, column: str, knots: list[float]) -> DataFrame:
    """Truncated-power basis of a column: itself, its square, and a ramp from each knot."""
    ramps = {f"{column}_k{n}": F.greatest(F.col(column) - k, F.lit(0.0)) for n, k in enumerate(knots)}
    return df.withColumns({f"{column}_2": F.col(column) * F.col(column), **ramps})


def run_step(spark: SparkSession, build: Callable[..., DataFrame], inputs: list[str], in_dir: str, out_dir: str, name: str) -> None:
    """Read tables by name, build one, and write it."""
    build(*(spark.read.parquet(f"{in_dir}/{table}") for table in inputs)).write.mode("overwrite").parquet(f"{out_dir}/{name}")



def trip_station_weeks(days: DataFrame, least_median: float = 20.0) -> DataFrame:
    """Station-days of trips in the layout of gate entries: weekday and weekend totals of station-years in steady use."""
    weekend = timeline.is_weekend(F.col("date"))
    weeks = days.filter("station_id is not null").groupBy(timeline.week_of(F.col("date")).alias("week_start"), F.col("station_id").alias("stop_id")).agg(
        F.coalesce(F.sum(F.when(~weekend, F.col("trips"))), F.lit(0)).alias("weekday_entries"), F.coalesce(F.sum(F.when(weekend, F.col("trips"))), F.lit(0)).alias("weekend_entries")
    )
    year = F.year(timeline.thursday(F.col("week_start")))
    usual = F.percentile(F.col("weekday_entries") + F.col("weekend_entries"), 0.5).over(W.partitionBy("stop_id", year))
    return weeks.withColumn("__usual", usual).filter(F.col("__usual") >= least_median).drop("__usual")


def institutions_in_area(yearly: DataFrame, placed: DataFrame, area: list[str]) -> DataFrame:
    """Institution-years located in the area that year, with the newest name and the span of years."""
    inside = yearly.join(placed.filter(F.col("municipality").isin(*area)).select("unitid", "year"), ["unitid", "year"], "left_semi")
    return inside.groupBy("unitid").agg(F.max_by("name", "year").alias("name"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def codes(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Dense codes from 0 of composite keys, for readers that need numbers; the keys are a short dimension."""
    numbered = df.select(*keys).distinct().withColumn(name, F.dense_rank().over(W.orderBy(*keys)) - 1)
    return df.join(numbered, keys)


def subset_scores(df: DataFrame, observed: str, models: list[str], baseline: str, subsets: dict[str, Column]) -> DataFrame:
    """RMSE of every model on every subset, with the change against the baseline in percent."""
    def rmse(model: str, rows: Column) -> Column:
        e = F.when(rows, F.col(observed) - F.col(model))
        return F.sqrt(F.avg(e * e))

    entries = [F.struct(F.lit(s).alias("subset"), F.lit(m).alias("model"), F.col(f"{s}__{m}").alias("rmse"), F.col(f"{s}__{baseline}").alias("base")) for s in subsets for m in models]
    wide = df.agg(*(rmse(m, rows).alias(f"{s}__{m}") for s, rows in subsets.items() for m in models))
    return wide.select(F.explode(F.array(*entries)).alias("r")).select("r.subset", "r.model", "r.rmse", (100 * (F.try_divide(F.col("r.rmse"), F.col("r.base")) - 1)).alias("change_percent"))
