"""Scenario and forecast inputs: pure functions over weekly tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ebbtide.operators import presence
from ebbtide.operators.timeline import break_kind, fall_year


def weekly_inputs(weeks: DataFrame) -> DataFrame:
    """Shares out of session, split into summer and breaks, and breaks by kind."""
    out = 1 - F.col("presence_index")
    summer = F.least(F.col("summer_break_share"), out)
    breaks = F.when(out - summer > 1e-12, out - summer).otherwise(0.0)  # less is rounding
    kind = break_kind(F.col("week_start"))
    return weeks.select(
        "week_start", out.alias("out"), summer.alias("summer"), breaks.alias("breaks"),
        *(F.when(kind == k, breaks).otherwise(0.0).alias(k) for k in ("thanksgiving", "winter", "spring")),
    )


def with_changes(inputs: DataFrame, value: str = "out") -> DataFrame:
    """Change of the index to the week before and the week after, and the value one week earlier."""
    # the study's few hundred weeks
    ordered = W.orderBy("week_start")
    return inputs.withColumns({"from_previous": F.col(value) - F.lag(value).over(ordered), "to_next": F.lead(value).over(ordered) - F.col(value), "lag_1": F.lag(value).over(ordered)})


def away(inputs: DataFrame, summer_share: Column, break_share: Column, residents: Column, least: Column, most: Column) -> Column:
    """Students away: clipped shares of the resident students, within the possible range."""
    def unit(x: Column) -> Column:
        return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))

    raw = residents * (unit(summer_share) * F.col("summer") + unit(break_share) * F.col("breaks"))
    return F.least(F.greatest(raw, least), most)


def scale_students(arrangements: DataFrame, change: float) -> DataFrame:
    """More or fewer students: housing and elsewhere scale, those with parents stay, the total follows."""
    scaled = {c: F.col(c) * (1 + change) for c in ("in_university_housing", "elsewhere")}
    return arrangements.withColumns(scaled).withColumn("college_students", F.col("in_university_housing") + F.col("elsewhere") + F.col("with_parents"))


def against_baseline(scenarios: DataFrame, baseline: DataFrame, value: str, key: str = "week_start") -> DataFrame:
    """Difference of every scenario's weeks from the baseline's."""
    base = baseline.select(key, F.col(value).alias("__base"))
    return scenarios.join(base, key).withColumn("change", F.col(value) - F.col("__base")).drop("__base")


def summary(changes: DataFrame, value: str, by: str = "scenario", key: str = "week_start") -> DataFrame:
    """Mean, lowest week and its date, largest change and number of changed weeks per scenario."""
    return changes.groupBy(by).agg(
        F.avg(value).alias("mean"), F.min(value).alias("lowest"), F.min_by(key, F.struct(value, key)).alias("lowest_week"),
        F.avg("change").alias("mean_change"), F.max(F.abs("change")).alias("largest_change"), F.count_if(F.abs("change") > 0).alias("changed_weeks"),
    )


def fullest_break(shares: DataFrame, unit: str, by: list[str]) -> DataFrame:
    """The contiguous run of break weeks around each unit's fullest break week, and its shift to the commonest such week.

    The commonest peak is the weighted mode over units (the earliest on a tie).
    """
    ordered = W.partitionBy(unit, *by).orderBy("week_start")
    gap = F.coalesce(F.datediff("week_start", F.lag("week_start").over(ordered)) != 7, F.lit(True))
    runs = shares.filter("breaks > 0").withColumn("__run", F.sum(gap.cast("int")).over(ordered))
    peaks = runs.groupBy(unit, *by).agg(F.max_by(F.struct("week_start", "__run"), F.struct("breaks", -F.unix_date("week_start"))).alias("p"), F.max("weight").alias("weight"))
    votes = peaks.groupBy(*by, F.col("p.week_start").alias("peak")).agg(F.sum("weight").alias("votes"))
    common = votes.groupBy(*by).agg(F.max_by("peak", F.struct("votes", -F.unix_date("peak"))).alias("common"))
    placed = peaks.select(unit, *by, F.col("p.week_start").alias("peak"), F.col("p.__run").alias("__run")).join(common, by)
    return runs.join(placed, [unit, *by, "__run"]).select(unit, *by, "week_start", "breaks", "peak", F.date_add("week_start", F.datediff("common", "peak")).alias("moved_to"))


def align_breaks(per_inst: DataFrame, first_month: int = 2, last_month: int = 4) -> DataFrame:
    """Every institution's run of spring break weeks moved to the commonest break week of the year."""
    thursday = F.month(F.date_add("week_start", 3))
    breaks = F.round(1 - F.col("session_share") - F.col("summer_share"), 6)  # less is rounding
    spring = per_inst.filter(thursday.between(first_month, last_month)).select(
        "week_start", "unitid", fall_year(F.col("week_start")).alias("__fy"), breaks.alias("breaks"), F.col("in_person").cast("double").alias("weight")
    )
    moved = fullest_break(spring, "unitid", ["__fy"])
    change = moved.select("unitid", "week_start", F.col("breaks").alias("by")).unionByName(moved.select("unitid", F.col("moved_to").alias("week_start"), (-F.col("breaks")).alias("by")))
    shift = change.groupBy("unitid", "week_start").agg(F.sum("by").alias("__by"))
    share = F.least(F.greatest(F.col("session_share") + F.coalesce("__by", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return per_inst.join(shift, ["unitid", "week_start"], "left").withColumn("session_share", share).drop("__by")


def remote_fall(per_inst: DataFrame, remote: DataFrame, year: int, first_month: int = 8, last_month: int = 12) -> DataFrame:
    """The institutions in ``remote`` (unitid) out of session in the fall of ``year``."""
    fall = (fall_year(F.col("week_start")) == year) & F.month(F.date_add("week_start", 3)).between(first_month, last_month)
    known = per_inst.join(remote.select("unitid", F.lit(True).alias("__remote")), "unitid", "left")
    return known.withColumn("session_share", F.when(F.col("__remote") & fall, 0.0).otherwise(F.col("session_share"))).drop("__remote")


def population(per_inst: DataFrame, arrangements: DataFrame, halls: DataFrame, shares: tuple[float, float], census: float, change: float = 0.0) -> DataFrame:
    """week_start, students_away and population, by the same steps as the published estimate.

    Students count where they live in term, so the census figure moves with
    ``change``, the share by which there are more or fewer of them.
    """
    scaled = scale_students(arrangements, change)
    weekly = presence.presence_index(presence.apply_covid(per_inst))
    span = presence.away_range(weekly, presence.closed_bed_share(per_inst, halls), scaled)
    years = scaled.agg(F.min("acs_year").alias("__lo"), F.max("acs_year").alias("__hi"))
    living = F.col("in_university_housing") + F.col("elsewhere")
    dated = (
        weekly_inputs(weekly).join(span.drop("presence_index"), "week_start").crossJoin(F.broadcast(years))  # one row
        .withColumn("acs_year", presence.clip(fall_year(F.col("week_start")), F.col("__lo"), F.col("__hi")))
        .join(scaled, "acs_year")
    )
    gone = away(dated, F.lit(shares[0]), F.lit(shares[1]), living, F.col("min_students_away"), F.col("max_students_away"))
    return dated.select("week_start", gone.alias("students_away"), (census + change / (1 + change) * living - gone).alias("population"))
