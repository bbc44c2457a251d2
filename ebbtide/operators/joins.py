"""Joins of weekly tables: spines, fall-backs, ranges, interpolation and rotations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def onto_spine(spine: DataFrame, tables: list[DataFrame], key: str = "week_start") -> DataFrame:
    """Every row of the spine with each table's columns; what a table lacks is null."""
    return reduce(lambda left, right: left.join(right, key, "left"), tables, spine)


def fallback_lookup(rows: DataFrame, fine: DataFrame, fine_keys: list[str], coarse: DataFrame, coarse_keys: list[str], defaults: dict[str, object]) -> DataFrame:
    """Attributes by the fine keys, else by the coarse keys, else the default.

    Null keys find nothing; their rows don't take part in the joins, where
    they would all meet in one task.
    """
    f = fine.select(*fine_keys, *(F.col(c).alias(f"__f_{c}") for c in defaults))
    g = coarse.select(*coarse_keys, *(F.col(c).alias(f"__g_{c}") for c in defaults))
    keyed = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in coarse_keys))
    joined = rows.filter(keyed).join(f, fine_keys, "left").join(g, coarse_keys, "left")
    found = {c: F.coalesce(f"__f_{c}", f"__g_{c}", F.lit(default)) for c, default in defaults.items()}
    tagged = joined.withColumns(found).drop(*(f"__{s}_{c}" for s in "fg" for c in defaults))
    return tagged.unionByName(rows.filter(~keyed).withColumns({c: F.lit(default) for c, default in defaults.items()}))


def mean_nearby(rows: DataFrame, unit: str, day: str, value: str, usable: Column, days: int, name: str) -> DataFrame:
    """Mean of a value over the unit's usable rows within ``days`` of each row: a range join as a window."""
    near = W.partitionBy(unit).orderBy(F.unix_date(day)).rangeBetween(-days, days)
    return rows.withColumn(name, F.avg(F.when(usable, F.col(value))).over(near))


def interpolate(rows: DataFrame, at: str, anchors: DataFrame, anchor: str, value: str, name: str) -> DataFrame:
    """Linear between dated anchors, flat outside them, with a flag for outside.

    A row's value depends on its day alone, so the distinct days and the anchors meet in one sorted pass, each day
    looking back and ahead to the nearest anchor; rows then take their day's value.  However many rows there are,
    what is sorted in one partition is a calendar.  A row without a day has no value.
    """
    days = rows.select(F.col(at).alias("__day")).filter("__day is not null").distinct()
    both = days.withColumn("__t", F.unix_date("__day")).unionByName(anchors.select(F.unix_date(anchor).alias("__t"), F.col(value).cast("double").alias("__v"), F.lit(True).alias("__anchor")), allowMissingColumns=True)
    back = W.orderBy("__t", F.col("__anchor").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.orderBy("__t", F.col("__anchor").asc_nulls_last()).rowsBetween(0, W.unboundedFollowing)
    point = F.when(F.col("__anchor"), F.struct(F.col("__t").alias("t"), F.col("__v").alias("v")))
    met = both.withColumns({"__a": F.last(point, True).over(back), "__b": F.first(point, True).over(ahead)}).filter("__anchor is null")
    a, b = F.col("__a"), F.col("__b")
    value_at = F.when(a["t"] == F.col("__t"), a["v"]).when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * (F.col("__t") - a["t"]) / (b["t"] - a["t"]))
    outside = F.coalesce(F.col("__t") != a["t"], F.lit(True)) & (a.isNull() | b.isNull())
    found = met.select("__day", value_at.alias("__value"), outside.alias("__outside"))
    kept = [c for c in rows.columns if c not in (name, "extrapolated")]
    return rows.join(found, F.col(at) == F.col("__day"), "left").select(*kept, F.col("__value").alias(name), F.col("__outside").alias("extrapolated"))


def paired_change(rows: DataFrame, keys: list[str], month: Column, first: int, second: int, value: str) -> DataFrame:
    """Log change of a value's mean from one month to another, where both are known and positive."""
    wide = rows.groupBy(*keys).agg(F.avg(F.when(month == first, F.col(value))).alias("before"), F.avg(F.when(month == second, F.col(value))).alias("after"))
    return wide.filter("before > 0 and after > 0").withColumn("log_change", F.ln(F.col("after") / F.col("before")))


def asked_shares(keys: DataFrame, asked: DataFrame, answers: DataFrame, on: list[str], value: str) -> DataFrame:
    """Every key with every question asked of it; an answer nobody gave is a share of 0."""
    return keys.join(asked, on[0]).join(answers, on, "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def rotations(rows: DataFrame, key: str, only: DataFrame | None = None) -> DataFrame:
    """For each k from 1, or each in ``only``: every key takes the rows of the k-th next key in order.

    ``key`` is the receiver, ``donor`` the giver.  The keys are a short
    dimension; each row goes to the keys k places before its own, so rows
    meet ranks only.
    """
    order = rows.select(key).distinct().withColumn("__n", F.dense_rank().over(W.orderBy(key)) - 1)
    many = order.agg(F.count(F.lit(1)).alias("__many"))
    ranked = rows.withColumnRenamed(key, "donor").join(order.withColumnRenamed(key, "donor"), "donor").crossJoin(F.broadcast(many))
    if only is None:
        ranked = ranked.withColumn("k", F.explode(F.sequence(F.lit(1), F.greatest(F.col("__many") - 1, F.lit(1)))))
    else:
        ranked = ranked.crossJoin(only.select("k"))
    dealt = ranked.filter("k < __many")
    moved = dealt.withColumn("__n", F.pmod(F.col("__n") - F.col("k"), F.col("__many"))).drop("__many")
    return moved.join(order, "__n").drop("__n")
