"""Analytic functions over weekly series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def deviations(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Values less their mean over the group."""
    group = W.partitionBy(*by)
    return df.withColumns({c: F.col(c) - F.avg(c).over(group) for c in columns})


def moving_average(column: str, order: str, by: list[str], size: int = 5, least: int = 3) -> Column:
    """Centred mean over rows, null with fewer than ``least`` values."""
    frame = W.partitionBy(*by).orderBy(order).rowsBetween(-(size // 2), size // 2)
    return F.when(F.count(column).over(frame) >= least, F.avg(column).over(frame))


def runs(df: DataFrame, by: list[str], order: str, flag: str) -> DataFrame:
    """Contiguous runs of rows with the same flag: its value, first, last and rows."""
    ordered = W.partitionBy(*by).orderBy(order)
    change = (~F.col(flag).eqNullSafe(F.lag(flag).over(ordered))) | (F.row_number().over(ordered) == 1)
    numbered = df.withColumn("__run", F.sum(change.cast("int")).over(ordered))
    return numbered.groupBy(*by, "__run").agg(F.first(flag).alias(flag), F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).drop("__run")


def filled(column: str, order: str, by: list[str]) -> Column:
    """The last known value, else the next known one."""
    ordered = W.partitionBy(*by).orderBy(order)
    return F.coalesce(F.last(column, True).over(ordered.rowsBetween(W.unboundedPreceding, 0)), F.first(column, True).over(ordered.rowsBetween(0, W.unboundedFollowing)))


def corr_from_sums(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; null for a constant side instead of an error."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    n = F.count(x)
    covariance = n * F.sum(x * y) - F.sum(x) * F.sum(y)
    spread = (n * F.sum(x * x) - F.sum(x) * F.sum(x)) * (n * F.sum(y * y) - F.sum(y) * F.sum(y))
    return F.when(spread > 0, covariance / F.sqrt(F.greatest(spread, F.lit(1e-300))))


def yearly_changes(df: DataFrame, year: str, value: str, skip: list[int], by: list[str]) -> DataFrame:
    """Largest and median absolute change from year to year, leaving out some years."""
    ordered = W.partitionBy(*by).orderBy(year)
    change = df.filter(~F.col(year).isin(*skip)).withColumns({"__d": F.col(value) - F.lag(value).over(ordered), "__gap": F.col(year) - F.lag(year).over(ordered)})
    return change.filter("__gap = 1").groupBy(*by).agg(F.max(F.abs("__d")).alias("largest"), F.percentile(F.abs("__d"), 0.5).alias("median"))


def neighbours(df: DataFrame, value: str, order: str, by: list[str]) -> DataFrame:
    """Add the value one row earlier and later and the change to it."""
    ordered = W.partitionBy(*by).orderBy(order)
    before, after = F.lag(value).over(ordered), F.lead(value).over(ordered)
    return df.withColumns({"previous": before, "next": after, "change": F.col(value) - before})
