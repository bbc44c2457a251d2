"""Datasets behind the reports: coverage spans, top groups, formatted intervals, long metrics."""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ebbtide.operators import joins, panel
from ebbtide.plans.scratch import materialize

#: Units that are fitted side by side, one column each.
MAX_UNITS = 200


def best_per_group(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in an order that has no ties."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter("__n = 1").drop("__n")


def largest(df: DataFrame, value: str, key: str, number: int) -> DataFrame:
    """The rows of the largest values, ties by key."""
    return df.orderBy(F.desc(value), key).limit(number)


def smallest_passing(df: DataFrame, passing: Column, order: list[str]) -> DataFrame:
    """The first row in order among those that pass."""
    return df.filter(passing).orderBy(*order).limit(1)


def interval_text(value: Column, low: Column, high: Column) -> Column:
    """"12,345 (11,000–13,000)", or "not known" without a value."""
    def whole(x: Column) -> Column:
        return F.round(x).cast("long")

    return F.coalesce(F.when(value.isNotNull(), F.format_string("%,d (%,d–%,d)", whole(value), whole(low), whole(high))), F.lit("not known"))


def coverage_spans(days: DataFrame, dataset: str, low: Column, high: Column) -> DataFrame:
    """Contiguous spans of days with data, clipped to the study."""
    ordered = W.partitionBy("dataset").orderBy("day")
    rows = days.select(F.lit(dataset).alias("dataset"), "day").distinct()
    step = F.coalesce(F.datediff("day", F.lag("day").over(ordered)) != 1, F.lit(True))
    spans = rows.withColumn("__run", F.sum(step.cast("int")).over(ordered)).groupBy("dataset", "__run").agg(F.min("day").alias("first"), F.max("day").alias("last"))
    return spans.select("dataset", F.greatest("first", low).alias("first"), F.least("last", high).alias("last")).filter("first <= last")


def long_metrics(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row per key and metric."""
    return df.select(*keys, *(F.col(m).cast("double") for m in metrics)).unpivot(keys, metrics, "metric", "value")


def whole_years(weekly: DataFrame, year: str, least: int = 52) -> DataFrame:
    """Weeks of years that have enough of them."""
    return weekly.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(year))).filter(F.col("__n") >= least).drop("__n")


def named_list(values: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(values)), "; ")


def placebo_slopes(rows: DataFrame, share: str, y: str, unit: str, week: str) -> DataFrame:
    """(k, beta): the pooled effect when every unit takes the k-th next unit's share, units' years and weeks removed."""
    given = joins.rotations(rows.select(unit, week, share), unit).select("k", unit, week, share)
    moved = rows.select(unit, week, F.year(week).alias("__year"), y).join(given, [unit, week])
    clean = panel.demean(moved, [y, share], [["k", unit, "__year"], ["k", week]])
    return panel.gram(clean, [share], y, ["k"]).select("k", F.try_divide(F.col("xy")[0], F.col("xx")[0]).alias("beta"))


def panel_report(rows: DataFrame, share: str, y: str, unit: str, week: str, kind: str) -> DataFrame:
    """(model, term, metric, value, n): counts, pooled and by-unit effects without and with unit seasons, weeks by kind of calendar, placebos.

    Effects are in percent, from logs, with a band of 1.96 clustered errors.
    """
    spark = rows.sparkSession
    held = materialize(rows.withColumns({"__year": F.year(week), "__month": F.month(week)}), "panel")
    n = held.count()
    names = [r[0] for r in held.select(unit).distinct().limit(MAX_UNITS + 1).collect()]
    if len(names) > MAX_UNITS:
        raise ValueError(f"more than {MAX_UNITS} units can't be fitted side by side")
    names = sorted(names)
    of_unit = dict(held.groupBy(unit).count().collect())
    out = [("pooled", unit, "count", float(len(names)), n)]

    def effects(model: str, term: str, beta: float, se: float, weeks: int) -> None:
        for metric, b in (("effect_pct", beta), ("effect_pct_low", beta - 1.96 * se), ("effect_pct_high", beta + 1.96 * se)):
            out.append((model, term, metric, float(100 * (np.exp(b) - 1)), weeks))

    pooled = None
    for label, levels in (("", [[unit, "__year"], [week]]), (", unit seasons", [[unit, "__year"], [unit, "__month"], [week]])):
        found = panel.fixed_effects(held, [share], y, levels, unit)
        pooled = found["beta"][0] if pooled is None else pooled
        effects(f"pooled{label}", share, found["beta"][0], found["se"][0], n)
        out.append((f"pooled{label}", share, "within_r2", float(found["r2_within"]), n))
        columns = {f"__u{k}": F.when(F.col(unit) == name, F.col(share)).otherwise(0.0) for k, name in enumerate(names)}
        found = panel.fixed_effects(held.withColumns(columns), list(columns), y, levels, unit)
        for name, b, e in zip(names, found["beta"], found["se"]):
            effects(f"by unit{label}", str(name), b, e, of_unit[name])
    for r in held.groupBy(unit, kind).count().collect():  # units by kinds
        out.append(("by unit", str(r[0]), f"{r[1]}_week_share", r[2] / of_unit[r[0]], of_unit[r[0]]))
    betas = [r["beta"] for r in placebo_slopes(held.select(*rows.columns), share, y, unit, week).collect() if r["beta"] is not None]  # one row per rotation
    if betas:
        percent = [100 * (np.exp(b) - 1) for b in betas]
        for metric, value in (
            ("effect_pct_median", np.median(percent)), ("effect_pct_max", max(percent)), ("rotations", len(betas)), ("rotations_at_least_own", sum(b >= pooled for b in betas)),
        ):
            out.append(("placebo", share, metric, float(value), n))
    return spark.createDataFrame(out, "model string, term string, metric string, value double, n long")
