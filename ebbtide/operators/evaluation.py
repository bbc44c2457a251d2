"""Evaluations as metric rows: held-out models by subset, changes between two states, correlations, bounds.

A metric row has check, subset, metric, value and n, the number of rows it rests on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.operators import models, panel, search
from ebbtide.operators.windows import corr_from_sums
from ebbtide.plans.scratch import materialize

METRIC = ("check", "subset", "metric", "value", "n")


def metric_rows(df: DataFrame, check: str, subset: Column, metrics: dict[str, Column], n: Column) -> DataFrame:
    """Columns of ``df`` as metric rows, one per name in ``metrics``."""
    entries = [F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value")) for name, value in metrics.items()]
    rows = df.select(F.lit(check).alias("check"), subset.cast("string").alias("subset"), n.cast("long").alias("n"), F.explode(F.array(*entries)).alias("m"))
    return rows.select("check", "subset", "m.metric", "m.value", "n")


def assembled(*tables: DataFrame) -> DataFrame:
    """Metric rows of several checks as one table."""
    return reduce(DataFrame.unionByName, (t.select(*METRIC) for t in tables))


def state_change(rows: DataFrame, unit: str, state: Column, value: str, before: str, after: str, least: int) -> DataFrame:
    """(unit, log_change): logarithm of a unit's mean in state ``after`` over that in ``before``, of units with at least ``least`` rows of each."""
    held = rows.withColumn("__state", state).filter(F.col("__state").isin(before, after))
    means = held.groupBy(unit, "__state").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    wide = means.groupBy(unit).agg(*(F.max(F.when(F.col("__state") == s, F.col("mean"))).alias(s) for s in (before, after)))
    return wide.filter((F.col(before) > 0) & (F.col(after) > 0)).select(unit, F.ln(F.col(after) / F.col(before)).alias("log_change"))


def correlations(df: DataFrame, check: str, subset: str, target: str, columns: list[str], prefix: str) -> DataFrame:
    """Correlation of ``target`` with every column, from one row of sums; null for a constant side."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *(corr_from_sums(F.col(target), F.col(c).cast("double")).alias(c) for c in columns))
    return metric_rows(row, check, F.lit(subset), {f"{prefix}_{c}": F.col(c) for c in columns}, F.col("n"))


def evaluate_models(
    weeks: DataFrame, families: dict[str, list[str]], extra: dict[str, list[str]], y: str, index: str, subsets: dict[str, Column], held: str, week: str, fold: str, buffer_days: int = 7, seed: int = 1
) -> DataFrame:
    """(family, model, subset, metric, value, n): every family with every set of extra inputs, each held-out period from the others.

    The first of ``extra`` is the baseline.  Coefficients of all models and periods come from sums of products per week.
    What ``index`` is worth is the rise in error when its values are dealt anew under the same coefficients: no model is
    fitted again.  Models with extra inputs also have those inputs' coefficients on all weeks, with Newey-West errors.
    """
    names = {f"{f}|{m}": [search.CONSTANT, *columns, *more] for f, columns in families.items() for m, more in extra.items()}
    members = [search.Member(name, tuple(columns)) for name, columns in names.items()]
    every = list(dict.fromkeys(c for columns in names.values() for c in columns))
    rows = materialize(weeks.withColumn(search.CONSTANT, F.lit(1.0)), "weeks")
    betas = materialize(search.held_out_coefficients(rows, members, [members[0].name], y, held, week, fold, buffer_days).filter(F.col("model").isin(*names)), "coefficients")
    plain = search.held_out_predictions(rows, betas, every, held)
    dealt = search.held_out_predictions(models.shuffled(rows, week, index, seed, F.md5(F.concat_ws("-", F.lit(seed), F.col(week)))), betas, every, held).select(week, "model", F.col("predicted").alias("dealt"))
    both = materialize(plain.join(dealt, [week, "model"]), "predictions")
    inside = F.explode(F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(s)) for s, c in subsets.items())), lambda s: s.isNotNull())).alias("subset")
    marked = both.select("*", inside)
    scored = panel.scores(marked, y, "predicted", ["model", "subset"])
    loss = F.col(y) - F.col("dealt")
    scored = scored.join(marked.groupBy("model", "subset").agg(F.sqrt(F.avg(loss * loss)).alias("dealt")), ["model", "subset"])
    scored = scored.select(F.split_part("model", F.lit("|"), F.lit(1)).alias("family"), F.split_part("model", F.lit("|"), F.lit(2)).alias("model"), "subset", "n", "mae", "rmse", "r2", "dealt")
    baseline = scored.filter(F.col("model") == next(iter(extra))).select("family", "subset", F.col("rmse").alias("base"))
    joined = scored.join(baseline, ["family", "subset"])
    using = [m for m, more in extra.items() if index in more]
    metrics = {
        "mae": F.col("mae"), "rmse": F.col("rmse"), "r2": F.col("r2"),
        "rmse_change_percent": F.when(F.col("model") != next(iter(extra)), 100 * (F.try_divide("rmse", "base") - 1)),
        f"{index}_permutation_increase_percent": F.when(F.col("model").isin(*using), 100 * (F.try_divide("dealt", "rmse") - 1)),
    }
    entries = F.explode(F.array(*(F.struct(F.lit(name).alias("metric"), value.alias("value")) for name, value in metrics.items()))).alias("m")
    out = joined.select("family", "model", "subset", entries, "n").select("family", "model", "subset", "m.metric", "m.value", "n").filter("value is not null")
    return out.unionByName(_coefficients(rows, families, extra, y, week))


def _coefficients(rows: DataFrame, families: dict[str, list[str]], extra: dict[str, list[str]], y: str, week: str) -> DataFrame:
    """Coefficients of the extra inputs on all weeks with errors robust to autocorrelation, and their effects in percent."""
    found = []
    for family, columns in families.items():
        for model, more in extra.items():
            x = [search.CONSTANT, *columns, *more]
            if more:
                beta = panel.fit(rows, x, y)
                error = panel.newey_west_covariance(rows, x, y, beta, week).diagonal().clip(min=0) ** 0.5
                found += [(family, model, c, float(beta[x.index(c)]), float(error[x.index(c)])) for c in more]
    table = rows.sparkSession.createDataFrame(found, "family string, model string, input string, beta double, se double")
    effect, low, high = panel.effect_percent(F.col("beta"), F.col("se"))
    metrics = {"coefficient": F.col("beta"), "error": F.col("se"), "effect_percent": effect, "effect_percent_low": low, "effect_percent_high": high}
    entries = F.explode(F.array(*(F.struct(F.concat("input", F.lit(f"_{name}")).alias("metric"), value.alias("value")) for name, value in metrics.items()))).alias("m")
    many = rows.count()
    return table.select("family", "model", F.lit("all weeks").alias("subset"), entries).select("family", "model", "subset", "m.metric", "m.value", F.lit(many).cast("long").alias("n"))
