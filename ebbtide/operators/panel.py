"""Panel statistics: rows are reduced to sums in Spark; only p x p systems are solved outside.

A design is a set of numeric columns.  ``gram`` sums their products; fits,
robust covariances, hold-outs and bootstraps all work on such sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ebbtide.operators.joins import rotations
from ebbtide.operators.ranking import global_rank
from ebbtide.plans.scratch import materialize, release

MAX_ROUNDS = 50


def demean(df: DataFrame, columns: list[str], groupings: list[list[str]], tolerance: float = 1e-10) -> DataFrame:
    """Remove the means of several groupings by alternating projections.

    Means are aggregated before they are shuffled and written, so that the rows
    of a large group can be split where they meet them.
    """
    held = materialize(df, "panel")
    now = held
    for _ in range(MAX_ROUNDS):
        read = [held]
        stepped = now.withColumns({f"__was_{c}": F.col(c).cast("double") for c in columns})
        for keys in groupings:
            means = stepped.groupBy(*(F.col(k).alias(f"__g{n}") for n, k in enumerate(keys))).agg(*(F.avg(c).alias(f"__m_{c}") for c in columns))
            same = [F.col(k).eqNullSafe(F.col(f"__g{n}")) for n, k in enumerate(keys)]
            read.append(materialize(means, "means"))
            joined = stepped.join(read[-1], same)
            stepped = joined.select(*((F.col(c) - F.col(f"__m_{c}")).alias(c) if c in columns else c for c in stepped.columns))
        stepped = held = materialize(stepped, "demeaned")
        release(*read)  # the disk holds one round
        largest = stepped.agg(F.max(F.greatest(*(F.abs(F.col(c) - F.col(f"__was_{c}")) for c in columns), F.lit(0.0)))).first()[0]
        now = stepped.drop(*(f"__was_{c}" for c in columns))
        if largest is None or largest <= tolerance:
            return now
    raise RuntimeError(f"means did not settle in {MAX_ROUNDS} rounds")


#: Up to this many groups of a short grouping are solved for at once.
SHORT = 5_000


def _short_system(many: int, width: int):
    """Sums of the normal equations of a short grouping's ``many`` values once the long one's levels are out.

    A task adds its groups one by one to one system, so its memory doesn't grow with their number.
    """

    def run(batches):
        system = np.zeros((many, many + width))
        for part in batches:
            for places, counts, *sums in zip(part["places"], part["counts"], *(part[f"sums{k}"] for k in range(width))):
                t, n = np.asarray(places, np.int64), np.asarray(counts, float)
                y = np.array(sums, float).T
                block = np.concatenate([np.diag(n), y], axis=1) - np.outer(n, np.concatenate([n, y.sum(axis=0)]) / n.sum())
                system[np.ix_(t, np.concatenate([t, many + np.arange(width)]))] += block
        for i, row in enumerate(system):
            j = np.flatnonzero(row)
            if len(j):
                yield pd.DataFrame({"i": i, "j": np.where(j < many, j, many - 1 - j), "value": row[j]})

    return run


def absorb(df: DataFrame, columns: list[str], long: list[str], short: str) -> DataFrame:
    """Residuals of ``columns`` after a level for each group of ``long`` keys and each value of ``short``.

    Exact and without iteration where ``short`` has few values (weeks): a long group holds one cell per
    value, its levels are eliminated in Spark, and only the short grouping's system, values x values, is
    solved outside.  Beyond ``SHORT`` values the means are removed by turns.
    """
    rows = materialize(df, "levels")
    values = rows.select(short).distinct()
    many = values.count()
    if many > SHORT:
        return demean(rows, columns, [long, [short]])
    # at most SHORT rows
    places = materialize(values.select(F.col(short).alias("__short"), (F.row_number().over(W.orderBy(short)) - 1).alias("__t")), "places")
    placed = rows.join(places, F.col(short).eqNullSafe(F.col("__short"))).drop("__short")
    cells = placed.groupBy(*long, "__t").agg(F.count(F.lit(1)).alias("__n"), *(F.sum(F.col(c).cast("double")).alias(f"__s{k}") for k, c in enumerate(columns)))
    # one entry per value of ``short``
    groups = cells.groupBy(*long).agg(F.collect_list(F.struct("__t", "__n", *(f"__s{k}" for k in range(len(columns))))).alias("__c"))
    groups = groups.select(F.col("__c.__t").alias("places"), F.col("__c.__n").alias("counts"), *(F.col(f"__c.__s{k}").alias(f"sums{k}") for k in range(len(columns))))
    sums = groups.mapInPandas(_short_system(many, len(columns)), "i long, j long, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    left, right = np.zeros((many, many)), np.zeros((many, len(columns)))
    for i, j, value in sums:
        if j >= 0:
            left[i, j] = value
        else:
            right[i, -1 - j] = value
    level = np.linalg.pinv((left + left.T) / 2, rcond=1e-12, hermitian=True) @ right if many else right
    names = [f"__b{k}" for k in range(len(columns))]
    levels = df.sparkSession.createDataFrame([(t, *map(float, row)) for t, row in enumerate(level)], f"__t int, {', '.join(f'{n} double' for n in names)}")
    rest = placed.join(levels, "__t").withColumns({c: F.col(c) - F.col(b) for c, b in zip(columns, names)}).drop("__t", *names)
    rest = materialize(rest, "rest")
    means = materialize(rest.groupBy(*(F.col(k).alias(f"__g{n}") for n, k in enumerate(long))).agg(*(F.avg(c).alias(f"__m_{c}") for c in columns)), "means")
    same = [F.col(k).eqNullSafe(F.col(f"__g{n}")) for n, k in enumerate(long)]
    return rest.join(means, same).select(*((F.col(c) - F.col(f"__m_{c}")).alias(c) if c in columns else c for c in df.columns))


def weekly_slopes(df: DataFrame, measures: dict[str, str], outcomes: list[str], unit: str, year: str, week: str, by: list[str] | None = None) -> DataFrame:
    """Each week's slope of the outcomes on every measure, after a level for each unit in each year and for each week.

    ``measures`` names the columns of units; a measure is centred on its mean over all rows of ``by``.  As a week lies
    in one year, levels of all groups of ``by`` that hold whole years come from one pass.
    """
    by = by or []
    whole = df.select(*by, unit, year, week, *outcomes, *measures.values()).dropna()
    rows = absorb(whole, outcomes, [unit, year], week)
    long = rows.select(*by, week, *outcomes, F.explode(F.array(*(F.struct(F.lit(name).alias("measure"), F.col(c).cast("double").alias("x")) for name, c in measures.items()))).alias("__m"))
    long = long.select(*by, week, *outcomes, "__m.measure", "__m.x")
    centre = long.groupBy(*by, "measure").agg(F.avg("x").alias("__centre"))
    x = F.col("x") - F.col("__centre")
    return long.join(centre, [*by, "measure"]).groupBy(*by, "measure", week).agg(*(F.try_divide(F.sum(x * F.col(c)), F.sum(x * x)).alias(c) for c in outcomes))


def gram(df: DataFrame, x: list[str], y: str, by: list[str] | None = None) -> DataFrame:
    """One row per group: ``n``, ``yy`` and the arrays ``xx`` (row by row) and ``xy`` of sums of products."""
    terms = [F.sum(F.col(a) * F.col(b)) for a in x for b in x]
    right = [F.sum(F.col(a) * F.col(y)) for a in x]
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y) * F.col(y)).alias("yy"), F.array(*terms).alias("xx"), F.array(*right).alias("xy"))


def solve(xx, xy) -> np.ndarray:
    """Least squares of least norm from sums; singular designs are allowed."""
    p = len(xy)
    return np.linalg.pinv(np.array(xx, float).reshape(p, p), hermitian=True) @ np.array(xy, float)


def fit(df: DataFrame, x: list[str], y: str) -> np.ndarray:
    row = gram(df, x, y).first()
    return solve(row["xx"], row["xy"])


def _predicted(x: list[str], beta: np.ndarray) -> Column:
    out = F.lit(0.0)
    for c, b in zip(x, beta):
        out = out + F.col(c) * float(b)
    return out


def _sandwich(df: DataFrame, x: list[str], y: str, beta: np.ndarray, meat: np.ndarray) -> np.ndarray:
    bread = np.linalg.pinv(np.array(gram(df, x, y).first()["xx"]).reshape(len(x), len(x)), hermitian=True)
    return bread @ meat @ bread


def clustered_covariance(df: DataFrame, x: list[str], y: str, beta: np.ndarray, cluster: str) -> np.ndarray:
    """Covariance of the coefficients, robust to correlation within clusters."""
    e = F.col(y) - _predicted(x, beta)
    scores = df.groupBy(cluster).agg(*(F.sum(F.col(c) * e).alias(f"__s{k}") for k, c in enumerate(x)))
    p = len(x)
    sums = scores.agg(F.count(F.lit(1)).alias("g"), *(F.sum(F.col(f"__s{i}") * F.col(f"__s{j}")) for i in range(p) for j in range(p))).first()
    g = sums[0]
    return _sandwich(df, x, y, beta, np.array(sums[1:], float).reshape(p, p) * g / (g - 1))


def newey_west_covariance(df: DataFrame, x: list[str], y: str, beta: np.ndarray, order: str, lags: int = 4) -> np.ndarray:
    """Covariance robust to autocorrelation, with Bartlett weights over rows in order."""
    e = F.col(y) - _predicted(x, beta)
    p, ordered = len(x), W.orderBy(order)
    # one regular series of weekly rows
    scored = df.select(order, *((F.col(c) * e).alias(f"__s{k}") for k, c in enumerate(x)))
    lagged = scored.withColumns({f"__l{k}_{lag}": F.lag(f"__s{k}", lag).over(ordered) for k in range(p) for lag in range(1, lags + 1)})
    terms = [F.coalesce(F.sum(F.col(f"__s{i}") * F.col(f"__s{j}")), F.lit(0.0)) for i in range(p) for j in range(p)]
    terms += [F.coalesce(F.sum(F.col(f"__s{i}") * F.col(f"__l{j}_{lag}")), F.lit(0.0)) for lag in range(1, lags + 1) for i in range(p) for j in range(p)]
    sums = np.array(lagged.agg(*terms).first(), float).reshape(lags + 1, p, p)
    meat = sums[0].copy()
    for lag in range(1, lags + 1):
        meat += (1 - lag / (lags + 1)) * (sums[lag] + sums[lag].T)
    return _sandwich(df, x, y, beta, meat)


def combination(beta: np.ndarray, covariance: np.ndarray, weights: dict[str, float], x: list[str]) -> tuple[float, float]:
    """A weighted sum of coefficients and its standard error; columns without a weight count 0."""
    w = np.array([weights.get(c, 0.0) for c in x])
    return float(w @ beta), float(np.sqrt(max(w @ covariance @ w, 0.0)))


def fixed_effects(df: DataFrame, x: list[str], y: str, groupings: list[list[str]], cluster: str) -> dict:
    """Coefficients, clustered errors and within R2 after removing group means."""
    rows = materialize(demean(df, [y, *x], groupings), "panel")
    beta = fit(rows, x, y)
    row = gram(rows, x, y).first()
    explained = float(beta @ np.array(row["xy"]))
    errors = np.sqrt(np.maximum(np.diag(clustered_covariance(rows, x, y, beta, cluster)), 0))
    return {"beta": beta, "se": errors, "n": row["n"], "r2_within": explained / row["yy"] if row["yy"] else float("nan")}


def effect_percent(beta: Column, se: Column) -> tuple[Column, Column, Column]:
    """A log effect in percent with its 95 % band."""
    return 100 * (F.exp(beta) - 1), 100 * (F.exp(beta - 1.96 * se) - 1), 100 * (F.exp(beta + 1.96 * se) - 1)


def slopes(df: DataFrame, by: list[str], y: Column, x: Column, least: int = 3) -> DataFrame:
    """Slope of y on x in each group with enough rows."""
    both = df.select(*by, y.alias("y"), x.alias("x")).filter("y is not null and x is not null")
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope")).filter(F.col("n") >= least)


#: A unit's numbers in a week: the first two are used where it receives, the others where it gives.
_SIDES = ("cy", "y", "cx", "x", "xx")
#: Sums over all pairs of a rotation, by the receiver's and the giver's number.
_PAIRED = {"n": ("cy", "cx"), "sy": ("y", "cx"), "sx": ("cy", "x"), "sxx": ("cy", "xx"), "sxy": ("y", "x")}
#: Frequencies of a spectrum in one row.
SPECTRUM = 4_096


def _spectra(many: int, week: str):
    """Products of the weeks' spectra over ``many`` units in order, added up over the task's weeks, which come one after another."""

    def run(batches):
        total, held, now = np.zeros((len(_PAIRED), many // 2 + 1), complex), np.zeros((len(_SIDES), many)), None

        def close():
            spectrum = dict(zip(_SIDES, np.fft.rfft(held)))
            for n, (receiver, giver) in enumerate(_PAIRED.values()):
                total[n] += spectrum[receiver].conj() * spectrum[giver]
            held[:] = 0

        for part in batches:
            for key, rows in part.groupby(week, sort=False):
                if now is not None and key != now:
                    close()
                now = key
                held[:, rows["__n"].to_numpy()] = rows[list(_SIDES)].to_numpy().T
        if now is not None:
            close()
            for n, name in enumerate(_PAIRED):
                for low in range(0, total.shape[1], SPECTRUM):
                    chunk = total[n, low : low + SPECTRUM]
                    yield pd.DataFrame({"name": [name], "low": [low], "re": [chunk.real], "im": [chunk.imag]})

    return run


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.iloc[:1].assign(re=[np.sum(rows["re"].to_list(), axis=0)], im=[np.sum(rows["im"].to_list(), axis=0)])


def rotation_slopes(df: DataFrame, unit: str, week: str, y: str, x: str, least: int = 3) -> DataFrame:
    """(k, n, slope): slope of y on x when every unit takes the x of the k-th next unit in the same week, for every k.

    A rotation's sums of products are circular correlations over the units in order, so all of them come from the weeks'
    Fourier transforms, and rows grow with units and weeks, not with units squared.  A task holds a week's units and a
    spectrum, a hundred bytes a unit.  Rotations whose spread of x is too small for the transforms' rounding are joined.
    """
    rows = materialize(df.select(unit, week, F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x")), "rows")
    order = materialize(global_rank(rows.select(unit).filter(F.col(unit).isNotNull()).distinct(), [unit], "__n"), "order")
    many = order.count()
    mean = rows.agg(F.avg("y").alias("y"), F.avg("x").alias("x"), (F.min("x") < F.max("x")).alias("spread")).first()
    b, a = F.col("y") - F.lit(mean["y"]), F.col("x") - F.lit(mean["x"])
    numbers = {"cy": F.count("y"), "y": F.sum(b), "cx": F.count("x"), "x": F.sum(a), "xx": F.sum(a * a)}
    cells = rows.groupBy(unit, week).agg(*(F.coalesce(v.cast("double"), F.lit(0.0)).alias(c) for c, v in numbers.items())).filter(F.col(week).isNotNull()).join(order, unit).select(week, "__n", *_SIDES)
    cells = materialize(cells, "cells")
    ordered = cells.repartition(week).sortWithinPartitions(week)
    parts = ordered.mapInPandas(_spectra(many, week), "name string, low long, re array<double>, im array<double>")
    spectra = parts.groupBy("name", "low").applyInPandas(_added, parts.schema)

    def inverse(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("low")
        values = np.fft.irfft(np.concatenate(found["re"].to_list()) + 1j * np.concatenate(found["im"].to_list()), many)
        return pd.DataFrame({"name": found["name"].iloc[0], "k": np.arange(many), "value": values})[1:]

    # a spectrum is as long as half the units
    sums = spectra.groupBy("name").applyInPandas(inverse, "name string, k long, value double")
    wide = sums.groupBy("k").agg(*(F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in _PAIRED))
    size = cells.agg(F.sqrt(F.sum(F.col("cy") * F.col("cy")) * F.sum(F.col("xx") * F.col("xx")))).first()[0]
    wide = materialize(wide.withColumn("n", F.round("n").cast("long")).filter(F.col("n") >= least), "rotations")
    within = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    if not mean["spread"]:
        return wide.select("k", "n", F.lit(None).cast("double").alias("slope"))
    clear = within > 1e-9 * size
    slope = (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / within
    out = wide.filter(clear).select("k", "n", slope.alias("slope"))
    unclear = wide.filter(~clear).select("k")
    if unclear.isEmpty():
        return out
    given = rotations(rows.select(unit, week, "x"), unit, unclear).select("k", unit, week, "x")
    return out.unionByName(slopes(rows.select(unit, week, "y").join(given, [unit, week]), ["k"], F.col("y"), F.col("x"), least))


def through_origin(df: DataFrame, observed: str, predicted: str, by: list[str]) -> DataFrame:
    """Slope through the origin of observed on predicted: 1 means the right size."""
    p, o = F.col(predicted), F.col(observed)
    return df.groupBy(*by).agg(F.try_divide(F.sum(p * o), F.sum(p * p)).alias("size"), F.sqrt(F.avg((o - p) * (o - p))).alias("rmse"), F.count(F.lit(1)).alias("n"))


def r2_gain(df: DataFrame, base: list[str], extra: str, y: str) -> tuple[float, float]:
    """R2 of a design without and with one more column, from one set of sums; the first base column is the constant."""
    x = [*base, extra]
    row = gram(df, x, y).first()
    xx, xy = np.array(row["xx"]).reshape(len(x), len(x)), np.array(row["xy"])
    total = row["yy"] - xy[0] ** 2 / xx[0, 0]
    out = []
    for keep in (range(len(base)), range(len(x))):
        k = list(keep)
        b = solve(xx[np.ix_(k, k)].ravel(), xy[k])
        out.append(float(1 - (row["yy"] - b @ xy[k]) / total))
    return out[0], out[1]


def held_out_scores(df: DataFrame, x: list[str], y: str, fold: str, week: str, buffer_days: int = 7) -> DataFrame:
    """Predictions for each fold from all rows outside it and outside its buffer of days.

    Nothing is refitted on rows: a fold's training sums are the total less the
    sums of its buffered rows.
    """
    spark = df.sparkSession
    total = gram(df, x, y).first()
    spans = df.groupBy(fold).agg(F.date_sub(F.min(week), buffer_days).alias("__lo"), F.date_add(F.max(week), buffer_days).alias("__hi"))
    days = gram(df, x, y, [week])
    # folds by weeks: both are a study's few hundred rows
    near = days.join(F.broadcast(spans), (F.col(week) >= F.col("__lo")) & (F.col(week) <= F.col("__hi")))
    p = len(x)
    removed = near.groupBy(fold).agg(F.array(*(F.sum(F.col("xx")[k]) for k in range(p * p))).alias("xx"), F.array(*(F.sum(F.col("xy")[k]) for k in range(p))).alias("xy"))
    all_xx, all_xy = np.array(total["xx"], float), np.array(total["xy"], float)

    def solved(batches):
        for part in batches:
            part["beta"] = [solve(all_xx - np.array(a), all_xy - np.array(b)).tolist() for a, b in zip(part["xx"], part["xy"])]
            yield part[[fold, "beta"]]

    kind = df.schema[fold].dataType.simpleString()
    betas = removed.mapInPandas(solved, f"{fold} {kind}, beta array<double>")
    guess = F.lit(0.0)
    for k, c in enumerate(x):
        guess = guess + F.col(c) * F.col("beta")[k]
    return df.join(betas, fold).withColumn("predicted", guess).drop("beta")


def scores(df: DataFrame, observed: str, predicted: str, by: list[str]) -> DataFrame:
    """MAE, RMSE and R2 by subset."""
    e, o = F.col(observed) - F.col(predicted), F.col(observed)
    n = F.count(F.lit(1))
    spread = F.sum(o * o) - F.sum(o) * F.sum(o) / n
    return df.groupBy(*by).agg(n.alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.sum(e * e), spread)).alias("r2"))


def forward_splits(years: list[int], first_test: int) -> list[tuple[list[int], int]]:
    """Training years before each test year."""
    return [([y for y in years if y < test], test) for test in years if test >= first_test]
