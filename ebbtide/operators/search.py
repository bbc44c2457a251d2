"""Model search over held-out months: members, stacks, means and choices, all from sums of products.

Rows are reduced to sums of products per week.  A held-out period's training
sums are the totals of each inner fold less the weeks in or near the period, so
every member, its out-of-fold predictions and every combination of members are
solved from p x p sums inside tasks, one held-out period at a time; no model is
refitted on rows.  Tree families can't be had from sums: they are fitted on
rows by ``models.out_of_fold``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.models import non_negative
from ebbtide.operators.panel import gram

CONSTANT = "one"


@dataclass(frozen=True)
class Member:
    """A penalised fit on some columns, and another on what it leaves if ``then`` names columns."""

    name: str
    columns: tuple[str, ...]
    penalty: float = 0.0
    then: tuple[str, ...] = ()
    then_penalty: float = 0.0


def feature_sets(weather: list[str], season: list[str], students: list[str]) -> dict[str, list[str]]:
    """The named sets of inputs that versions are compared on."""
    return {
        "weather": weather,
        "season": season,
        "students": students,
        "weather and season": [*weather, *season],
        "students and weather": [*students, *weather],
        "everything": [*students, *weather, *season],
    }


def r2_of_sets(df: DataFrame, sets: dict[str, list[str]], inputs: list[str], y: str) -> DataFrame:
    """(features, inputs, r2) of each named set, all from one set of sums over all inputs."""
    x = [CONSTANT, *inputs]
    row = gram(df, x, y).first()
    xx, xy = np.array(row["xx"], float).reshape(len(x), len(x)), np.array(row["xy"], float)
    spread, out = row["yy"] - xy[0] ** 2 / xx[0, 0], []
    for name, columns in sets.items():
        at = [0, *(x.index(c) for c in columns)]
        beta = np.linalg.pinv(xx[np.ix_(at, at)], hermitian=True) @ xy[at]
        out.append((name, len(columns), float(1 - (row["yy"] - beta @ xy[at]) / spread)))
    return df.sparkSession.createDataFrame(out, "features string, inputs int, r2 double")


def designs(inputs: list[str], season: list[str], basis: list[str]) -> dict[str, list[str]]:
    """The inputs of each kind of model: a constant and harmonics for lines, plain inputs for trees, a spline basis for smooth fits."""
    return {"linear": [CONSTANT, *inputs, *season], "trees": list(inputs), "smooth": [CONSTANT, *inputs, *season, *basis]}


def _ridge(xx: np.ndarray, xy: np.ndarray, at: list[int], constant: int, n: float, penalty: float) -> np.ndarray:
    """Coefficients for all columns, 0 outside ``at``; the penalty is on standardised columns, not on the constant."""
    part = xx[np.ix_(at, at)].copy()
    if penalty:
        mean = xx[constant, at] / n
        spread = np.diag(part) / n - mean * mean
        part[np.diag_indices(len(at))] += penalty * np.where(np.array(at) == constant, 0.0, np.maximum(spread, 0))
    out = np.zeros(len(xy))
    out[at] = np.linalg.pinv(part, hermitian=True) @ xy[at]
    return out


def _fit(member: Member, places: dict[str, int], xx: np.ndarray, xy: np.ndarray, n: float) -> np.ndarray:
    first = _ridge(xx, xy, [places[c] for c in member.columns], places[CONSTANT], n, member.penalty)
    if not member.then:
        return first
    return first + _ridge(xx, xy - xx @ first, [places[c] for c in member.then], places[CONSTANT], n, member.then_penalty)


def _weights(g: np.ndarray, c: np.ndarray) -> np.ndarray:
    w = non_negative(g, c)
    return w / w.sum() if w.sum() > 0 else np.full(len(c), 1 / len(c))


def combined(members: list[Member], few: list[str], betas: np.ndarray, g: np.ndarray, c: np.ndarray) -> dict[str, np.ndarray]:
    """Coefficients of the fixed combinations, from the members' and their out-of-fold sums ``g`` and ``c``."""
    names = [m.name for m in members]
    some = [names.index(n) for n in few]
    return {
        "stacked, all": _weights(g, c) @ betas,
        "stacked, few": _weights(g[np.ix_(some, some)], c[some]) @ betas[some],
        "mean of all": betas.mean(axis=0),
        "mean of few": betas[some].mean(axis=0),
        "chosen by cross-validation": betas[int(np.argmin(np.diag(g) - 2 * c))],
    }


def held_out_coefficients(df: DataFrame, members: list[Member], few: list[str], y: str, held: str, week: str, fold: str, buffer_days: int = 7) -> DataFrame:
    """(held, model, beta): every member's and combination's coefficients for each held-out period.

    ``fold`` deals the weeks to inner folds, from which the combinations learn.
    """
    columns = list(dict.fromkeys([CONSTANT, *(c for m in members for c in (*m.columns, *m.then))]))
    places, p = {c: k for k, c in enumerate(columns)}, len(columns)
    weeks = gram(df, columns, y, [week, fold])
    spans = df.groupBy(held).agg(F.date_sub(F.min(week), buffer_days).alias("__lo"), F.date_add(F.max(week), buffer_days).alias("__hi"))

    def summed(rows: DataFrame, *by: str) -> DataFrame:
        arrays = [F.array(*(F.sum(F.col(a)[k]) for k in range(size))).alias(a) for a, size in (("xx", p * p), ("xy", p))]
        return rows.groupBy(*by).agg(F.sum("n").alias("n"), *arrays)

    # one row per inner fold
    totals = {r[fold]: (np.array(r["xx"], float).reshape(p, p), np.array(r["xy"], float), float(r["n"])) for r in summed(weeks, fold).collect()}
    near = summed(weeks.join(spans, F.col(week).between(F.col("__lo"), F.col("__hi"))), held, fold)
    kind = df.schema[held].dataType.simpleString()

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        train = dict(totals)
        for _, r in rows.iterrows():
            xx, xy, n = train[r[fold]]
            train[r[fold]] = (xx - np.array(r["xx"], float).reshape(p, p), xy - np.array(r["xy"], float), n - r["n"])
        whole = [sum(part[k] for part in train.values()) for k in range(3)]
        betas = np.array([_fit(m, places, *whole) for m in members])
        g, c = np.zeros((len(members), len(members))), np.zeros(len(members))
        for xx, xy, n in train.values():
            inner = np.array([_fit(m, places, whole[0] - xx, whole[1] - xy, whole[2] - n) for m in members])
            g += inner @ xx @ inner.T
            c += inner @ xy
        found = {m.name: b for m, b in zip(members, betas)} | combined(members, few, betas, g, c)
        return pd.DataFrame({held: key[0], "model": list(found), "beta": [b.tolist() for b in found.values()]})

    return near.groupBy(held).applyInPandas(solve, f"{held} {kind}, model string, beta array<double>")


def held_out_predictions(df: DataFrame, coefficients: DataFrame, columns: list[str], held: str) -> DataFrame:
    """Every row with every model's prediction; ``columns`` are the design's, in the order of the coefficients."""
    guess = F.lit(0.0)
    for k, c in enumerate(columns):
        guess = guess + F.col(c) * F.col("beta")[k]
    return df.join(coefficients, held).withColumn("predicted", guess).drop("beta")


def model_search(df: DataFrame, members: list[Member], few: list[str], y: str, held: str, week: str, fold: str, buffer_days: int = 7) -> DataFrame:
    """Held-out predictions (``model``, ``predicted``) of all members and combinations for every row."""
    columns = list(dict.fromkeys([CONSTANT, *(c for m in members for c in (*m.columns, *m.then))]))
    return held_out_predictions(df, held_out_coefficients(df, members, few, y, held, week, fold, buffer_days), columns, held)


def coverage(predictions: DataFrame, y: str, period: str, by: list[str], level: float = 0.95) -> DataFrame:
    """Share of the rows of odd periods whose error lies within the ``level`` quantile of the errors of even periods."""
    e = F.abs(F.col(y) - F.col("predicted"))
    width = predictions.filter(F.col(period) % 2 == 0).groupBy(*by).agg(F.percentile(e, level).alias("__width"))
    return predictions.filter(F.col(period) % 2 == 1).join(width, by).groupBy(*by).agg(F.avg((e <= F.col("__width")).cast("int")).alias("coverage"))
