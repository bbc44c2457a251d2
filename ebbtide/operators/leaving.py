"""How many leave: two-equation fits of weekly slopes, shares common to several signals, and what follows from them.

A week has a weekday and a weekend slope.  Weekdays show all who are out of
session, weekends those who left, both through the same factor k:

    weekday = c  + k * out
    weekend = c' + k * share away

so k comes from the calendar and the share away from the weekends.  All inputs
are deviations from their mean over the year.  A fit needs only sums of products
of a week's numbers; versions differ by which column stands for the share away.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ebbtide.operators import resample
from ebbtide.plans.scratch import materialize

INPUTS = ("out", "summer", "breaks", "thanksgiving", "winter", "spring", "min_share", "max_share")
#: Versions whose share away is a given column, and those that estimate one share per part.
GIVEN = {"nobody leaves": None, "closed halls only": "min_share", "all who could leave": "max_share"}
ESTIMATED = {"one share": ("out",), "summer and breaks": ("summer", "breaks"), "by kind of break": ("summer", "thanksgiving", "winter", "spring")}
VERSIONS = (*GIVEN, *ESTIMATED)
#: The version that the estimate's k is read from.
MAIN = "all who could leave"
#: A week's numbers, in the order of its sums of products.
NUMBERS = ("one", *INPUTS, "weekday", "weekend")
DAYS = ("weekday", "weekend")
DRAWS = 1000
BUFFER_DAYS = 7


def deviations(weeks: DataFrame, by: list[str] | None = None, week: str = "week_start") -> DataFrame:
    """Inputs less their mean over the weeks of the same year, in place."""
    year = W.partitionBy(*(by or []), F.year(week))
    return weeks.withColumns({c: F.col(c) - F.avg(c).over(year) for c in INPUTS})


def equations(version: str) -> tuple[np.ndarray, np.ndarray]:
    """Matrices that turn a week's numbers into its weekday and weekend rows of the design: c, c', k, one column per part."""
    parts = ESTIMATED.get(version, ())
    weekday, weekend = np.zeros((2, len(NUMBERS), 3 + len(parts)))
    weekday[NUMBERS.index("one"), 0] = weekday[NUMBERS.index("out"), 2] = weekend[NUMBERS.index("one"), 1] = 1
    if GIVEN.get(version):
        weekend[NUMBERS.index(GIVEN[version]), 2] = 1
    for k, part in enumerate(parts):
        weekend[NUMBERS.index(part), 3 + k] = 1
    return weekday, weekend


def solve_version(sums: np.ndarray, version: str) -> np.ndarray:
    """Coefficients from sums of products, (..., numbers, numbers); the solution of least norm where columns coincide."""
    a, b = equations(version)
    left = a.T @ sums @ a + b.T @ sums @ b
    right = a.T @ sums[..., NUMBERS.index("weekday")][..., None] + b.T @ sums[..., NUMBERS.index("weekend")][..., None]
    return (np.linalg.pinv(left, hermitian=True) @ right)[..., 0]


def shares(beta: np.ndarray) -> np.ndarray:
    """Share away of each part of an estimated version; NaN where k is 0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(beta[..., 2:3] != 0, beta[..., 3:] / beta[..., 2:3], np.nan)


def draw_counts(draws: int, blocks: int, seed: int = 1) -> np.ndarray:
    """How often each draw takes each block, as ``resample.draw_blocks`` deals them."""
    out = np.zeros((draws, blocks))
    for draw in range(draws):
        for i in range(blocks):
            out[draw, int(hashlib.md5(f"{seed}-{draw}-{i}".encode()).hexdigest()[:15], 16) % blocks] += 1
    return out


def _cell(weeks: pd.DataFrame, draws: int, seed: int) -> list[tuple]:
    """(version, metric, estimate, low, high) of one cell of a grid: its weekly rows are its whole input."""
    z = weeks[list(NUMBERS)].to_numpy(float)
    start = pd.to_datetime(weeks["week_start"]).to_numpy().astype("datetime64[D]")
    month = start.astype("datetime64[M]")
    names, block = np.unique(month, return_inverse=True)
    sums = np.zeros((len(names), len(NUMBERS), len(NUMBERS)))
    np.add.at(sums, block, z[:, :, None] * z[:, None, :])
    total = sums.sum(axis=0)
    drawn = np.tensordot(draw_counts(draws, len(names), seed), sums, 1)
    near = [(start >= start[block == k].min() - BUFFER_DAYS) & (start <= start[block == k].max() + BUFFER_DAYS) for k in range(len(names))]
    kept = np.array([total - z[n].T @ z[n] for n in near])
    observed, out, none = z[:, NUMBERS.index("weekend")], [], None
    for day in DAYS:
        column, calendar = z[:, NUMBERS.index(day)], weeks["out_level"].to_numpy(float)
        spread = column.std() * calendar.std()
        r = float(((column - column.mean()) * (calendar - calendar.mean())).mean() / spread) if spread > 0 else None
        out.append(("weekly slopes", f"correlation_{day}", r, None, None))
    for version in VERSIONS:
        beta, refits = solve_version(total, version), solve_version(drawn, version)
        names_of = ("k", *ESTIMATED.get(version, ()))
        values = np.concatenate([beta[2:3], shares(beta)])
        spread = np.concatenate([refits[:, 2:3], shares(refits)], axis=1)
        low, high = np.percentile(spread, [2.5, 97.5], axis=0)
        out += [(version, name, *map(float, triple)) for name, *triple in zip(names_of, values, low, high)]
        # each month from a fit on the weeks outside it and its buffer
        predicted = ((z @ equations(version)[1]) * solve_version(kept, version)[block]).sum(axis=1)
        rmse = float(np.sqrt(((observed - predicted) ** 2).mean()))
        none = rmse if none is None else none
        out += [(version, "held_out_rmse", rmse, None, None), (version, "rmse_change_percent", (rmse / none - 1) * 100 if none else None, None, None)]
    return out


def fit_grid(weeks: DataFrame, by: list[str], draws: int = DRAWS, seed: int = 1) -> DataFrame:
    """Every version in every cell: k and shares with intervals over draws of months, held-out error and its change.

    ``weeks`` has ``by``, week_start, the inputs as deviations, ``out_level`` and both slopes.  A cell's weeks, a few
    hundred, meet in one task, where draws and hold-outs are solved from its months' sums of products.
    """
    kinds = ", ".join(f"{c} {weeks.schema[c].dataType.simpleString()}" for c in by)
    schema = f"{kinds}, version string, metric string, estimate double, low double, high double, weeks long"

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = pd.DataFrame(_cell(rows.sort_values("week_start"), draws, seed), columns=["version", "metric", "estimate", "low", "high"])
        for name, value in zip(by, key):
            found[name] = value
        return found.assign(weeks=len(rows))[[*by, "version", "metric", "estimate", "low", "high", "weeks"]]

    return weeks.withColumn("one", F.lit(1.0)).groupBy(*by).applyInPandas(run, schema)


def product_sums(weeks: DataFrame, by: list[str]) -> DataFrame:
    """One row per group: ``n`` and the sums of products of a week's numbers, row by row."""
    z = weeks.withColumn("one", F.lit(1.0))
    return z.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*(F.sum(F.col(a) * F.col(b)) for a in NUMBERS for b in NUMBERS)).alias("sums"))


def coefficients(sums: DataFrame, by: list[str]) -> DataFrame:
    """(by, version, beta): all versions solved from each row's sums, in tasks."""
    kinds = ", ".join(f"{c} {sums.schema[c].dataType.simpleString()}" for c in by)

    def run(batches):
        for part in batches:
            if len(part):
                held = np.stack(part["sums"].to_numpy()).reshape(-1, len(NUMBERS), len(NUMBERS))
                yield pd.concat([part[by].assign(version=v, beta=list(solve_version(held, v))) for v in VERSIONS])

    return sums.select(*by, "sums").mapInPandas(run, f"{kinds}, version string, beta array<double>")


def predicted(day: str, beta: str = "beta", version: str = "version") -> Column:
    """The slope that a version's coefficients give for a week; an unknown version gives null."""
    out = F.lit(None).cast("double")
    for name in VERSIONS:
        matrix = equations(name)[DAYS.index(day)]
        terms = [(F.lit(1.0) if NUMBERS[i] == "one" else F.col(NUMBERS[i])) * F.col(beta)[k] for k in range(matrix.shape[1]) for i in np.flatnonzero(matrix[:, k]).tolist()]
        out = F.when(F.col(version) == name, sum(terms[1:], terms[0])).otherwise(out)
    return out


def forward_scores(weeks: DataFrame, splits: DataFrame, by: list[str]) -> DataFrame:
    """Every version fitted on earlier years and scored on the weekend slopes of later ones, against nobody leaving.

    ``splits`` has evaluation, train_from, train_to, test_from and test_to (years).  Sums of products run over the
    years, so the fit on a run of years is a difference of two rows of them.
    """
    yearly = materialize(product_sums(weeks, [*by, F.year("week_start").alias("year")]), "yearly")
    many = len(NUMBERS) ** 2
    order = W.partitionBy(*by).orderBy("year")
    running = yearly.select(*by, "year", F.array(*(F.sum(F.col("sums")[k]).over(order) for k in range(many))).alias("upto"), F.array(*(F.sum(F.col("sums")[k]).over(order) - F.col("sums")[k] for k in range(many))).alias("before"))
    keys = [*by, *splits.columns]
    inside = yearly.select(*by, "year").join(splits, F.col("year").between(F.col("train_from"), F.col("train_to")))
    ends = inside.groupBy(*keys).agg(F.min("year").alias("first"), F.max("year").alias("last"))
    low, high = running.select(*by, F.col("year").alias("first"), "before"), running.select(*by, F.col("year").alias("last"), "upto")
    train = ends.join(low, [*by, "first"]).join(high, [*by, "last"]).select(*keys, F.zip_with("upto", "before", lambda a, b: a - b).alias("sums"))
    fitted = materialize(coefficients(train, keys), "fitted")
    test = weeks.withColumn("year", F.year("week_start")).join(fitted, by).filter(F.col("year").between(F.col("test_from"), F.col("test_to")))
    error = F.col("weekend") - predicted("weekend")
    scored = test.groupBy(*keys, "version").agg(F.sqrt(F.avg(error * error)).alias("rmse"), F.count(F.lit(1)).alias("weeks"))
    baseline = scored.filter(F.col("version") == VERSIONS[0]).select(*keys, F.col("rmse").alias("none"))
    learnt = fitted.select(*keys, "version", F.when(F.size("beta") > 3, F.transform(F.slice("beta", 4, 4), lambda b: F.try_divide(b, F.col("beta")[2]))).alias("shares"), F.col("beta")[2].alias("k"))
    change = 100 * (F.try_divide("rmse", "none") - 1)
    return scored.join(baseline, keys).withColumn("change_percent", change).drop("none").join(learnt, [*keys, "version"])


def size_check(weeks: DataFrame, beta: np.ndarray, by: list[str], version: str = MAIN, draws: int = DRAWS, seed: int = 1) -> DataFrame:
    """Slope through the origin of the observed on the predicted change, by day, with an interval over draws of months.

    The predicted change is the model's slope less its constant.  Only sums per month are drawn.
    """
    fitted = F.array(*(F.lit(float(b)) for b in beta))
    rows = weeks.withColumns({"month": F.date_format("week_start", "yyyy-MM"), "beta": fitted, "version": F.lit(version)})
    pairs = F.explode(F.array(*(F.struct(F.lit(d).alias("day"), (F.col(d) - float(beta[i])).alias("o"), (predicted(d) - float(beta[i])).alias("p")) for i, d in enumerate(DAYS))))
    long = rows.select(*by, "month", pairs.alias("v")).select(*by, "month", "v.*")
    cells = materialize(long.groupBy(*by, "day", "month").agg(F.sum(F.col("p") * F.col("o")).alias("po"), F.sum(F.col("p") * F.col("p")).alias("pp"), F.count(F.lit(1)).alias("n")), "cells")
    keys = [*by, "day"]
    numbered = materialize(cells.withColumn("block", (F.row_number().over(W.partitionBy(*keys).orderBy("month")) - 1).cast("int")).withColumn("blocks", F.count(F.lit(1)).over(W.partitionBy(*keys)).cast("int")), "numbered")
    spark, times = weeks.sparkSession, None
    for (many,) in numbered.select("blocks").distinct().collect():  # one row per number of months in a cell
        drawn = resample.draw_blocks(spark, draws, many, seed=seed).withColumn("blocks", F.lit(many))
        times = drawn if times is None else times.unionByName(drawn)
    if times is None:
        times = resample.draw_blocks(spark, 0, 1).withColumn("blocks", F.lit(1))
    ratios = numbered.join(times, ["blocks", "block"]).groupBy(*keys, "draw").agg(F.try_divide(F.sum(F.col("times") * F.col("po")), F.sum(F.col("times") * F.col("pp"))).alias("size"))
    estimate = cells.groupBy(*keys).agg(F.try_divide(F.sum("po"), F.sum("pp")).alias("size"), F.sum("n").alias("weeks"))
    return estimate.join(resample.interval(ratios, "size", keys).select(*keys, "low", "high"), keys)


# --- shares common to several signals


class JointSums:
    """Sums of products of both days of several signals; a leading axis may hold draws.

    ``n``, ``y``, ``yy``: (..., signals, 2); ``x``, ``xy``: (..., signals, 2, 2); ``xx``: (..., signals, 2, 2, 2).  The
    weekday has one input, in the first place.
    """

    def __init__(self, n, y, yy, x, xy, xx):
        self.n, self.y, self.yy, self.x, self.xy, self.xx = n, y, yy, x, xy, xx

    def direction(self, share: np.ndarray) -> np.ndarray:
        """The combination of inputs that k multiplies: (..., 1, 2, 2); its weekday is fixed at 1."""
        fixed = np.zeros_like(share)
        fixed[..., 0] = 1
        return np.stack([fixed, share], axis=-2)[..., None, :, :]

    def solve(self, weight: np.ndarray, share: np.ndarray, rounds: int = 2000) -> tuple[np.ndarray, np.ndarray]:
        """Shares and k of least weighted squares: the two are solved for by turns."""
        for _ in range(rounds):
            d = self.direction(share)
            top = (weight * (d * self.xy).sum(-1)).sum(-1)
            bottom = (weight * np.einsum("...i,...ij,...j", d, self.xx, d)).sum(-1)
            k = top / np.where(bottom > 0, bottom, 1)
            w = weight[..., 1] * k * k
            left = (w[..., None, None] * self.xx[..., 1, :, :]).sum(-3)
            right = ((weight[..., 1] * k)[..., None] * self.xy[..., 1, :]).sum(-2)
            new = (np.linalg.pinv(left, hermitian=True) @ right[..., None])[..., 0]
            done = np.abs(new - share).max() < 1e-13
            share = new
            if done:
                break
        return share, k

    def noise(self, share: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Inverse variance of each signal's and day's residuals around their mean."""
        d = self.direction(share) * k[..., None, None]
        squares = self.yy - 2 * (d * self.xy).sum(-1) + np.einsum("...i,...ij,...j", d, self.xx, d)
        n = np.maximum(self.n, 1)
        mean = (self.y - (d * self.x).sum(-1)) / n
        return 1 / np.maximum(squares / n - mean * mean, 1e-300)

    def fit(self) -> tuple[np.ndarray, np.ndarray]:
        """Two steps: equal weights, then each signal and day by its noise."""
        start = np.full((*self.n.shape[:-2], 2), 0.8)
        share, k = self.solve(np.ones_like(self.n), start)
        return self.solve(self.noise(share, k), share)


def _joint(rows: pd.DataFrame, signals: list[str], draws: int, seed: int, inflation: float) -> list[tuple]:
    months, block = np.unique(rows["month"].to_numpy(str), return_inverse=True)
    signal = np.array([signals.index(s) for s in rows["signal"]])
    day = np.array([DAYS.index(d) for d in rows["day"]])
    y, x = rows["y"].to_numpy(float), rows[["x1", "x2"]].to_numpy(float)

    def summed(values: np.ndarray) -> np.ndarray:
        out = np.zeros((len(months), len(signals), 2, *values.shape[1:]))
        np.add.at(out, (block, signal, day), values)
        return out

    monthly = [summed(v) for v in (np.ones(len(y)), y, y * y, x, x * y[:, None], x[:, :, None] * x[:, None, :])]
    share, k = JointSums(*(m.sum(axis=0) for m in monthly)).fit()
    counts = draw_counts(draws, len(months), seed)
    refits = np.concatenate(JointSums(*(np.tensordot(counts, m, 1) for m in monthly)).fit(), axis=-1)
    point = np.concatenate([share, k])
    low, high = np.percentile(point + inflation * (refits - point), [2.5, 97.5], axis=0)
    names = ["share_summer", "share_breaks", *(f"k_{s}" for s in signals)]
    return [(n, float(v), float(a), float(b)) for n, v, a, b in zip(names, point, low, high)]


def joint_shares(pieces: DataFrame, combinations: dict[str, list[str]], draws: int = DRAWS, seed: int = 1, inflation: float = 1.4) -> DataFrame:
    """Shares away that several signals have in common and a k for each, for every combination of signals.

    ``pieces`` has signal, day, month, y, x1 and x2: on weekdays x1 is the share out of session and counts whole, which
    fixes k; on weekends x1 and x2 are summer and breaks, whose coefficients over k are the shares.  Intervals refit
    both steps on drawn months and are widened.
    """
    sets = pieces.sparkSession.createDataFrame([(label, s, ",".join(names)) for label, names in combinations.items() for s in names], "signals string, signal string, members string")
    schema = "signals string, parameter string, estimate double, low double, high double, signal_weeks long"

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = _joint(rows, rows["members"].iloc[0].split(","), draws, seed, inflation)
        return pd.DataFrame(found, columns=["parameter", "estimate", "low", "high"]).assign(signals=key[0], signal_weeks=len(rows))[["signals", "parameter", "estimate", "low", "high", "signal_weeks"]]

    # a combination's weeks and days meet in one task
    return pieces.join(sets, "signal").groupBy("signals").applyInPandas(run, schema)


# --- what follows from the fits


def read_off(weeks: DataFrame, slope: str, constant: Column, k: Column, factor: Column, level: str, week: str = "week_start") -> DataFrame:
    """Share away of each week read from its slope, at the mean of ``level`` over the year."""
    year = W.partitionBy(F.year(week))
    return weeks.withColumn("read_off", F.try_divide(F.col(slope) - constant, k * factor) + F.avg(level).over(year))


def input_set_errors(slopes: DataFrame, sets: DataFrame, beta: np.ndarray, version: str = MAIN) -> DataFrame:
    """RMSE by year, set of inputs and day of slopes predicted through fitted coefficients.

    ``slopes`` has week_start and both slopes; ``sets`` has ``inputs``, week_start and the inputs.
    """
    rows = deviations(slopes.join(sets, "week_start"), ["inputs"])
    rows = rows.withColumns({"beta": F.array(*(F.lit(float(b)) for b in beta)), "version": F.lit(version), "year": F.year("week_start")})
    errors = F.explode(F.array(*(F.struct(F.lit(d).alias("day"), (F.col(d) - predicted(d)).alias("e")) for d in DAYS)))
    long = rows.select("year", "inputs", errors.alias("v")).select("year", "inputs", "v.*")
    return long.groupBy("year", "inputs", "day").agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.count(F.lit(1)).alias("weeks"))


def draws_divided(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Quotient of two independent sets of draws, draw by draw."""
    return a.join(b.select("draw", F.col(value).alias("__by")), "draw").withColumn(value, F.try_divide(value, "__by")).drop("__by")


def corrected_slopes(sums: DataFrame, factors: DataFrame, x: Column) -> DataFrame:
    """Slopes when an input is scaled by each factor: x becomes c x, so sums need no second pass."""
    grid = sums.crossJoin(F.broadcast(factors))
    c = F.col("factor")
    return grid.withColumn("slope", (F.col("n") * c * F.col("sxy") - c * F.col("sx") * F.col("sy")) / (F.col("n") * c * c * F.col("sxx") - c * c * F.col("sx") * F.col("sx")))


def rmse_ratio(errors: DataFrame, model: str, baseline: str, draws: DataFrame, block: str) -> DataFrame:
    """Per draw, the ratio of two models' RMSE on the same resampled blocks."""
    cells = errors.groupBy(block).agg(F.sum(F.col(model) * F.col(model)).alias("a"), F.sum(F.col(baseline) * F.col(baseline)).alias("b"))
    joined = cells.join(draws, block)
    return joined.groupBy("draw").agg(F.sqrt(F.try_divide(F.sum(F.col("times") * F.col("a")), F.sum(F.col("times") * F.col("b")))).alias("ratio"))
