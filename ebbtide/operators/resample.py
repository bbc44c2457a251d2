"""Block bootstraps on pre-aggregated cells.

A draw is a table of multiplicities, how often a block is taken; rows are never
resampled.  Blocks are drawn with replacement by a hash of seed, draw and pick,
which any engine can repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def draw_blocks(spark: SparkSession, draws: int, blocks: int, picks: int | None = None, seed: int = 1) -> DataFrame:
    """(draw, block, times): ``picks`` blocks (as many as there are) taken with replacement."""
    each = spark.range(draws).select(F.col("id").cast("int").alias("draw")).crossJoin(spark.range(blocks if picks is None else picks).select(F.col("id").cast("int").alias("i")))
    digits = F.substring(F.md5(F.concat_ws("-", F.lit(seed), F.col("draw"), F.col("i"))), 1, 15)  # 60 bits
    block = F.conv(digits, 16, 10).cast("long") % blocks
    return each.groupBy("draw", block.cast("int").alias("block")).agg(F.count(F.lit(1)).alias("times"))


def moving_runs(cells: DataFrame, run: int, values: list[str], block: str = "block") -> tuple[DataFrame, int, int]:
    """Sums over each run of ``run`` consecutive blocks by its first block, the number of such runs, and how many cover all blocks.

    Runs lie inside the blocks, so none wraps from the end to the beginning; with fewer blocks than ``run`` the
    one run is all of them.  A run is a difference of two rows of running sums over the blocks, a short table.
    """
    many = cells.count()
    run = max(1, min(run, many))
    order = W.orderBy(block)
    running = cells.select(block, *(F.sum(c).over(order).alias(c) for c in values))
    before = running.select((F.col(block) + run).alias(block), *(F.col(c).alias(f"__{c}") for c in values))
    runs = running.filter(F.col(block) >= run - 1).join(before, block, "left")
    return runs.select((F.col(block) - (run - 1)).alias(block), *((F.col(c) - F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in values)), many - run + 1, -(-many // run)


def numbered(df: DataFrame, key: str, name: str = "block") -> DataFrame:
    """The distinct values of a short key, numbered from 0 in order."""
    return df.select(key).distinct().withColumn(name, F.row_number().over(W.orderBy(key)) - 1)


def weighted_sums(cells: DataFrame, multiplicities: list[DataFrame], values: dict[str, Column]) -> DataFrame:
    """Per draw, sums over cells weighted by the product of the cells' multiplicities.

    Draws times blocks grow with the data, so nothing is broadcast by force.
    """
    joined, weight = cells, F.lit(1)
    for k, times in enumerate(multiplicities):
        on = ["draw", *(c for c in times.columns if c not in ("draw", "times"))] if k else [c for c in times.columns if c not in ("draw", "times")]
        joined = joined.join(times.withColumnRenamed("times", f"__t{k}"), on)
        weight = weight * F.col(f"__t{k}")
    return joined.groupBy("draw").agg(*(F.sum(weight * v).alias(name) for name, v in values.items()))


def interval(df: DataFrame, value: str, by: list[str] | None = None, level: float = 0.95) -> DataFrame:
    """Percentile interval over draws."""
    low = (1 - level) / 2
    return df.groupBy(*(by or [])).agg(F.percentile(value, low).alias("low"), F.percentile(value, 1 - low).alias("high"), F.count(value).alias("draws"))


def widen(draws: DataFrame, value: str, estimate: Column, factor: float) -> DataFrame:
    """Move draws away from the estimate by a factor."""
    return draws.withColumn(value, estimate + factor * (F.col(value) - estimate))


def band(weeks: DataFrame, draws: DataFrame, guess: Column, low: Column, high: Column, by: str = "week_start") -> DataFrame:
    """Percentile band of a clamped guess over all draws, per week."""
    value = F.least(F.greatest(guess, low), high)
    crossed = weeks.crossJoin(draws).withColumn("__v", value)  # a few hundred weeks by the draws
    return crossed.groupBy(by).agg(F.percentile("__v", 0.025).alias("low"), F.percentile("__v", 0.975).alias("high"))


def coverage(replications: DataFrame, by: list[str]) -> DataFrame:
    """Share of replications whose interval holds the truth, on average and for the worst truth."""
    held = replications.withColumn("__in", F.col("truth").between(F.col("low"), F.col("high")).cast("int"))
    per = held.groupBy(*by, "truth").agg(F.avg("__in").alias("__share"))
    return per.groupBy(*by).agg(F.avg("__share").alias("mean_coverage"), F.min("__share").alias("worst_coverage"))
