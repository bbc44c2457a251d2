"""Global ranks without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ebbtide.plans.scratch import materialize

_PART_BITS = 33


def global_rank(df: DataFrame, order: list[str | Column], rank: str = "rank") -> DataFrame:
    """Number all rows from 0 in the given order; equal rows in any order.

    One range shuffle sorts the rows.  Each partition's row count is the only
    thing gathered, so no partition or task ever sees more than its own range.
    Add a unique column to ``order`` so that ties can be dealt over partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = "__place"
    sorted_rows = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn(place, F.monotonically_increasing_id())
    )
    held = materialize(sorted_rows, "ranked")
    part = F.shiftright(F.col(place), _PART_BITS)
    counts = held.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__rows"))
    # one row per shuffle partition: bounded by spark.sql.shuffle.partitions
    before = F.sum("__rows").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    return (
        held.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .withColumn(rank, F.col("__before") + F.col(place).bitwiseAND((1 << _PART_BITS) - 1))
        .drop("__part", "__before", place)
    )


def running_total(df: DataFrame, order: list[str | Column], value: str, before: str = "before", rank: str = "rank") -> DataFrame:
    """Number all rows from 0 in the given order and add up the values of the rows before each; nulls count as 0.

    As in ``global_rank``, a range shuffle sorts the rows and each partition hands on
    its row count and sum alone.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place, part = "__place", "__part"
    sorted_rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    held = materialize(sorted_rows, "ranked").withColumn(part, F.shiftright(place, _PART_BITS))
    amount = F.coalesce(F.col(value).cast("long"), F.lit(0))
    sums = held.groupBy(part).agg(F.count(F.lit(1)).alias("__rows"), F.sum(amount).alias("__sum"))
    # one row per shuffle partition: bounded by spark.sql.shuffle.partitions
    earlier = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(part, *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("__rows", "__sum")))
    inside = W.partitionBy(part).orderBy(place).rowsBetween(W.unboundedPreceding, -1)
    return (
        held.withColumn("__inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .join(F.broadcast(offsets), part)
        .withColumn(rank, F.col("__rows_before") + F.col(place).bitwiseAND((1 << _PART_BITS) - 1))
        .withColumn(before, F.col("__sum_before") + F.col("__inside"))
        .drop(part, place, "__inside", "__rows_before", "__sum_before")
    )


def top_groups(df: DataFrame, group: str, value: str, number: int, label: str = "label") -> DataFrame:
    """Label the ``number`` groups of largest total by name (ties by name), all others by one label with their count."""
    totals = df.groupBy(group).agg(F.sum(value).alias("__total"))
    top = totals.orderBy(F.desc("__total"), group).limit(number).select(group, F.lit(True).alias("__top"))
    many = totals.agg(F.count(F.lit(1)).alias("__many"))
    # the two tables are ``number`` rows and one row
    marked = df.join(F.broadcast(top), group, "left").crossJoin(F.broadcast(many))
    other = F.concat(F.lit("All other ("), F.col("__many") - number, F.lit(")"))
    return marked.withColumn(label, F.when(F.col("__top"), F.col(group)).otherwise(other)).drop("__top", "__many")
