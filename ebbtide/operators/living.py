"""Living arrangements: weighted survey counts split over towns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def main_vintage(people: DataFrame, codes: list[str], weight: str = "weight") -> DataFrame:
    """Keep the records of the area coding that most have, with weights scaled so that they still sum to all."""
    known = [F.count(c).alias(c) for c in codes]
    counts = people.agg(*known, F.sum(weight).alias("__all"), *(F.sum(F.when(F.col(c).isNotNull(), F.col(weight))).alias(f"__w_{c}") for c in codes)).first()
    main = max(codes, key=lambda c: (counts[c], -codes.index(c)))
    scale = counts["__all"] / counts[f"__w_{main}"] if counts[f"__w_{main}"] else 0.0
    return people.filter(F.col(main).isNotNull()).withColumns({"area": F.col(main), weight: F.col(weight) * float(scale)})


def area_counts(people: DataFrame) -> DataFrame:
    """Weighted students by area and arrangement."""
    w = F.col("weight")
    return people.groupBy("area").agg(
        *(F.coalesce(F.sum(F.when(condition, w)), F.lit(0.0)).alias(name) for name, condition in (("students", F.col("student")), ("group_quarters", F.col("student") & (F.col("relation") == 17)), ("with_parents", F.col("student") & F.col("relation").isin(2, 3))))
    )


def split_over_towns(areas: DataFrame, shares: DataFrame, beds: DataFrame) -> DataFrame:
    """Areas' counts dealt to towns by share; a town's group quarters are capped by its beds, the rest lives elsewhere."""
    dealt = areas.join(shares, "area").groupBy("town").agg(*(F.sum(F.col(c) * F.col("share")).alias(c) for c in ("students", "group_quarters", "with_parents")))
    housed = F.least(F.col("group_quarters"), F.coalesce("beds", F.lit(0.0)))
    return dealt.join(beds, "town", "left").select(
        "town", "students", housed.alias("in_university_housing"), "with_parents", (F.col("students") - housed - F.col("with_parents")).alias("elsewhere")
    )
