"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.plans.scratch import materialize, release

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hang every larger neighbour of a node on the node's smallest neighbour; and a written table that this reads."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written, so that both sides of the join are shuffled and a hub's rows can be split over tasks
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hang a node and its smaller neighbours on the smallest of them; and a written table that this reads."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    rest = down.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))), least


def connected_components(edges: DataFrame, a: str, b: str, node: str = "node", component: str = "component") -> DataFrame:
    """The smallest reachable id of each node that has an edge.

    ``edges`` may hold repeats, loops and both directions.  Each round shuffles
    the edges on their ends; a hub's rows are only counted and joined, never
    gathered, and a round's edges are written to the shared folder.
    """
    now = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges"
    )
    for _ in range(MAX_ROUNDS):
        # a forest of stars: no node hangs on two others, no root hangs on another
        state = now.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("r"))
        roots = now.select(F.col("v").alias("u")).distinct().select("u", F.lit(0).alias("n"), F.lit(1).alias("r"))
        seen = state.unionByName(roots).groupBy("u").agg(F.sum("n").alias("n"), F.sum("r").alias("r"))
        if seen.filter("n > 1 or (n > 0 and r > 0)").isEmpty():
            break
        large, least = _large_star(now)
        between = materialize(large.distinct(), "edges")
        release(now, least)
        small, least = _small_star(between)
        now = materialize(small.distinct(), "edges")
        release(between, least)  # the disk holds one round
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    leaves = now.select(F.col("u").alias(node), F.col("v").alias(component))
    return leaves.unionByName(now.select(F.col("v").alias(node), F.col("v").alias(component)).distinct())
