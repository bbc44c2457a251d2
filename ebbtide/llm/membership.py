"""Keeping or dropping whole rows by a list of ids or of row keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.plans.scratch import materialize

ROW = "__row"
#: Lists of at most this many ids may be broadcast; longer ones are joined by shuffling both sides.
BROADCAST_IDS = 1_000_000


def numbered(rows: DataFrame) -> DataFrame:
    """The rows with a written key of their own; ids may be null or repeated."""
    return materialize(rows.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def without(rows: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose key is not in ``ids``; rows with a null key stay."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_anti")
