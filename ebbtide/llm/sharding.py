"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every key has a place on a 64-bit ring and belongs to the virtual node that
follows it.  A shard takes keys up to its capacity; keys that overflow a full
shard continue clockwise to the next virtual node whose shard has room.  With
the capacities used here (row counts that differ by one at most and add up to
all rows) the balance is exact, and only overflowing keys leave their home.

Only counts per arc are planned, on ``shards * virtual_nodes`` numbers; rows
then take the planned places by their rank along the ring.

Nulls and edge cases: a null key has a ring place of its own; repeated keys and
repeated rows are all placed, and all written; rows at one ring place (equal
keys) fill it in any order; a null or empty text has size 1 and CRC 0; texts of
any length count with all their bytes; older columns named home_shard, shard or
slot are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.membership import ROW, numbered
from ebbtide.operators.ranking import global_rank

_MASK = (1 << 64) - 1
_CELL_BITS = 12


def _mixed(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def ring(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes in ring order; places are signed 64-bit."""
    nodes = {_mixed((s << 32) | v) - (1 << 63): s for s in range(shards) for v in range(virtual_nodes)}
    return sorted(nodes.items())


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def place_counts(counts: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Planned runs (arc, first, end, shard, first slot) of ranks within arcs.

    ``counts`` and ``owners`` are in ring order.  Home keys come first, in ring
    order; then each arc's overflow walks clockwise.
    """
    room, used, runs, over = list(room), [0] * len(room), [], []
    for arc, (count, shard) in enumerate(zip(counts, owners)):
        taken = min(count, room[shard])
        if taken:
            runs.append((arc, 0, taken, shard, used[shard]))
            room[shard] -= taken
            used[shard] += taken
        if taken < count:
            over.append((arc, taken, count))
    for arc, first, end in over:
        step = 1
        while first < end:
            shard = owners[(arc + step) % len(owners)]
            taken = min(end - first, room[shard])
            if taken:
                runs.append((arc, first, first + taken, shard, used[shard]))
                room[shard] -= taken
                used[shard] += taken
                first += taken
            step += 1
    return runs


def _cells(places: list[int]) -> list[tuple[int, int, int, int]]:
    """(cell, first place, last place, arc): which arc a place lies on, by its leading bits."""
    width, out = 1 << (64 - _CELL_BITS), []
    for cell in range(1 << _CELL_BITS):
        low = cell * width - (1 << 63)
        high = low + width - 1
        arc, last = bisect_left(places, low), bisect_left(places, high)
        while arc < last:
            out.append((cell, low, places[arc], arc))
            low, arc = places[arc] + 1, arc + 1
        out.append((cell, low, high, last))
    return out


def shard_by_ring(df: DataFrame, key: str, shards: int, virtual_nodes: int = 64) -> DataFrame:
    """Add ``home_shard`` (before any overflow), ``shard`` and a gapless ``slot``.

    Carry only narrow columns through this (ids, sizes): all columns of ``df``
    are sorted along the ring once.
    """
    spark = df.sparkSession
    df = df.drop("home_shard", "shard", "slot")
    nodes = ring(shards, virtual_nodes)
    owners = [s for _, s in nodes] + [nodes[0][1]]  # behind the last node the ring begins again
    placed = df.withColumn("__at", F.xxhash64(F.col(key))).withColumn("__tie", F.monotonically_increasing_id())
    ranked = global_rank(placed, ["__at", "__tie"], "__rank")
    cells = spark.createDataFrame(_cells([p for p, _ in nodes]), "__cell int, __low long, __high long, __arc int")
    cell = (F.shiftright("__at", 64 - _CELL_BITS) + (1 << (_CELL_BITS - 1))).cast("int")
    # both broadcast tables are bounded by the ring: cells and virtual nodes
    on_arc = ranked.withColumn("__cell", cell).join(
        F.broadcast(cells), (cell == cells["__cell"]) & F.col("__at").between(F.col("__low"), F.col("__high"))
    )
    found = {r[0]: r[1] for r in on_arc.groupBy("__arc").count().collect()}
    counts = [found.get(arc, 0) for arc in range(len(owners))]
    begins = [0]
    for count in counts:
        begins.append(begins[-1] + count)
    runs = place_counts(counts, owners, capacities(begins[-1], shards))
    plan = [(a, begins[a] + lo, begins[a] + hi, owners[a], s, slot) for a, lo, hi, s, slot in runs]
    planned = spark.createDataFrame(plan, "__run_arc int, __first long, __end long, home_shard int, shard int, __slot long")
    return (
        on_arc.join(
            F.broadcast(planned),
            (F.col("__arc") == F.col("__run_arc")) & (F.col("__rank") >= F.col("__first")) & (F.col("__rank") < F.col("__end")),
        )
        .withColumn("slot", F.col("__slot") + F.col("__rank") - F.col("__first"))
        .select(*df.columns, "home_shard", "shard", "slot")
    )


def shard_documents(docs: DataFrame, shards: int, virtual_nodes: int = 64) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, home_shard, shard and slot of all documents."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    return shard_by_ring(narrow, "doc_id", shards, virtual_nodes)


def write_shards(docs: DataFrame, shards: int, path: str, virtual_nodes: int = 64) -> None:
    """Write every row of ``docs`` once, one folder per shard, rows in slot order within each file.

    Rows carry a written key of their own, so null and repeated ids are kept apart.
    """
    rows = numbered(docs.drop("home_shard", "shard", "slot"))
    placed = shard_by_ring(rows.select(ROW, "doc_id"), "doc_id", shards, virtual_nodes)
    whole = rows.join(placed.select(ROW, "shard", "slot"), ROW).drop(ROW)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
