"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so set similarity says little; what
counts is the share of an item's shingles that a document contains.  Items are
partitioned by the size of their shingle sets.  A partition of small sets keeps
all shingles, one of larger sets keeps each permutation's minimal shingle: a
document that contains a share c of an item contains each of these with
probability c.  A document with enough of an item's kept shingles is verified
against the item's full set.

The search runs over the items in blocks of bounded size, one after another:
each is sent to all tasks, scans the documents without any shuffle, writes its
pairs and is let go.  A benchmark of b blocks reads the documents b times.

Nulls and edge cases: null, empty or word-free texts contain nothing and are
contained in nothing; items without item_id are left out, documents without
doc_id are not; repeated rows each give their rows; every document that
contains an item is reported, so there are no ties to break; a very long
document is hashed whole, and an item with more shingles than a block is a
block of its own; columns other than ids and text are ignored; an empty table
on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm import textkit

THRESHOLD = 0.75
#: (largest set size, permutations); no permutations: all shingles are kept.
PARTITIONS = ((32, 0), (256, 64), (1 << 62, 128))
#: Share of an item's sketch that a document must contain to be verified. At a
#: containment of 0.75 a sketch of 64 falls below half with probability 1e-5,
#: below 0.375 with 1e-10.
LIKELY = 0.375
#: Shingles in one block of items, which each task holds: 16 MB.
BLOCK_SHINGLES = 2_000_000
_BITS = 20

_MUL, _ADD = textkit.seeded(128, 29), textkit.seeded(128, 31)
_PAIRS = "doc_id long, item_id long, common long, item_shingles long"


def sketch(items: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Kept shingles of one item's set, their weights, and the weight a candidate must reach."""
    count = next(k for most, k in PARTITIONS if len(items) <= most)
    if not count:
        return items, np.ones(len(items)), THRESHOLD * len(items)
    least = [items[np.argmin(items * _MUL[k] + _ADD[k])] for k in range(count)]
    kept, weight = np.unique(np.array(least, np.uint64), return_counts=True)
    return kept, weight.astype(float), LIKELY * count


class Block:
    """A bounded block of items: their sets and an index over their kept shingles."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        self.ids, self.sets = np.array(ids, np.int64), sets
        parts = [sketch(s) for s in sets]
        owner = np.repeat(np.arange(len(sets)), [len(p[0]) for p in parts])
        hashes = np.concatenate([p[0] for p in parts])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner = hashes[order], owner[order]
        self.weight = np.concatenate([p[1] for p in parts])[order]
        self.need = np.array([p[2] for p in parts])
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def candidates(self, found: np.ndarray) -> np.ndarray:
        """Items of which the distinct shingles ``found`` hold enough of the sketch."""
        low = np.searchsorted(self.hashes, found, "left")
        many = np.searchsorted(self.hashes, found, "right") - low
        at = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        reached = np.bincount(self.owner[at], self.weight[at], minlength=len(self.sets))
        return np.flatnonzero((reached >= self.need) & (reached > 0))

    def search(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = textkit.text_buffers(batch.column(1))
            row, item, common = [], [], []
            for a, b in textkit.slices(bounds):
                hashes, at = textkit.shingles(*textkit.words(raw, bounds[a : b + 1]))
                hit = np.flatnonzero(self.seen[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
                cut = np.searchsorted(hit, at)
                for n in np.flatnonzero(np.diff(cut)):
                    maybe = self.candidates(np.unique(hashes[hit[cut[n] : cut[n + 1]]]))
                    if not len(maybe):
                        continue
                    whole = np.unique(hashes[at[n] : at[n + 1]])
                    for k in maybe:
                        own = self.sets[k]
                        where = np.minimum(np.searchsorted(whole, own), len(whole) - 1)
                        shared = int((whole[where] == own).sum())
                        if shared >= THRESHOLD * len(own):
                            row.append(a + int(n))
                            item.append(int(k))
                            common.append(shared)
            size = [len(self.sets[k]) for k in item]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row, pa.int64())),
                    pa.array(self.ids[item] if item else [], pa.int64()),
                    pa.array(common, pa.int64()),
                    pa.array(size, pa.int64()),
                ],
                names=["doc_id", "item_id", "common", "item_shingles"],
            )


def _item_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, hashes, bounds in textkit.shingle_sets(batch.column(1)):
            places = [None, pa.py_buffer((bounds * hashes.itemsize).astype(np.int32)), pa.py_buffer(hashes.tobytes())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(np.diff(bounds)), pa.Array.from_buffers(pa.binary(), b - a, places)],
                names=["item_id", "size", "shingles"],
            )


def _block(items: DataFrame) -> Broadcast | None:
    """A block of about ``BLOCK_SHINGLES`` shingles, which is all that the driver holds of the benchmark at a time."""
    rows = items.select("item_id", "shingles").collect()
    return items.sparkSession.sparkContext.broadcast(Block([r[0] for r in rows], [np.frombuffer(r[1], np.uint64) for r in rows])) if rows else None


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, common, item_shingles, containment of every pair at or above the threshold."""
    spark = docs.sparkSession
    named = benchmark.select(F.col("item_id").cast("long"), "text").filter("item_id is not null")
    items = textkit.map_texts(named, _item_sets, "item_id long, size long, shingles binary", "items").filter("size > 0")
    total = items.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    blocks = -(-int(total) // BLOCK_SHINGLES)
    text = docs.select(F.col("doc_id").cast("long"), "text")
    pairs = spark.createDataFrame([], _PAIRS)
    for n in range(blocks):
        held = _block(items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == n))
        if held is not None:
            pairs = pairs.unionByName(textkit.map_texts(text, lambda batches, held=held: held.value.search(batches), _PAIRS, "pairs"))
            held.destroy()  # the block's pairs are written
    return pairs.withColumn("containment", F.col("common") / F.col("item_shingles"))
