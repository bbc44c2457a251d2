"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Each permutation of the shingle hashes is evaluated once and gives two
signature values, its minimum and its maximum.  Two permutations make a band of
four values; documents that share a band are compared.

Nothing is quadratic in a bucket's size on the main path: documents of equal
sets are one class, every class is compared with the smallest class of each of
its buckets (the hub), and only what is still apart is compared within the
hub's family, in tiles that return spanning links instead of pairs.  A tile is two
chunks of members of like size, bounded in rows and in shingles, and only chunks
meet whose sizes can be 0.75 alike.

Nulls and edge cases: a null text, an empty text or one without words has an
empty set and links with nothing; rows that share a doc_id count as one
document, and one without doc_id joins the component of its equals but never
leads one; ties go to the smallest doc_id; texts of any length are compared whole,
and a set beyond a chunk's share of shingles makes a chunk of its own; columns other
than doc_id and text are left out, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm import textkit
from ebbtide.llm.grouping import by_key, local_roots
from ebbtide.operators.graph import connected_components
from ebbtide.operators.ranking import running_total
from ebbtide.plans.scratch import materialize

PERMUTATIONS = 64
BANDS = 32
#: A pair goes on to the exact comparison when this share of its signature agrees:
#: five standard deviations of a 128-value signature below 0.75.
LIKELY = 0.55
#: Rows of a chunk at most, and the shingles that a row counts for at least.
TILE, ROW = 512, 4096
#: Ids of at most this many rows may be broadcast; beyond it both sides are shuffled.
BROADCAST_IDS = 1_000_000

_MUL, _ADD = textkit.seeded(PERMUTATIONS, 17), textkit.seeded(PERMUTATIONS, 19)
_FOLD = textkit.seeded(4, 23)
_SIGNATURE = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch binary"


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minimum and maximum under every permutation for non-empty sets: (texts, 2 * permutations)."""
    out = np.empty((len(bounds) - 1, 2 * PERMUTATIONS), np.uint64)
    for k in range(PERMUTATIONS):
        turned = hashes * _MUL[k] + _ADD[k]
        out[:, 2 * k] = np.minimum.reduceat(turned, bounds[:-1])
        out[:, 2 * k + 1] = np.maximum.reduceat(turned, bounds[:-1])
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = 2 * PERMUTATIONS // BANDS
    parts = signature.reshape(len(signature), BANDS, rows)
    keys = (parts * _FOLD[:rows]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    return textkit.mix(keys)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, hashes, bounds in textkit.shingle_sets(batch.column(1)):
            count = np.diff(bounds)
            full = np.flatnonzero(count)
            starts = bounds[full]
            sums = np.zeros((2, b - a), np.uint64)
            bands, sketch = np.full(b - a, None, object), np.full(b - a, None, object)
            if len(full):
                sums[0, full] = np.add.reduceat(hashes, starts)
                sums[1, full] = np.add.reduceat(textkit.mix(hashes), starts)
                signature = signatures(hashes, np.append(starts, len(hashes)))
                for row, keys, values in zip(full, band_keys(signature).view(np.int64), (signature >> np.uint64(32)).astype(np.uint8)):
                    bands[row], sketch[row] = keys, values.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    pa.array(count),
                    *(pa.array(x.view(np.int64)) for x in sums),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(sketch, pa.binary()),
                ],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, hashes, bounds in textkit.shingle_sets(batch.column(1)):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), textkit.list_column(hashes, bounds)], names=["doc_id", "shingles"]
            )


def shingle_sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Full shingle sets (sorted 64-bit hashes), written, of the documents whose doc_id is in ``ids``."""
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    chosen = docs.select(F.col("doc_id").cast("long"), "text").join(wanted, "doc_id", "left_semi")
    return textkit.map_texts(chosen, _sets, "doc_id long, shingles array<long>", "sets")


def _bytes(column: pa.ChunkedArray) -> np.ndarray:
    flat = b"".join(column.to_pylist())
    return np.frombuffer(flat, np.uint8).reshape(len(column), -1)


def _likeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same = (_bytes(batch.column("sketch")) == _bytes(batch.column("hub_sketch"))).mean(axis=1) if batch.num_rows else np.zeros(0)
        keep = pa.array(same >= LIKELY)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").filter(keep), batch.column("hub").filter(keep)], names=["doc_id", "hub"])


def _sides(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Row numbers of a tile's two sides; the same rows twice for a chunk against itself."""
    chunk, kind = rows["chunk"].to_numpy(), rows["kind"].to_numpy()[0]
    i, j = rows["i"].to_numpy()[0], rows["j"].to_numpy()[0]
    if kind:
        late = rows["late"].to_numpy()
        return np.flatnonzero(late), np.flatnonzero(~late), False
    return np.flatnonzero(chunk == i), np.flatnonzero(chunk == j), i == j


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a tile whose sketch is like that of a member of another component."""
    for rows in by_key(batches, ["hub", "kind", "i", "j"]):
        one, two, _ = _sides(rows)
        sketch, comp, size = _bytes(rows["sketch"]), rows["comp"].to_numpy(), rows["n_shingles"].to_numpy()
        hit = np.zeros(len(comp), bool)
        for x in one:
            may = two[(comp[two] != comp[x]) & (4 * np.minimum(size[two], size[x]) >= 3 * np.maximum(size[two], size[x]))]
            like = may[(sketch[may] == sketch[x]).mean(axis=1) >= LIKELY] if len(may) else may
            hit[like] = True
            hit[x] |= len(like) > 0
        keep = np.flatnonzero(hit)
        yield pa.RecordBatch.from_arrays([pa.array(rows[k].to_numpy()[keep]) for k in ("hub", "doc_id")], names=["hub", "doc_id"])


def common_counts(sets: list[np.ndarray], one: np.ndarray, two: np.ndarray, columns: int = 2048) -> np.ndarray:
    """Sizes of the intersections of sets ``one`` with other sets ``two``."""
    both = np.unique(np.concatenate([one, two]))
    local = {n: k for k, n in enumerate(both.tolist())}
    values = np.concatenate([sets[n] for n in both]) if len(both) else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(both)), [len(sets[n]) for n in both])
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    column, owner = column[shared], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = np.unique(column[order], return_inverse=True)[1] if len(order) else column, owner[order]
    x, y = [local[n] for n in one.tolist()], [local[n] for n in two.tolist()]
    out = np.zeros((len(one), len(two)), np.float64)
    for base in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, [base, base + columns])
        block = np.zeros((len(both), columns), np.float32)
        block[owner[a:b], column[a:b] - base] = 1
        out += block[x] @ block[y].T
    return np.rint(out).astype(np.int64)


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links between the components of a tile, from exact set comparisons."""
    for rows in by_key(batches, ["hub", "kind", "i", "j"]):
        one, two, _ = _sides(rows)
        if not len(one) or not len(two):
            continue
        lists = rows["shingles"].combine_chunks()
        flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        sets = [flat[a:b] for a, b in zip(at, at[1:])]
        size, comp = np.diff(at), rows["comp"].to_numpy()
        common = common_counts(sets, one, two)
        union = size[one][:, None] + size[two][None, :] - common
        a, b = np.nonzero((100 * common >= 75 * union) & (comp[one][:, None] != comp[two][None, :]))
        if len(a):
            roots = {n: r for n, r in local_roots(comp[one[a]], comp[two[b]]).items() if n != r}
            yield pa.RecordBatch.from_arrays([pa.array(list(roots), pa.int64()), pa.array(list(roots.values()), pa.int64())], names=["a", "b"])


def _tiles(members: DataFrame, rows: DataFrame) -> DataFrame:
    """Deal each family's members to pairs of chunks, of at most ``TILE`` rows and ``TILE * ROW`` shingles each.

    ``members`` has hub, doc_id, comp, late and n_shingles; ``rows`` the columns to ship by doc_id.  ``late`` members
    are those outside the hub's component: they meet each other and the hub's component; members inside it don't meet
    again.  Chunks hold members of like size, and only chunks meet whose sizes can be 0.75 alike.  A set of more
    shingles than a chunk's share is a chunk with at most one more.
    """
    weight = F.col("n_shingles") + ROW
    placed = running_total(members.withColumn("weight", weight), ["hub", "late", "n_shingles", "doc_id"], "weight", "before", "place")
    side = ["hub", "late"]
    start = materialize(placed.groupBy(*side).agg(F.min("before").alias("start")), "sides")
    chunk = F.floor((F.col("before") - F.col("start")) / (TILE * ROW)).cast("int")
    chunked = materialize(placed.join(start, side).withColumn("chunk", chunk).drop("weight", "before", "place", "start"), "chunked")
    spans = materialize(chunked.groupBy(*side, "chunk").agg(F.min("n_shingles").alias("lo"), F.max("n_shingles").alias("hi")), "spans")
    late = spans.filter("late").select("hub", F.col("chunk").alias("i"), F.col("lo").alias("lo_i"), F.col("hi").alias("hi_i"))
    other = spans.select("hub", "late", F.col("chunk").alias("j"), F.col("lo").alias("lo_j"), F.col("hi").alias("hi_j"))
    near = "4 * hi_i >= 3 * lo_j AND 4 * hi_j >= 3 * lo_i AND (NOT late OR i <= j)"
    pairs = late.join(other, "hub").filter(near).select("hub", F.when(F.col("late"), 0).otherwise(1).alias("kind"), "i", "j")
    ends = F.expr("IF(kind = 0, array_distinct(array(named_struct('late', true, 'chunk', i), named_struct('late', true, 'chunk', j))), array(named_struct('late', true, 'chunk', i), named_struct('late', false, 'chunk', j)))")
    slots = materialize(pairs.select("hub", "kind", "i", "j", F.explode(ends).alias("end")).select("hub", "kind", "i", "j", "end.*"), "slots")
    return chunked.join(slots, [*side, "chunk"]).join(rows, "doc_id")


def _by_tile(rows: DataFrame) -> DataFrame:
    key = ["hub", "kind", "i", "j"]
    return rows.repartition(*key).sortWithinPartitions(*key)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked doc_id, itself included) and kept, one row per document."""
    signed = textkit.map_texts(docs.select(F.col("doc_id").cast("long"), "text"), _sign, _SIGNATURE, "signatures")
    key = ["set_a", "set_b", "n_shingles"]
    classes = materialize(
        signed.filter("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")),
        "classes",
    )
    # every class against the hub of each of its buckets
    rows = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    hubs = materialize(shared.select("bucket", "hub"), "hubs")  # written, so that a large bucket's rows can be split
    stars = materialize(rows.join(hubs, "bucket").filter("rep <> hub").select(F.col("rep").alias("doc_id"), "hub").distinct(), "stars")
    sketches = classes.select(F.col("rep").alias("doc_id"), "sketch", "n_shingles")
    likely = materialize(
        stars.join(sketches, "doc_id")
        .join(sketches.select(F.col("doc_id").alias("hub"), F.col("sketch").alias("hub_sketch")), "hub")
        .select("doc_id", "hub", "sketch", "hub_sketch")
        .mapInArrow(_likeness, "doc_id long, hub long"),
        "likely",
    )
    ids = likely.select("doc_id").unionByName(likely.select(F.col("hub").alias("doc_id"))).distinct()
    sets = shingle_sets_of(docs, ids)
    other = sets.select(F.col("doc_id").alias("hub"), F.col("shingles").alias("hub_shingles"))
    common = F.size(F.array_intersect("shingles", "hub_shingles"))
    linked = (
        likely.join(sets, "doc_id").join(other, "hub")
        .select("doc_id", "hub", common.alias("common"), (F.size("shingles") + F.size("hub_shingles") - common).alias("whole"))
        .filter("100 * common >= 75 * whole")
    )
    first = materialize(connected_components(linked, "doc_id", "hub", "doc_id", "comp"), "components")
    # what is still apart within a hub's family
    hub_comp = first.select(F.col("doc_id").alias("hub"), F.col("comp").alias("hub_comp"))
    members = (
        stars.join(first, "doc_id", "left").join(hub_comp, "hub", "left")
        .select("hub", "doc_id", F.coalesce("comp", "doc_id").alias("comp"), F.coalesce("hub_comp", "hub").alias("hub_comp"))
        .withColumn("late", F.col("comp") != F.col("hub_comp"))
    )
    apart = members.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.count_if("late").alias("n_late"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    open_families = apart.filter("n > 1 and n_late > 0 and lo <> hi").select("hub")
    sizes = sketches.select("doc_id", "n_shingles")
    members = materialize(members.join(open_families, "hub", "left_semi").select("hub", "doc_id", "comp", "late").join(sizes, "doc_id"), "members")
    flagged = _by_tile(_tiles(members, sketches.drop("n_shingles"))).mapInArrow(_flag, "hub long, doc_id long").distinct()
    chosen = materialize(members.join(flagged, ["hub", "doc_id"], "left_semi"), "chosen")
    more = shingle_sets_of(docs, chosen.select("doc_id").distinct())
    links = _by_tile(_tiles(chosen, more)).mapInArrow(_link, "a long, b long")
    second = connected_components(links, "a", "b", "comp", "last")
    reps = classes.select(*key, "rep").join(first.withColumnRenamed("doc_id", "rep"), "rep", "left")
    reps = reps.withColumn("comp", F.coalesce("comp", "rep")).join(second, "comp", "left").select(*key, F.coalesce("last", "comp").alias("component"))
    out = signed.select("doc_id", *key).join(reps, key, "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))
