"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are scaled to length 1 and turned to their principal axes, so that the
leading coordinates carry most of every product.  Within a pair of tiles the
leading coordinates are multiplied first; what the rest can still add is at
most the product of the two suffix norms, and a pair is dropped as soon as its
cosine can no longer reach the threshold.  The suffix norm rides along as one
more coordinate, so product and bound come from one matrix product.

Equal vectors are one class.  Tiles hold a bounded number of classes in the
order of the first axis, and tiles too far apart on it are not paired.  A pair
of tiles returns link counts and a spanning set of links, never its pairs.

A cosine needs vectors of one length, so each length present is compared by
itself.

Nulls and edge cases: a vector that is null, empty, zero or holds null or
non-finite components links with nothing and stays alone, as does one without
vec_id; repeated rows are linked copies; rows that share a vec_id are each
returned; an empty table gives no rows.
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
from ebbtide.operators.ranking import global_rank
from ebbtide.plans.scratch import materialize

THRESHOLD = 0.95
#: Classes in a tile.
TILE = 4096
#: Share of the coordinates that each further step takes in.
STEPS = (0.25, 0.5, 1.0)
_BLOCK = 512
_SLACK = 1e-9


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the wanted length with finite components, as doubles, and which rows they are."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    good = np.flatnonzero(lengths == size)
    part = column.take(pa.array(good))
    rows = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(good), size)
    ok = np.isfinite(rows).all(axis=1) & (rows != 0).any(axis=1)
    most = np.abs(np.where(ok[:, None], rows, 1)).max(axis=1)
    odd = ok & ((most > 1e150) | (most < 1e-150))  # squares would over- or underflow
    if odd.any():
        rows[odd] = rows[odd] / most[odd][:, None]
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt((rows * rows).sum(axis=1))
    return rows[ok] / norm[ok][:, None], good[ok]


def _moments(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            rows, _ = _matrix(batch.column(0), size)
            total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(total.ravel())], names=["place", "value"])

    return run


def principal_axes(vectors: DataFrame, size: int) -> np.ndarray:
    """Axes of the second moments, largest first; only size * size sums leave Spark."""
    sums = vectors.select("embedding").mapInArrow(_moments(size), "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
    moment = np.zeros(size * size)
    for place, value in sums.collect():
        moment[place] = value
    return np.linalg.eigh(moment.reshape(size, size))[1][:, ::-1].copy()


def _turned(size: int, axes: np.ndarray):
    spread = textkit.seeded(2 * size, 37).reshape(2, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = _matrix(batch.column(1), size)
            named = batch.column(0).is_valid().to_numpy(zero_copy_only=False)[at]
            rows, at = rows[named], at[named]
            bad = np.ones(batch.num_rows, bool)
            bad[at] = False
            keys = np.zeros((2, batch.num_rows), np.uint64)
            for k in range(2):
                keys[k, at] = textkit.mix((textkit.mix(rows.view(np.uint64)) * spread[k]).sum(axis=1, dtype=np.uint64))
            turned = pa.array((rows @ axes).ravel())
            bounds = np.concatenate([[0], np.cumsum(~bad)]) * size
            axis = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), turned, mask=pa.array(bad))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(k.view(np.int64)) for k in keys), axis], names=["vec_id", "key_a", "key_b", "axis"])

    return run


def pairs_of_blocks(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two blocks with a product of at least ``threshold``, by leading coordinates first."""
    size = x.shape[1]
    ends = sorted({max(1, round(s * size)) for s in STEPS})
    a = b = product = None
    start = 0
    for end in ends:
        rest_x = np.sqrt(np.maximum((x[:, end:] ** 2).sum(axis=1), 0))
        rest_y = np.sqrt(np.maximum((y[:, end:] ** 2).sum(axis=1), 0))
        if a is None:
            bound = np.column_stack([x[:, :end], rest_x]) @ np.column_stack([y[:, :end], rest_y]).T
            a, b = np.nonzero(bound >= threshold - _SLACK)
            if 8 * len(a) > bound.size:  # most pairs go on: whole products are cheaper than lists
                return np.nonzero(x @ y.T >= threshold)
            product = np.einsum("ij,ij->i", x[a, :end], y[b, :end])
        else:
            product = product + np.einsum("ij,ij->i", x[a, start:end], y[b, start:end])
            on = product + rest_x[a] * rest_y[b] >= threshold - _SLACK
            a, b, product = a[on], b[on], product[on]
        start = end
    sure = product >= threshold
    return a[sure], b[sure]


def _compare(size: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_key(batches, ["i", "j"]):
            i, j = rows["i"].to_numpy()[0], rows["j"].to_numpy()[0]
            band, rep, many = (rows[c].to_numpy() for c in ("band", "rep", "n"))
            x = rows["axis"].combine_chunks().flatten().to_numpy().reshape(len(rep), size)
            one, two = np.flatnonzero(band == i), np.flatnonzero(band == j)
            count, ends = np.zeros(len(rep), np.int64), []
            for p in range(0, len(one), _BLOCK):
                for q in range(p if i == j else 0, len(two), _BLOCK):
                    left, right = one[p : p + _BLOCK], two[q : q + _BLOCK]
                    a, b = pairs_of_blocks(x[left], x[right], threshold)
                    a, b = left[a], right[b]
                    if i == j and p == q:
                        once = a < b
                        a, b = a[once], b[once]
                    if len(a):
                        count += np.bincount(a, many[b], len(rep)).astype(np.int64) + np.bincount(b, many[a], len(rep)).astype(np.int64)
                        ends += [(n, r) for n, r in local_roots(a, b).items() if n != r]
            hit = np.flatnonzero(count)
            if len(hit):
                pairs = np.array(ends)
                root = local_roots(pairs[:, 0], pairs[:, 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rep[hit]), pa.array(count[hit]), pa.array(rep[[root[n] for n in hit.tolist()]])], names=["rep", "links", "root"]
                )

    return run


def embedding_links(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding")
    # one row per length
    sizes = sorted(r["size"] for r in rows.select(F.size("embedding").alias("size")).distinct().collect() if r["size"] is not None and r["size"] > 0)
    usable = F.coalesce(F.size("embedding") > 0, F.lit(False))
    out = _alone(rows if not sizes else rows.filter(~usable))
    for size in sizes:
        out = out.unionByName(_links_of_length(rows.filter(F.size("embedding") == size), size, threshold))
    return out


def _alone(rows: DataFrame) -> DataFrame:
    return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))


def _links_of_length(rows: DataFrame, size: int, threshold: float) -> DataFrame:
    axes = principal_axes(rows, size)
    turned = materialize(rows.mapInArrow(_turned(size, axes), "vec_id long, key_a long, key_b long, axis array<double>"), "turned")
    key = ["key_a", "key_b"]
    classes = turned.filter("axis is not null").groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("axis").alias("axis"))
    ranked = global_rank(classes.withColumn("lead", F.col("axis")[0]), ["lead", "rep", *key], "rank")
    bands = materialize(ranked.withColumn("band", F.floor(F.col("rank") / TILE).cast("int")), "bands")
    # tiles further apart on the first axis than two linked vectors can be are not paired
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + _SLACK
    spans = bands.groupBy("band").agg(F.min("lead").alias("lo"), F.max("lead").alias("hi"))
    cells = spans.select("*", F.explode(F.sequence(F.floor(F.col("lo") / reach), F.floor(F.col("hi") / reach) + 1)).alias("cell"))
    first, second = cells.select(F.col("band").alias("i"), "hi", "cell"), cells.select(F.col("band").alias("j"), "lo", "cell")
    pairs = materialize(first.join(second, "cell").filter(f"i <= j and lo - hi <= {reach!r}").select("i", "j").distinct(), "pairs")
    ours = ["band", "rep", "n", "axis"]
    dealt = (
        bands.select(*ours).join(pairs, F.col("band") == F.col("i"))
        .unionByName(bands.select(*ours).join(pairs.filter("i < j"), F.col("band") == F.col("j")))
        .repartition("i", "j").sortWithinPartitions("i", "j")
    )
    found = materialize(dealt.mapInArrow(_compare(size, threshold), "rep long, links long, root long"), "found")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    component = connected_components(found, "rep", "root", "rep", "component")
    of_class = bands.select(*key, "rep", "n").join(counts, "rep", "left").join(component, "rep", "left")
    linked = turned.filter("axis is not null").select("vec_id", *key).join(of_class, key).select(
        "vec_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    linked = linked.withColumn("kept", F.col("vec_id") == F.col("component_id"))
    return linked.unionByName(_alone(turned.filter("axis is null")))
