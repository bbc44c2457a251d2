"""Embedding whitening from exact cross-products of bit planes.

Every entry becomes an integer.  Within a task the integers of a dimension,
shifted by that dimension's minimum, are cut into bit planes, and each plane is
packed across rows into 64-bit words.  The cross-product of two dimensions is
the sum over pairs of planes of two to the sum of their places times the bits
set in both words, so ANDs and popcounts give it exactly.  Tasks return sums;
the driver holds one matrix of dimension x dimension, centres it in integers,
and only then turns to floating point for its eigenvectors.

The principal components are fitted on each distinct vector once and applied to
every row.  A measuring pass over the fitted vectors tells how far the
covariance of the result is from the identity.

Nulls and edge cases: rows whose vector is null or empty or holds a null or
non-finite entry go, and so do those with an entry beyond 2^54, whose integer
would leave 64 bits; a row without id stays, and repeated rows are all
returned; each length of vectors is whitened by itself, one length after the
other.  Equal eigenvalues keep the order of their axes.  Where the
vectors have no variance along a component (fewer distinct vectors than
dimensions, or equal ones) ``whitened`` is null and ``explained`` 0, for a
table of one distinct vector ``explained`` is null; components beyond the
length of the vectors do not exist.  Columns other than id and vector are left
out, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.plans.scratch import materialize

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Rows whose planes are packed at once, a multiple of 64.
CHUNK = 4096
_LIMB = 24
_LARGEST = float(1 << 54)


def integers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x): the rows that can be whitened, as arrays of longs floor(64 * c) + 1000000."""
    entry = lambda c: c.cast("double")
    usable = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & (F.abs(entry(c)) <= _LARGEST))
    x = F.transform(vector, lambda c: F.floor(entry(c) * SCALE).cast("long") + F.lit(SHIFT).cast("long"))
    return vectors.filter(F.coalesce(usable, F.lit(False))).select(key, x.alias("x"))


def _rows(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


class BitScatter:
    """Sums and cross-products of non-negative integers, by AND and popcount of bit planes.

    Values are split by powers of two: ``products[l, i, j]`` counts in units of
    2 ** (24 l), so that 64 bits are never left.
    """

    def __init__(self, size: int, bits: int):
        self.size, self.rows = size, 0
        self.products = np.zeros((2 * bits // _LIMB + 1, size, size), np.int64)
        self.sums = np.zeros((bits // _LIMB + 1, size), np.int64)

    def add(self, values: np.ndarray) -> None:
        for first in range(0, len(values), CHUNK):
            self._add_chunk(values[first : first + CHUNK])

    def _add_chunk(self, values: np.ndarray) -> None:
        rows = len(values)
        self.rows += rows
        padded = np.zeros((-(-rows // 64) * 64, self.size), np.int64)
        padded[:rows] = values
        used = np.bitwise_or.reduce(padded, axis=0)
        words, dims, places = [], [], []
        for place in range(int(used.max()).bit_length()):
            held = np.flatnonzero((used >> place) & 1)  # planes without any bit add nothing
            bits = np.packbits(((padded[:, held] >> place) & 1).astype(np.uint8).T, axis=1)
            words.append(bits.view(np.uint64))
            dims.append(held)
            places.append(np.full(len(held), place))
        if not words:
            return
        dim, place = np.concatenate(dims), np.concatenate(places)
        order = np.lexsort((place, dim))
        dim, place, word = dim[order], place[order], np.concatenate(words)[order]
        single = np.bitwise_count(word).sum(axis=1, dtype=np.int64)
        np.add.at(self.sums, (place // _LIMB, dim), single << (place % _LIMB))
        for a in range(len(dim)):
            both = np.bitwise_count(word[a] & word[a:]).sum(axis=1, dtype=np.int64)
            power = place[a] + place[a:] + ((dim[a:] == dim[a]) & (np.arange(len(both)) > 0))  # both orders of two planes of one dimension
            np.add.at(self.products, (power // _LIMB, dim[a], dim[a:]), both << (power % _LIMB))

    def batches(self) -> Iterator[pa.RecordBatch]:
        limb, i, j = np.nonzero(self.products)
        low, k = np.nonzero(self.sums)
        columns = [
            np.concatenate([limb, low, [0]]), np.concatenate([i, k, [-1]]), np.concatenate([j, np.full(len(k), -1), [-1]]),
            np.concatenate([self.products[limb, i, j], self.sums[low, k], [self.rows]]),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["limb", "i", "j", "value"])


@dataclass
class Whitening:
    """Integer sums of the fitted vectors and their principal axes."""

    size: int
    rows: int
    low: np.ndarray  # each dimension's smallest integer
    span: int  # largest integer above it
    total: list[int]  # sums of the shifted integers
    axes: np.ndarray  # (components, size), scaled to unit variance; NaN where there is none
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact; Python integers where 64 bits would not hold it."""
        shifted = x - self.low
        if self.rows * (self.span + 1) < 1 << 62:
            return shifted * np.int64(self.rows) - np.array(self.total, np.int64)
        return shifted.astype(object) * self.rows - np.array(self.total, object)

    def project(self, centred: np.ndarray) -> np.ndarray:
        return np.asarray(centred / self.rows, np.float64) @ self.axes.T


def squares(values: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    if values.dtype == object or (values.size and max(-int(values.min()), int(values.max())) >= 1 << 60):
        return [sum(v * v for v in row) for row in values.astype(object)]
    largest = max(-int(values.min()), int(values.max())) if values.size else 0
    if values.shape[1] * largest * largest < 1 << 63:
        return (values * values).sum(axis=1).tolist()
    # three limbs of 20 bits each: their products and sums stay inside 64 bits up to 2 ** 20 dimensions
    a, b, c = values & 0xFFFFF, (values >> 20) & 0xFFFFF, values >> 40
    parts = [(a * a), 2 * a * b, 2 * a * c + b * b, 2 * b * c, c * c]
    return [sum(p << (20 * k) for k, p in enumerate(row)) for row in zip(*((p.sum(axis=1)).tolist() for p in parts))]


def fit(distinct: DataFrame, size: int, components: int = COMPONENTS) -> Whitening | None:
    """Fit on all rows of ``distinct`` (x of the given size); None for an empty table.

    What reaches the driver is one row per dimension and one per pair of dimensions.
    """

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch.column(0), size)
                low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
                high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(low), pa.array(high)], names=["i", "low", "high"])

    ends = distinct.mapInArrow(bounds, "i long, low long, high long").groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("i").collect()
    if not ends:
        return None
    low = np.array([r["low"] for r in ends], np.int64)
    span = max(r["high"] - r["low"] for r in ends)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = BitScatter(size, span.bit_length())
        for batch in batches:
            found.add(_rows(batch.column(0), size) - low)
        yield from found.batches()

    sums = distinct.mapInArrow(scatter, "limb long, i long, j long, value long").groupBy("limb", "i", "j").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value"))
    rows, total, product = 0, [0] * size, [[0] * size for _ in range(size)]
    for limb, i, j, value in sums.collect():
        value = int(value) << (_LIMB * limb)
        if i < 0:
            rows += value
        elif j < 0:
            total[i] += value
        else:
            product[i][j] += value
    square = rows * rows
    covariance = np.zeros((size, size))
    trace = 0
    for i in range(size):
        trace += rows * product[i][i] - total[i] * total[i]
        for j in range(i, size):
            covariance[i, j] = covariance[j, i] = (rows * product[i][j] - total[i] * total[j]) / square
    value, axis = np.linalg.eigh(covariance)
    order = np.argsort(-value, kind="stable")[: min(components, size)]
    value, axis = value[order], axis[:, order].T
    axis = axis * np.where(axis[np.arange(len(axis)), np.abs(axis).argmax(axis=1)] < 0, -1, 1)[:, None]
    some = value > max(value[0], 0) * size * 8 * np.finfo(float).eps
    with np.errstate(divide="ignore", invalid="ignore"):
        scaled = np.where(some[:, None], axis / np.sqrt(np.where(some, value, 1))[:, None], np.nan)
        explained = np.where(some, value, 0) / (trace / square) if trace else np.full(len(value), np.nan)
    return Whitening(size, rows, low, span, total, scaled, explained)


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, measured on its rows."""
    some = ~np.isnan(model.axes[:, 0])
    kept = int(some.sum())
    if not kept:
        return 0.0
    held = distinct.sparkSession.sparkContext.broadcast(model)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = held.value
        total = np.zeros((kept + 1, kept))
        for batch in batches:
            white = fitted.project(fitted.centred(_rows(batch.column(0), fitted.size)))[:, some]
            total[0] += white.sum(axis=0)
            total[1:] += white.T @ white
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["place", "value"])

    found = np.zeros((kept + 1) * kept)
    for place, value in distinct.mapInArrow(moments, "place long, value double").groupBy("place").agg(F.sum("value")).collect():
        found[place] = value
    found = found.reshape(kept + 1, kept) / model.rows
    return float(np.abs(found[1:] - np.outer(found[0], found[0]) - np.eye(kept)).max())


_SCHEMA = "{key} {type}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
_MOST = 10**38


def _applied(rows: DataFrame, model: Whitening, error: float, key: str) -> DataFrame:
    """A row per row and component."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = held.value
        many = len(fitted.axes)
        number = np.arange(1, many + 1, dtype=np.int32)
        for batch in batches:
            centred = fitted.centred(_rows(batch.column(1), fitted.size))
            white = fitted.project(centred).ravel()
            exact = pa.array([d if d < _MOST else None for d in squares(centred)], pa.decimal128(38, 0))
            again = pa.array(np.repeat(np.arange(batch.num_rows), many))
            total = batch.num_rows * many
            explained = np.tile(fitted.explained, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(again), pa.array(np.tile(number, batch.num_rows)), pa.array(np.full(total, fitted.rows)), exact.take(again),
                    pa.array(white, mask=np.isnan(white)), pa.array(explained, mask=np.isnan(explained)), pa.array(np.full(total, error)),
                ],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, _SCHEMA.format(key=f"`{key}`", type=rows.schema[key].dataType.simpleString()))


def whiten(vectors: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Up to ``components`` whitened coordinates of every usable row, a row each, with the exact squared deviation from the mean."""
    rows = integers(vectors, key, vector)
    # copies are combined before the shuffle
    distinct = materialize(rows.select("x").distinct(), "vectors")
    sizes = distinct.groupBy(F.size("x").alias("size")).count().orderBy("size").toLocalIterator()
    out = vectors.sparkSession.createDataFrame([], _SCHEMA.format(key=f"`{key}`", type=rows.schema[key].dataType.simpleString()))
    for size in (r["size"] for r in sizes):
        ours = distinct.filter(F.size("x") == size)
        model = fit(ours, size, components)
        out = out.unionByName(_applied(rows.filter(F.size("x") == size), model, identity_error(ours, model), key))
    return out
