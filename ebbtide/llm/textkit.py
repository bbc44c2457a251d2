"""Vectorised word and shingle hashing over the UTF-8 bytes of whole texts.

Everything here works on one Arrow batch inside a task and is bounded by the
batch: texts are hashed in slices of about ``SLICE_BYTES`` so that the
temporaries stay inside the CPU caches.  A word's hash depends on its bytes and
their places in the word only, so equal words hash alike on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ebbtide.plans.scratch import materialize

#: Bounds of an Arrow batch of whole texts, in rows and bytes; a longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20
_SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}

SLICE_BYTES = 1 << 20
SHINGLE_WORDS = 5

_LONGEST = 4096
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Texts reach Python in small Arrow batches within; a session that chose sizes of its own keeps them."""
    unset = [key for key in _SETTINGS if spark.conf.get(key, None) is None]
    for key in unset:
        spark.conf.set(key, str(_SETTINGS[key]))
    try:
        yield
    finally:
        for key in unset:
            spark.conf.unset(key)


def map_texts(rows: DataFrame, function, schema, label: str) -> DataFrame:
    """``mapInArrow`` over whole texts in small batches, written at once."""
    with small_batches(rows.sparkSession):
        return materialize(rows.mapInArrow(function, schema), label)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(count: int, seed: int) -> np.ndarray:
    """``count`` fixed pseudo-random odd 64-bit numbers."""
    steps = np.arange(1, count + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)
    return mix(steps * _GOLDEN) | np.uint64(1)


def _byte_values(separators: bytes, seed: int) -> np.ndarray:
    values = seeded(256, seed)
    for upper in range(ord("A"), ord("Z") + 1):
        values[upper] = values[upper + 32]
    values[list(separators)] = 0
    return values


#: Words of the near-duplicate contracts: everything but ASCII white space.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
#: Words of the scanning contracts: letters, digits and all non-ASCII characters.
NOT_ALNUM = bytes(b for b in range(0x80) if not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A))

_PLACES = seeded(_LONGEST, 7)
_VALUES = {}


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw, bounds


def slices(bounds: np.ndarray, limit: int = SLICE_BYTES, most: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes and ``most`` rows at most; a longer text is a range of its own."""
    rows, first = len(bounds) - 1, 0
    while first < rows:
        last = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
        last = min(rows, first + most, max(last, first + 1))
        yield first, last
        first = last


def words(raw: np.ndarray, bounds: np.ndarray, separators: bytes = BLANKS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in ``bounds`` and each text's first word index."""
    if separators not in _VALUES:
        _VALUES[separators] = _byte_values(separators, 3)
    base = int(bounds[0])
    part = raw[base : int(bounds[-1])]
    rel = bounds - base
    if not len(part):
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    value = _VALUES[separators][part]
    inside = value != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = rel[:-1][np.diff(rel) > 0]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    value = value[starts[0] :]
    lengths = np.diff(np.append(starts, len(part)))
    place = np.arange(len(value)) - np.repeat(starts - starts[0], lengths)
    if lengths.max() >= _LONGEST:
        value *= mix((place // _LONGEST).astype(np.uint64)) | np.uint64(1)
        place %= _LONGEST
    value *= _PLACES[place]
    return mix(np.add.reduceat(value, starts - starts[0])), np.searchsorted(starts, rel)


_STEPS = seeded(SHINGLE_WORDS, 11)
_SHORT = seeded(SHINGLE_WORDS, 13)


def shingles(word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in text order, and each text's first shingle index.

    A text of at least five words has a shingle at each of its words but the
    last four; a shorter one has one shingle, the whole sequence; a text
    without words has none.
    """
    count = np.diff(first)
    number = np.where(count >= SHINGLE_WORDS, count - SHINGLE_WORDS + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(number)])
    total = int(bounds[-1])
    if not total:
        return np.empty(0, np.uint64), bounds
    at = np.arange(total) + np.repeat(first[:-1] - bounds[:-1], number)
    padded = np.concatenate([word, np.zeros(SHINGLE_WORDS, np.uint64)])
    out = padded[at] * _STEPS[0]
    for step in range(1, SHINGLE_WORDS):
        out += padded[at + step] * _STEPS[step]
    for row in np.flatnonzero((count > 0) & (count < SHINGLE_WORDS)):
        part = word[first[row] : first[row + 1]]
        out[bounds[row]] = np.append(part * _STEPS[: len(part)], _SHORT[len(part)]).sum(dtype=np.uint64)
    return mix(out), bounds


def distinct(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, and the new bounds."""
    out, sizes = [], np.zeros(len(bounds) - 1, np.int64)
    for row in range(len(sizes)):
        part = np.unique(hashes[bounds[row] : bounds[row + 1]])
        sizes[row] = len(part)
        out.append(part)
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def shingle_sets(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, sorted distinct shingle hashes, bounds) for each slice of a text column."""
    raw, bounds = text_buffers(column)
    for a, b in slices(bounds, limit):
        word, first = words(raw, bounds[a : b + 1])
        yield a, b, *distinct(*shingles(word, first))


def list_column(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """An Arrow list<int64> column of unsigned 64-bit values taken as signed."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))
