"""Walking through a sorted partition key by key, inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table per run of equal keys; at most one key's rows are held besides a batch."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows]).combine_chunks()
        change = np.zeros(rows.num_rows - 1, bool)
        for key in keys:
            values = rows[key].to_numpy()
            change |= values[1:] != values[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield rows.slice(a, b - a)
        held = rows.slice(cuts[-1])
    if held is not None:
        yield held


def local_roots(a: np.ndarray, b: np.ndarray) -> dict[int, int]:
    """The smallest node reachable from each node by the pairs (a, b)."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if (new == label).all():
            return dict(zip(nodes.tolist(), nodes[label].tolist()))
        label = new
