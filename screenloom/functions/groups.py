"""Arrays inside tasks: whole groups of a sorted stream, local forests."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows from a stream sorted by ``keys``, never cutting a group.

    Keys are integers without nulls.  Callers see to it that groups are bounded.
    """
    held: list[pa.Table] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.concat_tables(held).combine_chunks()
        edge = np.zeros(n - 1, bool)
        for key in keys:
            value = table.column(key).to_numpy()
            edge |= value[1:] != value[:-1]
        edges = np.flatnonzero(edge)
        if len(edges):
            cut = int(edges[-1]) + 1
            yield table.slice(0, cut)
            table = table.slice(cut)
        held, n = [table], table.num_rows
    if n:
        yield pa.concat_tables(held).combine_chunks()


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node reachable from each of ``n`` nodes over the links a-b."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            jump = label[label]
            if np.array_equal(jump, label):
                break
            label = jump
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label
