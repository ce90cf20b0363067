"""What several operators share: text buffers, whole groups of a sorted stream, local forests."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from screenloom.functions.groups import roots, whole_groups

__all__ = [
    "by_slices",
    "gather_ranges",
    "give_back",
    "no_cycle_search",
    "roots",
    "row_slices",
    "run_starts",
    "utf8",
    "whole_groups",
]

_LIBC = ctypes.CDLL(None)
#: Bytes of text that one numpy pass takes at a time; a longer text is taken alone.
SLICE_BYTES = 1 << 21


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the offsets of its rows; nulls read as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    return np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8), offsets


def row_slices(sizes: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` units of size each, so that memory stays level."""
    if not len(sizes):
        return
    part = np.cumsum(sizes) // limit
    edges = np.flatnonzero(np.diff(part)) + 1
    yield from zip([0, *edges.tolist()], [*edges.tolist(), len(sizes)], strict=True)


def by_slices(column: pa.Array, make: Callable[[pa.Array], pa.Array], kind: pa.DataType) -> pa.Array:
    """``make`` of a text column, a slice at a time, so that few texts are Python objects at once."""
    sizes = np.diff(utf8(column)[1])
    done = [make(column.slice(a, b - a)).cast(kind) for a, b in row_slices(sizes)]
    out = pa.concat_arrays(done) if done else pa.array([], kind)
    give_back()
    return out


def give_back() -> None:
    """Hand freed memory back to the machine: workers are kept, and later stages run beside them."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


@contextmanager
def no_cycle_search() -> Iterator[None]:
    """No search for cycles inside: code that makes none pays for walks over all its memos otherwise."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """Positions at which a run of equal keys begins."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64)
    edge = np.zeros(n, bool)
    edge[0] = True
    for key in keys:
        edge[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(edge)


def gather_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + lengths[i] - 1, one range after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
