"""Columns and blocks of vectors, shared by the vector operators."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenloom.llm.common import run_starts, whole_groups


def usable(vector: str) -> Column:
    """Neither null, empty nor zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(F.col(vector).isNotNull() & finite & some, F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of doubles; shorter vectors are filled up with zeros."""
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    offsets = np.asarray(column.offsets)
    size = np.diff(offsets)
    if (size == width).all():
        return values[offsets[0] : offsets[-1]].reshape(-1, width)
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = values[offsets[0] : offsets[-1]]
    return out


def lean(x: np.ndarray) -> np.ndarray:
    """The same numbers in single precision, where that loses nothing."""
    with np.errstate(over="ignore"):
        single = x.astype(np.float32)
    return single if np.array_equal(single, x) else x


def sample(rows: DataFrame, key: str, vector: str, most: int) -> np.ndarray:
    """At most ``most`` vectors, drawn by the hash of their key."""
    drawn = by_hash(rows.withColumn("drawn", F.xxhash64(F.lit(5), key)), "drawn", -(2.0**63), 2.0**63, most).select(vector).toArrow()[vector].combine_chunks()
    drawn = drawn if isinstance(drawn, pa.Array) else pa.concat_arrays(drawn.chunks)
    width = max([1, *np.diff(np.asarray(drawn.offsets)).tolist()])
    return matrix(drawn, width)


def by_hash(rows: DataFrame, column: str, low: float, high: float, most: int) -> DataFrame:
    """The ``most`` rows with the least hashes (spread over low .. high).

    A cut on the hash comes first, with a wide margin, so that few rows are ordered however many there are.
    """
    share = (most + 10 * most**0.5 + 10) / max(rows.count(), 1)
    near = rows.filter(F.col(column) <= low + share * (high - low)) if share < 1 else rows
    return near.orderBy(column).limit(most)


def packed(rows: DataFrame, keys: list[str], vector: str, width: int, extra: list[str], build: Callable) -> DataFrame:
    """One row per group of ``keys`` (integers; groups are bounded): the keys and a blob.

    ``build(matrix, *extra columns)`` makes the object that is pickled into the blob.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys, rows=4096):
            names = [table.column(k).to_numpy() for k in keys]
            x = matrix(table.column(vector).combine_chunks().cast(pa.list_(pa.float64())), width)
            more = [table.column(c).to_numpy() for c in extra]
            start = run_starts(*names)
            for a, b in zip(start, np.append(start[1:], len(x)), strict=True):
                blob = pickle.dumps(build(x[a:b], *(m[a:b] for m in more)), 5)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(n[a : a + 1]) for n in names), pa.array([blob], pa.binary())], [*keys, "blob"]
                )

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    wanted = rows.select(*keys, *extra, vector)
    return wanted.repartition(*keys).sortWithinPartitions(*keys, *extra[:1]).mapInArrow(pack, f"{kinds}, blob binary")
