"""Near-duplicate texts by SimHash, searched with the generalised pigeonhole principle.

Fingerprints: 64 majority bits of the XXH64 values (seed 42) of 3-word shingles.  Search: bits that
go together are grouped into bytes; consecutive bytes form partitions, each with its own threshold.
If thresholds t_i (-1: partition not used) satisfy sum(t_i + 1) = distance + 1, two fingerprints
within the distance differ by at most t_i bits in some partition, so probing every value within t_i
of a fingerprint's own finds all of them.  Dynamic programming picks partitions and thresholds with
the least work, from byte histograms over all fingerprints.  Candidates are verified by their full
distance; links are kept as a forest, as only reachability is asked for.

A bucket with many fingerprints is cut into chunks and every pair of chunks compared by itself, so no
task holds more than two chunks.  Equal texts and equal fingerprints are one node from the start.

Null and empty texts have no word: fingerprint zero, linked like any other.  Fewer than three words:
the whole sequence is the only shingle.  An empty table gives no rows.  Rows with equal ids are
separate rows of the fingerprint table and end in the same component only if their texts link.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenloom.llm.common import by_slices, roots, row_slices, run_starts, whole_groups
from screenloom.llm.components import components
from screenloom.session import stored

WORDS = 3
SEED = 42
DISTANCE = 3
#: Fingerprints of one bucket that are compared in one task with themselves or another such chunk.
CHUNK = 4096
#: Work of writing, moving and sorting one signature, in comparisons of two fingerprints.
SIGNATURE_COST = 60.0
LINK = "a long, b long"


def shingle_hashes(text: bytes, words: int = WORDS) -> list[int]:
    """XXH64 of every shingle; A-Z lower-cased, words split at ASCII white space."""
    parts = text.lower().split()
    if not parts:
        return []
    joined = b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    end = np.cumsum(size) - 1
    begin = (end - size + 1).tolist()
    stop = end[words - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(begin, stop, strict=False)]


def majority(hashes: list[np.ndarray]) -> np.ndarray:
    """One fingerprint per array: bits set in more than half of its values."""
    n = np.array([len(h) for h in hashes])
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    for a, b in row_slices(n[full], 1 << 16):
        rows = full[a:b]
        ones = np.zeros((len(rows), 64), np.int64)
        if len(rows) == 1:  # a long text by itself, block by block
            values = hashes[rows[0]]
            for i in range(0, len(values), 1 << 16):
                ones[0] += _bits(values[i : i + (1 << 16)]).sum(0, dtype=np.int64)
        else:
            at = np.cumsum(n[rows]) - n[rows]
            ones = np.add.reduceat(_bits(np.concatenate([hashes[i] for i in rows])), at, axis=0, dtype=np.int64)
        out[rows] = np.packbits(2 * ones > n[rows, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def _bits(values: np.ndarray) -> np.ndarray:
    """A row of 64 bits per value, lowest first."""
    return np.unpackbits(np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


@F.arrow_udf(T.LongType())
def _fingerprint(column: pa.Array) -> pa.Array:
    return by_slices(column, _fingerprints, pa.int64())


def _fingerprints(column: pa.Array) -> pa.Array:
    texts = pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()
    hashes = [np.array(shingle_hashes(t), np.uint64) for t in texts]
    return pa.array(majority(hashes).view(np.int64))


def fingerprint(text: str) -> Column:
    """Fingerprint of a text column, as a signed long."""
    return _fingerprint(F.col(text))


def as_hex(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def linked(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(node, root) for all fingerprints (a table of distinct longs fp) that link with another one."""
    order = _grouped_bits(prints)
    nodes = stored(_reordered(prints, order), "prints")
    plan = allocate(_byte_counts(nodes), distance)
    forest = _forest(_signatures(nodes, plan), distance)
    moved = components(forest)
    named = nodes.select(F.col("p"), F.col("fp"))
    by_root = moved.join(named, moved.node == named.p).select("root", F.col("fp").alias("node"))
    return by_root


def _grouped_bits(prints: DataFrame) -> list[int]:
    """Bit order in which bits that are set together stand together, byte by byte.

    From the co-occurrence counts of all fingerprints: 64 x 64 numbers, whatever the table.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((64, 64))
        n = 0
        for batch in batches:
            bits = _bits(batch.column("fp").to_numpy().view(np.uint64)).astype(np.float64)
            both += bits.T @ bits
            n += len(bits)
        cells = np.append(both.ravel(), n).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "n"])

    summed = prints.select("fp").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(64 * 64 + 1)
    counts[summed["cell"].to_numpy()] = summed["n"].to_numpy()
    both, n = counts[:-1].reshape(64, 64), max(counts[-1], 1)
    share = both.diagonal() / n
    spread = np.sqrt(share * (1 - share))
    alike = np.abs(both / n - np.outer(share, share)) / np.maximum(np.outer(spread, spread), 1e-9)
    np.fill_diagonal(alike, 0)
    left, order = list(range(64)), []
    while left:
        near = alike[np.ix_(left, left)]
        group = [left[int(near.max(1).argmax())]]
        while len(group) < 8:
            rest = [x for x in left if x not in group]
            group.append(rest[int(alike[np.ix_(rest, group)].sum(1).argmax())])
        order += group
        left = [x for x in left if x not in group]
    return order


def _reordered(prints: DataFrame, order: list[int]) -> DataFrame:
    """(fp, p): the fingerprint and the same with its bits in the given order."""

    def reorder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = _bits(batch.column("fp").to_numpy().view(np.uint64))[:, order]
            p = np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view("<i8").ravel()
            yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(p)], ["fp", "p"])

    return prints.select("fp").mapInArrow(reorder, "fp long, p long")


def _byte_counts(nodes: DataFrame) -> np.ndarray:
    """How often each value of each of the eight bytes occurs: 8 x 256 numbers."""
    places = F.posexplode(F.array(*[F.shiftrightunsigned("p", 8 * k).bitwiseAND(255) for k in range(8)]))
    rows = nodes.select(places).groupBy("pos", "col").count().collect()
    counts = np.zeros((8, 256))
    for r in rows:
        counts[r["pos"], r["col"]] = r["count"]
    return counts


def allocate(counts: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int, int]]:
    """Partitions (first byte, byte after the last, threshold), by dynamic programming.

    Estimated work of a partition: its signatures, and the pairs of fingerprints within its
    threshold.  The latter come from the byte histograms; bytes count as independent, which the
    grouping of bits makes plausible.  The estimate decides about work only, never about results.
    """
    n = counts[0].sum()
    value = np.arange(256)
    apart = _bits((value[:, None] ^ value[None, :]).astype(np.uint64).ravel()).sum(1).reshape(256, 256)
    share = counts / max(n, 1)
    within = [np.array([(s @ (apart == d)) @ s for d in range(distance + 1)]) for s in share]

    def cost(first: int, last: int, limit: int) -> float:
        spread = reduce(lambda a, b: np.convolve(a, b)[: distance + 1], within[first:last])
        probes = sum(comb(8 * (last - first), d) for d in range(limit + 1))
        return n * (1 + probes * (limit > 0)) * SIGNATURE_COST + n * n / 2 * spread[: limit + 1].sum()

    best: dict[tuple[int, int], tuple[float, list]] = {(0, 0): (0.0, [])}
    for last in range(1, 9):
        for used in range(distance + 2):
            options = [best[last - 1, used]] if (last - 1, used) in best else []
            for first in range(last):
                for limit in range(used):
                    if (first, used - limit - 1) in best:
                        so_far, plan = best[first, used - limit - 1]
                        options.append((so_far + cost(first, last, limit), [*plan, (first, last, limit)]))
            if options:
                best[last, used] = min(options, key=lambda x: x[0])
    return best[8, distance + 1][1]


def _signatures(nodes: DataFrame, plan: list[tuple[int, int, int]]) -> DataFrame:
    """(part, value, p, probe): the own value of every fingerprint, and the values within the threshold."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("p").to_numpy()
            for part, (first, last, limit) in enumerate(plan):
                width = 8 * (last - first)
                mask = np.uint64((1 << width) - 1)
                own = (p.view(np.uint64) >> np.uint64(8 * first)) & mask
                flips, ring = [np.uint64(0)], [(0, 0)]
                for _ in range(limit):
                    ring = [(x | 1 << k, k + 1) for x, low in ring for k in range(low, width)]
                    flips += [np.uint64(x) for x, _ in ring]
                for probe, flip in enumerate(flips):
                    yield _signed(part, own ^ flip, p, probe > 0)

    def _signed(part: int, value: np.ndarray, p: np.ndarray, probe: bool) -> pa.RecordBatch:
        columns = [np.full(len(p), part, np.int32), value.view(np.int64), p, np.full(len(p), probe, np.int32)]
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["part", "value", "p", "probe"])

    return nodes.select("p").mapInArrow(sign, "part int, value long, p long, probe int")


def _forest(signed: DataFrame, distance: int) -> DataFrame:
    """Links that join all verified pairs of every bucket; large buckets go chunk pair by chunk pair."""
    key = ["part", "value"]
    large = (
        signed.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > CHUNK)
        .withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int")).drop("n")
    )
    own = F.pmod(F.xxhash64("p"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1))
    dealt = (
        signed.join(large, key, "left")
        .withColumn("own", F.coalesce(own, F.lit(0)))
        .withColumn("other", other)
        .select(*key, F.least("own", "other").alias("c"), F.greatest("own", "other").alias("d"), "p", "probe")
    )
    keys = [*key, "c", "d"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, keys):
            a, b = bucket_links(*(part.column(k).to_numpy() for k in keys), p=part.column("p").to_numpy(), probe=part.column("probe").to_numpy(), distance=distance)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return dealt.repartition(*keys).sortWithinPartitions(*keys, "probe").mapInArrow(link, LINK)


def bucket_links(*keys: np.ndarray, p: np.ndarray, probe: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the verified pairs of each run of equal keys; owners come before probes."""
    n = len(p)
    start = run_starts(*keys)
    stop = np.repeat(np.append(start[1:], n), np.diff(np.append(start, n)))
    names, node = np.unique(p, return_inverse=True)
    row = np.flatnonzero((probe == 0) & (np.arange(n) + 1 < stop))
    bits = p.view(np.uint64)
    heads, tails, held, step = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, 1
    while len(row):
        near = np.bitwise_count(bits[row] ^ bits[row + step]) <= distance
        hit = row[near]
        heads.append(node[hit])
        tails.append(node[hit + step])
        held += len(hit)
        if held > 1 << 20:
            heads, tails, held = *_stars(heads, tails, len(names)), 0
        step += 1
        row = row[row + step < stop[row]]
    heads, tails = _stars(heads, tails, len(names))
    return names[heads[0]], names[tails[0]]


def _stars(heads: list, tails: list, n: int) -> tuple[list, list]:
    root = roots(np.concatenate(heads), np.concatenate(tails), n)
    leaf = np.flatnonzero(root != np.arange(n))
    return [leaf], [root[leaf]]


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest id reachable over links."""
    marked = stored(docs.select(F.col(key).alias("doc_id"), fingerprint(text).alias("fp")), "marked")
    first = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    nodes = stored(first, "nodes")
    found = stored(linked(nodes.select("fp"), distance), "linked")
    smallest = found.join(nodes, found.node == nodes.fp).groupBy("root").agg(F.min("first").alias("component_id"))
    renamed = found.join(smallest, "root").select(F.col("node").alias("fp"), "component_id")
    named = nodes.join(renamed, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")
