"""Near-duplicate vectors: exact pairs above a cosine by dual traversal of cover trees.

Cosine above c means a distance of at most sqrt(2 - 2c) between unit vectors.  Equal vectors are one
point with a weight.  Points fall to a few centres and, by hash, into chunks of about CHUNK; each chunk
is a tree of nested levels with halving radii.  Two trees are traversed together, level by level: a
pair of nodes whose centres are farther apart than the distance plus both covering radii is pruned; one
whose centres and radii lie within the distance links all its points at once; the rest descends.
Points that meet are decided by their cosine in double precision.  Pairs of chunks whose roots rule
each other out are never brought together.

Trees lie in the shared folder, a few to a file, and are read from there: a task takes two parts of them and
walks each pair of their chunks, so no tree is copied to disk for a pair and disk grows with the vectors alone.
Tasks return link counts and a forest, never pairs; so a group of near copies costs as many rows as it has points.
Rows are told apart by 128-bit digests of their vectors; a vector travels once to be a point and once to its chunk.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing and stay.
Shorter vectors are filled up with zeros.  Repeated rows (equal id and vector) are one; a null id is in
no result.  An empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenloom.llm import vectors
from screenloom.llm.common import roots
from screenloom.llm.components import components
from screenloom.session import stored

COSINE = 0.9
CHUNK = 2048
#: Vectors the centres are picked from, and how many there are.
SAMPLE = 4096
CENTRES = 16
#: Covering radii of the levels below the root; below the last come the points.
RADII = (1.0, 0.5, 0.25, 0.125)
#: Safety margin of all bounds against rounding.
SLACK = 1e-9
#: The margin of cosines in single precision.
ROUGH = 1e-5
ROWS = 1024
#: Links that a task holds before it reduces them to a forest.
LINKS = 1 << 18
#: A level of two trees is walked if its pairs of nodes are fewer than those of points by this factor.
FEWER = 4


class Level(NamedTuple):
    """center: point of each node; parent: node above; radius: farthest point below; node: of each point."""

    center: np.ndarray
    parent: np.ndarray
    radius: np.ndarray
    node: np.ndarray


class Tree(NamedTuple):
    ids: np.ndarray
    weight: np.ndarray
    raw: np.ndarray
    levels: list[Level]


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # neither overflow nor underflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def build(raw: np.ndarray, ids: np.ndarray, weight: np.ndarray) -> Tree:
    """Top down: each node is covered greedily at half its radius, its own centre first."""
    x = unit(raw)
    n = len(x)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (x @ x.T)))
    root = int((x @ x.mean(0)).argmax())
    levels = [Level(np.array([root]), np.array([0]), np.array([apart[root].max()]), np.zeros(n, np.int64))]
    for radius in RADII:
        above = levels[-1]
        node = np.empty(n, np.int64)
        centers: list[int] = []
        parents: list[int] = []
        order = np.argsort(above.node, kind="stable")
        ends = np.cumsum(np.bincount(above.node, minlength=len(above.center)))
        for k, (a, b) in enumerate(zip(np.append(0, ends[:-1]), ends, strict=True)):
            left, center = order[a:b], int(above.center[k])
            while len(left):
                near = apart[center, left] <= radius
                near |= left == center
                node[left[near]] = len(centers)
                centers.append(center)
                parents.append(k)
                left = left[~near]
                center = int(left[0]) if len(left) else -1
        center = np.array(centers)
        reach = np.zeros(len(center))
        np.maximum.at(reach, node, apart[center[node], np.arange(n)])
        levels.append(Level(center, np.array(parents), reach, node))
    levels.append(Level(np.arange(n), levels[-1].node, np.zeros(n), np.arange(n)))
    return Tree(ids, weight, vectors.lean(raw), levels)


def slim(tree: Tree) -> Tree:
    """To be stored: node numbers as short as they go, and no level of points."""
    short = lambda x: x.astype(np.min_scalar_type(int(x.max(initial=0))))
    return tree._replace(levels=[Level(short(v.center), short(v.parent), v.radius, short(v.node)) for v in tree.levels[:-1]])


def opened(blob: bytes) -> Tree:
    """The tree that was stored."""
    tree = pickle.loads(blob)
    n = len(tree.ids)
    levels = [Level(*(x if x.dtype.kind == "f" else x.astype(np.int64) for x in v)) for v in tree.levels]
    return tree._replace(levels=[*levels, Level(np.arange(n), levels[-1].node, np.zeros(n), np.arange(n))])


def dual(a: Tree, b: Tree, same: bool, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Linked weight by point of a and of b, and a forest over the links (heads, tails; b's points follow a's)."""
    limit = float(np.sqrt(2 - 2 * cosine))
    xa, xb = unit(a.raw).astype(np.float32), unit(b.raw).astype(np.float32)  # for bounds only
    na, nb = len(xa), len(xb)
    count_a, count_b = np.zeros(na, np.int64), np.zeros(nb, np.int64)
    heads, tails = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    shift = 0 if same else na
    alive = np.ones((1, 1), bool)
    for depth, (la, lb) in enumerate(zip(a.levels, b.levels, strict=True)):
        if depth and len(la.center) * len(lb.center) * FEWER > na * nb:
            # Levels of little more than single points would save nothing: go down to the points.
            la, lb = a.levels[depth - 1], b.levels[depth - 1]
            met = alive[la.node][:, lb.node]
            break
        met = alive[la.parent][:, lb.parent] if depth else alive
        rows, cols = np.flatnonzero(met.any(1)), np.flatnonzero(met.any(0))
        if not len(rows):
            return count_a, count_b, np.concatenate(heads), np.concatenate(tails)
        # Distances are compared by their cosines: d <= r where cosine >= 1 - r^2 / 2.
        near = xa[la.center[rows]] @ xb[lb.center[cols]].T
        reach = (la.radius[rows][:, None] + lb.radius[cols]).astype(np.float32)
        within = near >= 1 - ROUGH - (limit + reach) ** 2 / 2
        within &= met[np.ix_(rows, cols)]
        alive = np.zeros(met.shape, bool)
        inside = np.zeros(within.shape, bool)
        i, j = np.nonzero(within)
        left = limit - reach[i, j]
        inside[i, j] = (left > 0) & (near[i, j] >= 1 + ROUGH - left**2 / 2)
        alive[np.ix_(rows, cols)] = within & ~inside
        if inside.any():
            _link_nodes(rows, cols, inside, la, lb, a, b, same, count_a, count_b, heads, tails, shift)
    for first in range(0, na, ROWS):
        own = np.flatnonzero(met[first : first + ROWS].any(1)) + first
        other = np.flatnonzero(met[own].any(0))
        if not len(own):
            continue
        near = met[np.ix_(own, other)] & (xa[own] @ xb[other].T >= cosine - ROUGH)
        i, j = np.nonzero(near)
        i, j = own[i], other[j]
        keep = exact_cosine(a.raw[i], b.raw[j]) >= cosine
        if same:
            keep &= i != j
        i, j = i[keep], j[keep]
        count_a += np.bincount(i, b.weight[j], na).astype(np.int64)
        if not same:
            count_b += np.bincount(j, a.weight[i], nb).astype(np.int64)
        heads.append(i)
        tails.append(j + shift)
        root = roots(np.concatenate(heads), np.concatenate(tails), na + (not same) * nb)
        leaf = np.flatnonzero(root != np.arange(len(root)))
        heads, tails = [leaf], [root[leaf]]
    return count_a, count_b, np.concatenate(heads), np.concatenate(tails)


def _link_nodes(rows, cols, inside, la, lb, a, b, same, count_a, count_b, heads, tails, shift) -> None:
    """All points below one node link with all below the other."""
    sum_a = np.bincount(la.node, a.weight, len(la.center))
    sum_b = np.bincount(lb.node, b.weight, len(lb.center))
    to_a, to_b = np.zeros(len(la.center)), np.zeros(len(lb.center))
    to_a[rows] = inside @ sum_b[cols]
    to_b[cols] = sum_a[rows] @ inside
    count_a += to_a[la.node].astype(np.int64)
    if same:  # a node linked with itself has counted each point with itself
        itself = np.zeros(len(la.center), bool)
        i, j = np.nonzero(inside)
        itself[rows[i][rows[i] == cols[j]]] = True
        count_a -= np.where(itself[la.node], a.weight, 0)
    else:
        count_b += to_b[lb.node].astype(np.int64)
    # Each node's points hang on the centre of its first partner; partners hang together by their centres.
    first = np.full(len(la.center), -1)
    first[rows[inside.any(1)]] = lb.center[cols[inside.argmax(1)[inside.any(1)]]]
    point = np.flatnonzero(first[la.node] >= 0)
    heads.append(point)
    tails.append(first[la.node][point] + shift)
    back = np.full(len(lb.center), -1)
    back[cols[inside.any(0)]] = la.center[rows[inside.argmax(0)[inside.any(0)]]]
    point = np.flatnonzero(back[lb.node] >= 0)
    heads.append(back[lb.node][point])
    tails.append(point + shift)
    i, j = np.nonzero(inside)
    heads.append(la.center[rows[i]])
    tails.append(lb.center[cols[j]] + shift)


def exact_cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows; of scaled rows where the plain squares over- or underflow."""
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    sx, sy = np.abs(x).max(1, initial=1e-300, keepdims=True), np.abs(y).max(1, initial=1e-300, keepdims=True)
    far = (sx > 1e100) | (sx < 1e-100) | (sy > 1e100) | (sy < 1e-100)
    x, y = np.where(far, x / sx, x), np.where(far, y / sy, y)
    dot = np.einsum("ij,ij->i", x, y)
    return dot / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id) for every row with an id."""
    g = [F.xxhash64(F.lit(seed), F.size("v"), "v").alias(f"g{seed}") for seed in (1, 2)]
    every = rows.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    every = every.select("id", F.when(vectors.usable("v"), F.col("v")).alias("v"))
    usable = every.filter("v is not null").select("v", *g)
    every = stored(every.select("id", *[F.when(F.col("v").isNotNull(), x).alias(f"g{i}") for i, x in enumerate(g, 1)]).distinct(), "rows")
    counted = every.filter("g1 is not null").groupBy("g1", "g2").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    one = usable.groupBy("g1", "g2").agg(F.first("v").alias("v"))
    points = stored(one.hint("merge").join(counted.hint("merge"), ["g1", "g2"]).select("rep", "weight", "g1", "g2", "v"), "points")
    trees, width = _trees(points)
    met = stored(_met(trees, cosine), "met")
    counts = met.filter("tail is null").groupBy(F.col("head").alias("rep")).agg(F.sum("n").alias("n"))
    linked = components(met.filter("tail is not null").select(F.col("head").alias("a"), F.col("tail").alias("b")))
    found = (
        points.select("rep", "weight", "g1", "g2").join(counts, "rep", "left")
        .join(linked.withColumnRenamed("node", "rep"), "rep", "left")
        .select("g1", "g2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    )
    return every.join(found, ["g1", "g2"], "left").select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("root", "id").alias("component_id"),
    )


def _trees(points: DataFrame) -> tuple[DataFrame, int]:
    """A stored table (chunk, top, radius, blob) of trees with their roots, and the width of the vectors."""
    width = points.agg(F.max(F.size("v"))).first()[0] or 1
    drawn = vectors.sample(points, "rep", "v", SAMPLE)
    centres = _spread(unit(np.pad(drawn, ((0, 0), (0, width - drawn.shape[1]))))) if len(drawn) else np.zeros((1, width))
    held = points.sparkSession.sparkContext.broadcast(centres)  # CENTRES x width, whatever the table

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = (unit(vectors.matrix(b.column("v"), width)) @ held.value.T).argmax(1).astype(np.int32) if len(b) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(own), *b.columns], ["own", *b.schema.names])

    kind = points.schema["v"].dataType.simpleString()
    near = points.select("rep", "weight", "v").mapInArrow(assign, f"own int, rep long, weight long, v {kind}")
    sizes = np.zeros(len(centres), np.int64)
    for r in near.groupBy("own").agg(F.count("*").alias("n")).collect():
        sizes[r["own"]] = r["n"]
    parts = -(-sizes // CHUNK)
    first = F.array(*[F.lit(int(x)) for x in np.cumsum(parts) - parts])
    many = F.array(*[F.lit(int(max(1, x))) for x in parts])
    chunk = (first[F.col("own")] + F.pmod(F.xxhash64(F.lit(9), "rep"), many[F.col("own")])).cast("int")
    made = vectors.packed(near.withColumn("chunk", chunk), ["chunk"], "v", width, ["rep", "weight"], lambda *x: slim(build(*x)))

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [opened(blob.as_py()) for blob in batch.column("blob")]
            top = [unit(t.raw[t.levels[0].center])[0].tolist() for t in trees]
            radius = [float(t.levels[0].radius[0]) for t in trees]
            columns = [batch.column("chunk"), pa.array(top, pa.list_(pa.float64())), pa.array(radius, pa.float64()), batch.column("blob")]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "top", "radius", "blob"])

    return stored(made.mapInArrow(rooted, "chunk int, top array<double>, radius double, blob binary"), "trees"), width


def _spread(x: np.ndarray) -> np.ndarray:
    """Centres picked farthest first."""
    picked = [0]
    near = x @ x[0]
    while len(picked) < min(CENTRES, len(x)):
        picked.append(int(near.argmin()))
        near = np.maximum(near, x @ x[picked[-1]])
    return x[picked]


def _forest(heads: list[np.ndarray], tails: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """As few links as hold the same points together."""
    ids, at = np.unique(np.concatenate([*heads, *tails]), return_inverse=True)
    root = roots(at[: len(at) // 2], at[len(at) // 2 :], len(ids))
    leaf = np.flatnonzero(root != np.arange(len(root)))
    return [ids[leaf]], [ids[root[leaf]]]


def _met(trees: DataFrame, cosine: float) -> DataFrame:
    """(head, tail, n): link counts of points where tail is null, forest links elsewhere.

    A product of the stored trees with themselves: each task reads two parts of the table.  Pairs whose roots rule
    each other out end before they leave the JVM.
    """
    limit = float(np.sqrt(2 - 2 * cosine))
    other = trees.select(*[F.col(c).alias(f"{c}_") for c in ("chunk", "top", "radius", "blob")])
    squares = F.aggregate(F.zip_with("top", "top_", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, t: s + t)
    near = (F.col("chunk") <= F.col("chunk_")) & (F.sqrt(squares) <= limit + F.col("radius") + F.col("radius_") + SLACK)
    pairs = trees.hint("shuffle_replicate_nl").join(other, near)
    apart = F.when(F.col("chunk") < F.col("chunk_"), F.col("blob_"))

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Counts of every chunk that the task meets: as many numbers as its two parts have points.
        counts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        heads, tails, links = [], [], 0
        at, a = None, None

        def add(chunk: int, ids: np.ndarray, count: np.ndarray) -> None:
            if chunk in counts:
                counts[chunk][1][:] += count
            else:
                counts[chunk] = ids, count

        for batch in batches:
            for chunk, chunk_, x, y in zip(*(batch.column(c) for c in ("chunk", "chunk_", "blob", "blob_")), strict=True):
                if at != (at := chunk.as_py()):
                    a = opened(x.as_py())
                b = opened(y.as_py()) if y.is_valid else a
                count_a, count_b, head, tail = dual(a, b, not y.is_valid, cosine)
                add(at, a.ids, count_a)
                if y.is_valid:
                    add(chunk_.as_py(), b.ids, count_b)
                ids = np.append(a.ids, b.ids) if y.is_valid else a.ids
                heads.append(ids[head])
                tails.append(ids[tail])
                links += len(head)
                if links > LINKS:
                    heads, tails = _forest(heads, tails)
                    links = 0
        for ids, count in counts.values():
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.nulls(len(some), pa.int64()), pa.array(count[some])], ["head", "tail", "n"])
        if heads:
            heads, tails = _forest(heads, tails)
            yield pa.RecordBatch.from_arrays([pa.array(heads[0]), pa.array(tails[0]), pa.nulls(len(heads[0]), pa.int64())], ["head", "tail", "n"])

    return pairs.select("chunk", "chunk_", "blob", apart.alias("blob_")).mapInArrow(traverse, "head long, tail long, n long")
