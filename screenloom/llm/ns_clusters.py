"""Exact k-means on integer vectors with Ns-bounds: bounds loosened by the norm of a total displacement.

Every vector keeps, for each centroid, the distance it last had to it and the round of that evaluation.
Centroids of all rounds so far are kept (rounds x clusters of them, whatever the table).  A stored distance
is a bound for the centroid of today once it is loosened by how far the centroid is now from where it was
then: the norm of the whole displacement, which is never more, and mostly less, than the sum of the drifts
of the single rounds.  A centroid whose lower bound is beyond the upper bound of the assigned one is left
alone; all other pairs are evaluated again, exactly, and ties go to the smaller number.  Bounds are widened
by a relative margin far above rounding, so what they rule out is ruled out in whole numbers too.

Each round is one pass over the stored state (vectors, distances, rounds), split as the table is split;
what comes back are sums per cluster and component, combined by Spark in whole numbers.

Vectors that are null, of another length, or hold a null or non-finite component take no part and have no
row.  Repeated rows are rows of their own.  A null id gets a cluster but never starts one; vectors of one id
share a hash and start in the order of their components.  Fewer vectors than clusters: fewer centroids.  No
vector: no row.  Distances that do not fit a long end the job with an overflow error.  Other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenloom.llm.common import run_starts
from screenloom.session import stored

CLUSTERS = 40
ROUNDS = 5
WIDTH = 64
SCALE = 256
#: Relative margin by which bounds are widened; doubles err by about 1e-15.
SLACK = 1e-9
#: Components up to this size have squared distances that doubles hold exactly.
EXACT_IN_DOUBLES = 1 << 21
#: Pairs of vector and centroid evaluated at once.
BLOCK = 1 << 14


def whole_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", width: int = WIDTH) -> DataFrame:
    """(vec_id, x): the vectors that take part, as longs."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = rows.filter(F.col(vector).isNotNull() & (F.size(vector) == width)).filter(finite)
    return kept.select(F.col(key).alias("vec_id"), F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE)).alias("x"))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in the order of the hashes."""
    mark = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    first = vectors.select(mark.alias("mark"), "x").dropna().orderBy("mark", "x").limit(clusters).collect()
    return np.array([r["x"] for r in first], np.int64) if first else np.zeros((0, 0), np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of paired rows, exactly."""
    if not len(x):
        return np.zeros(0, np.int64)
    if max(int(np.abs(x).max()), int(np.abs(c).max())) <= EXACT_IN_DOUBLES:
        gap = (x - c).astype(np.float64)
        return np.einsum("ij,ij->i", gap, gap).astype(np.int64)
    gap = x.astype(object) - c.astype(object)
    return np.array((gap * gap).sum(1).tolist(), object).astype(np.int64)


def evaluated(x: np.ndarray, centroids: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], distance: np.ndarray) -> None:
    """Puts the squared distances of the given pairs (row, centroid) into ``distance``."""
    row, column = pairs
    for a in range(0, len(row), BLOCK):
        r, c = row[a : a + BLOCK], column[a : a + BLOCK]
        distance[r, c] = squared(x[r], centroids[c])


def moved(history: np.ndarray) -> np.ndarray:
    """Norm of the displacement of every centroid from every earlier round to now: (round, centroid)."""
    gap = (history - history[-1]).astype(np.float64)
    return np.sqrt(np.einsum("tkc,tkc->tk", gap, gap))


def assign(x: np.ndarray, history: np.ndarray, cluster: np.ndarray, known: np.ndarray, when: np.ndarray) -> tuple[np.ndarray, int]:
    """Nearest centroid of every row; ``known`` (squared distances) and ``when`` (rounds) are brought up to date.

    ``cluster`` is the assignment of the round before.  Also says how many distances were evaluated.
    """
    n, k = known.shape
    here, now = history[-1], len(history) - 1
    if not now:
        evaluated(x, here, np.nonzero(np.ones((n, k), bool)), known)
        return known.argmin(1).astype(np.int32), n * k
    drift = moved(history)[when, np.arange(k)]
    low = np.sqrt(known.astype(np.float64)) * (1 - SLACK) - drift * (1 + SLACK)
    every = np.arange(n)
    high = (np.sqrt(known[every, cluster].astype(np.float64)) + drift[every, cluster]) * (1 + SLACK)
    near = low <= high[:, None]
    near[every, cluster] = False
    # Where another centroid may be nearer, the own distance is evaluated first and the test made again.
    again = np.flatnonzero(near.any(1))
    own = (again, cluster[again])
    evaluated(x, here, own, known)
    when[own] = now
    near[again] &= low[again] <= np.sqrt(known[own].astype(np.float64))[:, None] * (1 + SLACK)
    pairs = np.nonzero(near)
    evaluated(x, here, pairs, known)
    when[pairs] = now
    # Ruled-out centroids are farther than the assigned one; they are not compared.
    compared = np.where(near, known, np.iinfo(np.int64).max)
    compared[own] = known[own]
    best = cluster.copy()
    best[again] = compared[again].argmin(1)
    return best, len(again) + len(pairs[0])


STATE = "vec_id long, x array<long>, cluster int, known array<long>, at array<byte>, evaluated long"


def _rows(column: pa.Array, width: int, dtype) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(dtype).reshape(len(column), width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32) if values.size else np.zeros(len(values) + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), kind))


def assigned(state: DataFrame, history: np.ndarray) -> DataFrame:
    """The state after assigning every vector to the nearest of the last centroids of ``history``."""
    held = state.sparkSession.sparkContext.broadcast(history)
    fresh = len(history) == 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        history = held.value
        k, width = history.shape[1:]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _rows(batch.column("x"), width, np.int64)
            if fresh:
                cluster, known, when = np.zeros(n, np.int32), np.zeros((n, k), np.int64), np.zeros((n, k), np.int8)
            else:
                cluster = batch.column("cluster").to_numpy()
                known, when = _rows(batch.column("known"), k, np.int64), _rows(batch.column("at"), k, np.int8)
            best, done = assign(x, history, cluster, known, when)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("x"),
                    pa.array(best),
                    _lists(known, pa.int64()),
                    _lists(when, pa.int8()),
                    pa.array(np.append(done, np.zeros(n - 1, np.int64))),
                ],
                ["vec_id", "x", "cluster", "known", "at", "evaluated"],
            )

    return state.mapInArrow(work, STATE)


def sums(state: DataFrame, width: int) -> tuple[dict[int, tuple[int, list[int]]], int]:
    """Count and component sums of every cluster (clusters x (width + 1) numbers), and the distances evaluated."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch.column("x"), width, np.int64)
            cluster = batch.column("cluster").to_numpy()
            order = np.argsort(cluster, kind="stable")
            start = run_starts(cluster[order])
            if not len(start):
                continue
            count = np.diff(np.append(start, len(order)))
            done = np.add.reduceat(batch.column("evaluated").to_numpy()[order], start)
            columns = [cluster[order[start]], count, done]
            total = _lists(np.add.reduceat(x[order], start, axis=0), pa.int64())
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), total], ["cluster", "n", "done", "x"])

    parts = state.select("cluster", "x", "evaluated").mapInArrow(add, "cluster int, n long, done long, x array<long>")
    exact = [F.sum(F.get("x", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("done").alias("done"), *exact).collect()
    return {r["cluster"]: (r["n"], [int(r[f"s{i}"]) for i in range(width)]) for r in rows}, sum(r["done"] for r in rows)


def clustered(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(vec_id, cluster, distance) as a stored table, the final centroids, and the distances evaluated per round."""
    vectors = whole_vectors(rows, key, vector, width)
    start = first_centroids(vectors, clusters)
    if not len(start):
        # Only vectors without an id, or none: nothing can start a cluster.
        nothing = vectors.limit(0).select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return nothing, start, []
    history = start[None]
    state = stored(assigned(vectors, history), "assigned")
    work = []
    for _ in range(rounds):
        total, done = sums(state, width)
        work.append(done)
        here = history[-1].copy()
        for c, (n, s) in total.items():
            here[c] = [v // n for v in s]
        history = np.concatenate([history, here[None]])
        state = stored(assigned(state, history), "assigned")
    return _distances(state, history[-1]), history[-1], work


def _distances(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) with every distance to the assigned centroid evaluated."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch.column("x"), centroids.shape[1], np.int64)
            cluster = batch.column("cluster")
            distance = squared(x, centroids[cluster.to_numpy()])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), cluster, pa.array(distance)], ["vec_id", "cluster", "distance"])

    out = state.select("vec_id", "cluster", "x").mapInArrow(work, "vec_id long, cluster int, distance long")
    return stored(out, "distances")


def with_digests(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster_inertia, inertia and centroid_sha256 to (vec_id, cluster, distance)."""
    per = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digest = {c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest() for c in per}
    table = [(c, d, sum(per.values()), digest[c]) for c, d in per.items()]
    told = found.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH) -> str:
    """The same in SQL, with every distance of every round evaluated."""
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, x, c AS cluster, d FROM (SELECT vec_id, x, c, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS k "
            f"FROM (SELECT v.vec_id, v.x, c.c, list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, c.x) + list_inner_product(c.x, c.x) AS d "
            f"FROM vectors v, c{r} c)) WHERE k = 1)"
        )
        if r < rounds:
            each = ", ".join(f"floor(sum(x[{i}]) / count(*))" for i in range(1, width + 1))
            steps.append(
                f"c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.x, o.x) AS x FROM c{r} o LEFT JOIN "
                f"(SELECT cluster, [{each}] AS x FROM a{r} GROUP BY cluster) m ON m.cluster = o.c)"
            )
    last = rounds
    return f"""WITH vectors AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: floor({SCALE} * CAST(e AS DOUBLE))) AS x
  FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM
  (SELECT sha256('2:' || vec_id) AS h, x FROM vectors ORDER BY h LIMIT {clusters})),
{", ".join(steps)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
  CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c.x, lambda e: CAST(e AS BIGINT)), ',')) AS centroid_sha256
FROM a{last} JOIN c{last} c ON c.c = cluster"""


SQL = _sql()
