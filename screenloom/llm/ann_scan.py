"""Approximate nearest neighbours by largest inner product: an adaptive scan over dimension blocks.

An inverted file (k-means lists) narrows the search; inside every probed list vectors are rotated at
random and read block of columns by block of columns.  After d of D columns the squared distance is
estimated from its part; a candidate is abandoned as soon as that part exceeds what the current k-th
best allows by more than a factor (1 + EPSILON / sqrt(d))^2, the hypothesis test for "not among the
nearest".  Inner products turn into distances by the exact norms.  Survivors are scored exactly on
the original vectors.

Each query first scans its nearest list, which gives its threshold; the other probed lists then
return only what beats it.  Lists are cut into chunks of at most about CHUNK rows, queries likewise, so
a list with a third of all vectors is scanned by many tasks.  Blocks meet by a merge join: a query comes once per
list that it probes, which no estimate foresees, and no block may pass the driver.  Centroids are fitted on at most SAMPLE
vectors; every vector is indexed.  There are as many lists as the square root of the number of vectors,
at most LISTS (centroids are broadcast).

How many lists a query probes is measured, not set: TRIALS drawn queries are searched exactly against
all vectors, and for each of their true neighbours the place of its list in the query's order is noted.
Queries then probe the least number of first lists that hold a share RECALL of those neighbours, less
two standard errors over the trials, and more until the lists hold k other vectors.  Tables whose
vectors form groups need few lists; where vectors have no structure nearly all are needed.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
without a numeric id.  Rows that agree in id and vector count once; rows of one id with different
vectors are rows of their own, each a candidate of the other, and as queries have 20 neighbours each.
Shorter vectors are filled up with zeros.  Ties go to the smaller id.  An empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenloom.llm import vectors
from screenloom.session import stored

SAMPLE = 20_000
LISTS = 4096
TRIALS = 256
RECALL = 0.95
ROUNDS = 8
CHUNK = 4096
QUERIES = 1024
#: Queries of a task that copies them to the lists they probe.
PROBES = 256
STRIP = 1024
COLUMNS = 16
EPSILON = 2.1
FOUND = "query_row long, query_id long, vec_id long, score double"


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray
    rotation: np.ndarray
    sizes: np.ndarray


def k_means(x: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    rng = np.random.default_rng(11)
    centers = x[rng.choice(len(x), lists, replace=lists > len(x))]
    for _ in range(rounds):
        own = nearest(x, centers)
        counts = np.bincount(own, minlength=lists)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
    return centers


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Rows are taken a block at a time, so that memory stays level."""
    half, step = (centers**2).sum(1) / 2, max(1, (1 << 21) // len(centers))
    parts = [(x[i : i + step] @ centers.T - half).argmax(1) for i in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def rotation(width: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(23).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def neighbours(
    rows: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding", recall: float = RECALL
) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row for which the column ``is_query`` holds."""
    spark = rows.sparkSession
    good = rows.filter(vectors.usable(vector)).select(
        F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")
    )
    good = good.filter("id IS NOT NULL").dropDuplicates(["id", "v"])
    good = stored(good.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, width = good.agg(F.count("*"), F.max(F.size("v"))).first()
    lists = int(max(1, min(LISTS, np.ceil(np.sqrt(n)))))
    drawn = vectors.sample(good, "row", "v", SAMPLE)
    width = width or 1
    drawn = np.pad(drawn, ((0, 0), (0, width - drawn.shape[1])))
    centers = k_means(drawn, lists) if len(drawn) else np.zeros((1, width))
    centroids = spark.sparkContext.broadcast(centers)  # LISTS x width, whatever the table

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = nearest(vectors.matrix(b.column("v"), width), centroids.value).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(own), *b.columns], ["list", *b.schema.names])

    kind = good.schema["v"].dataType.simpleString()
    listed = stored(good.mapInArrow(assign, f"list int, id long, v {kind}, q boolean, row long"), "lists")
    sizes = np.zeros(lists, np.int64)
    for r in listed.groupBy("list").agg(F.count("*").alias("n")).collect():
        sizes[r["list"]] = r["n"]
    first = probes_needed(listed, centers, width, k, recall)
    index = spark.sparkContext.broadcast(Index(centers, rotation(width), sizes))

    def chunked(df: DataFrame, counts: np.ndarray, size: int) -> DataFrame:
        """Hash chunks of each list, by the counts of at most LISTS lists."""
        chunks = F.array(*[F.lit(int(c)) for c in np.maximum(1, -(-counts // size))])
        return df.withColumn("chunk", F.pmod(F.xxhash64(F.lit(3), "row"), chunks[F.col("list")]).cast("int"))

    blocks = stored(
        vectors.packed(chunked(listed, sizes, CHUNK), ["list", "chunk"], "v", width, ["row", "id"], lambda x, r, i: (r, i, vectors.lean(x))), "blocks"
    )

    asking = listed.filter("q").select("row", "id", "v")
    # A query becomes some hundred rows, so tasks are made by the number of queries and not by their bytes.
    tasks = max(1, -(-asking.count() // PROBES))

    def probed(asking: DataFrame, least, at_home: bool) -> DataFrame:
        """A row for the home list of each query, or for each of the others that it probes."""

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = vectors.matrix(b.column("v"), width)
                order = np.argsort(-(x @ index.value.centroids.T), axis=1, kind="stable")
                enough = np.cumsum(index.value.sizes[order], axis=1) > k
                most = np.where(enough.any(1), enough.argmax(1) + 1, lists)
                at = np.arange(lists)
                row, at = np.nonzero((at < np.maximum(most, first)[:, None]) & ((at == 0) == at_home))
                own = [b.column(c).take(pa.array(row)) for c in ("row", "id", "v", "least")]
                yield pa.RecordBatch.from_arrays([pa.array(order[row, at].astype(np.int32)), *own], ["list", "row", "id", "v", "least"])

        asking = asking.select("row", "id", "v", F.coalesce(least, F.lit(float("-inf"))).alias("least"))
        return asking.repartition(tasks, "row").mapInArrow(probe, f"list int, row long, id long, v {kind}, least double")

    home = _scan(blocks, _asked(probed(asking, F.lit(None).cast("double"), True), width, chunked), index, k)
    home = stored(home, "home")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    kth = home.withColumn("r", F.row_number().over(best)).filter(F.col("r") == k).select("query_row", F.col("score").alias("kth"))
    rest = probed(asking.join(kth, F.col("row") == F.col("query_row"), "left"), F.col("kth"), False)
    found = home.union(_scan(blocks, _asked(rest, width, chunked), index, k))
    return (
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def probes_needed(listed: DataFrame, centers: np.ndarray, width: int, k: int, recall: float) -> int:
    """First lists of a query's order that hold the share ``recall`` of the true neighbours of drawn queries.

    Every task finds the k best of its rows for each of at most TRIALS queries, so TRIALS x k rows a task are merged.
    """
    asked = vectors.by_hash(listed.filter("q").withColumn("drawn", F.xxhash64(F.lit(7), "row")), "drawn", -(2.0**63), 2.0**63, TRIALS)
    asked = asked.select("row", "v").toArrow()
    if not asked.num_rows:
        return 1
    trials = listed.sparkSession.sparkContext.broadcast(
        (asked["row"].to_numpy(), vectors.matrix(asked["v"].combine_chunks().cast(pa.list_(pa.float64())), width))
    )

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = trials.value
        score = np.full((len(q), k), -np.inf)
        home = np.zeros((len(q), k), np.int32)
        for b in batches:
            x, row = vectors.matrix(b.column("v"), width), b.column("row").to_numpy()
            new = q @ x.T
            new[own[:, None] == row] = -np.inf
            score = np.hstack([score, new])
            home = np.hstack([home, np.broadcast_to(b.column("list").to_numpy(), new.shape)])
            top = np.argpartition(-score, k - 1, axis=1)[:, :k]
            score, home = np.take_along_axis(score, top, 1), np.take_along_axis(home, top, 1)
        at, _ = there = np.nonzero(score > -np.inf)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(home[there]), pa.array(score[there])], ["trial", "list", "score"]
        )

    best = Window.partitionBy("trial").orderBy(F.desc("score"), "list")
    true = listed.select("row", "v", "list").mapInArrow(exact, "trial int, list int, score double")
    true = true.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).select("trial", "list").toArrow()
    lists = len(centers)
    order = np.argsort(-(trials.value[1] @ centers.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(lists)[None, :], 1)
    trial = true["trial"].to_numpy()
    seen = np.zeros((len(order), lists))
    np.add.at(seen, (trial, place[trial, true["list"].to_numpy()]), 1)
    held = np.cumsum(seen, axis=1)[seen.sum(1) > 0]
    if not len(held):
        return 1
    held /= held[:, -1:]
    sure = held.mean(0) - 2 * held.std(0) / np.sqrt(len(held)) >= recall - 1e-12
    return int(np.argmax(sure)) + 1


def _asked(probed: DataFrame, width: int, chunked) -> DataFrame:
    """Blocks of queries by list: at most about QUERIES in one."""
    probed = stored(probed, "probes")
    lists = {r["list"]: r["n"] for r in probed.groupBy("list").agg(F.count("*").alias("n")).collect()}
    counts = np.array([lists.get(i, 0) for i in range(max(lists, default=0) + 1)])
    asked = vectors.packed(chunked(probed, counts, QUERIES), ["list", "chunk"], "v", width, ["row", "id", "least"], lambda x, r, i, t: (r, i, vectors.lean(x), t))
    return asked.select("list", F.col("chunk").alias("asked"), F.col("blob").alias("queries"))


def _scan(blocks: DataFrame, asked: DataFrame, index, k: int) -> DataFrame:
    """Every block of queries against every block of its list."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, queries in zip(batch.column("blob"), batch.column("queries"), strict=True):
                own, ids, x = pickle.loads(blob.as_py())
                asking, names, q, least = pickle.loads(queries.as_py())
                q, x = q.astype(np.float64, copy=False), x.astype(np.float64, copy=False)
                row, at, score = adaptive_scan(q, asking, least, x, own, index.value.rotation, k, ids)
                found = [pa.array(c) for c in (asking[row], names[row], ids[at], score)]
                yield pa.RecordBatch.from_arrays(found, ["query_row", "query_id", "vec_id", "score"])

    pairs = blocks.hint("merge").join(asked.hint("merge"), "list").select("blob", "queries", F.xxhash64("list", "chunk", "asked").alias("h"))
    return pairs.repartition("h").select("blob", "queries").mapInArrow(scan, FOUND)


def adaptive_scan(
    q: np.ndarray, asking: np.ndarray, least: np.ndarray, x: np.ndarray, own: np.ndarray, turn: np.ndarray, k: int,
    ids: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, candidate row and score of the k best of each query that reach its ``least``; ties by ``ids``.

    A candidate whose ``own`` row is the asking one is left out.
    """
    ids = own if ids is None else ids
    width = x.shape[1]
    turned_q, turned_x = q @ turn, x @ turn
    norm_q, norm_x = (q**2).sum(1), (x**2).sum(1)
    best_row = best_at = np.zeros(0, np.int64)
    best_score = np.zeros(0)
    floor = least.copy()
    for first in range(0, len(x), STRIP):
        strip = slice(first, first + STRIP)
        row = at = part = None
        for d in range(0, width, COLUMNS):
            a, b = turned_q[:, d : d + COLUMNS], turned_x[strip, d : d + COLUMNS]
            done = min(width, d + COLUMNS)
            slack = done / width * (1 + EPSILON / np.sqrt(done)) ** 2 if done < width else 1 + 1e-9
            if row is None:
                part = (a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * (a @ b.T)
                reach = norm_q[:, None] + norm_x[strip] - 2 * floor[:, None]
                row, at = np.nonzero((part <= reach * slack + 1e-12) & (asking[:, None] != own[strip]))
                part = part[row, at]
            else:
                part = part + ((a[row] - b[at]) ** 2).sum(1)
                stay = part <= (norm_q[row] + norm_x[strip][at] - 2 * floor[row]) * slack + 1e-12
                row, at, part = row[stay], at[stay], part[stay]
        score = np.einsum("ij,ij->i", q[row], x[strip][at])
        reached = score >= floor[row]
        row, at, score = row[reached], at[reached] + first, score[reached]
        row, at, score = np.append(best_row, row), np.append(best_at, at), np.append(best_score, score)
        order = np.lexsort((ids[at], -score, row))
        row, at, score = row[order], at[order], score[order]
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
        place = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
        top = place < k
        best_row, best_at, best_score = row[top], at[top], score[top]
        kth = place[top] == k - 1
        floor[best_row[kth]] = np.maximum(floor[best_row[kth]], best_score[kth])
    return best_row, best_at, best_score
