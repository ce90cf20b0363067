"""Mixing sources to target weights by Pfair scheduling of blocks.

The rows of a source, in hash order, form blocks of ``block_rows``.  Block j (from 1) of a source
with weight w is released at slot floor((j-1)/w) and due by slot ceil(j/w); in every slot the released
block with the earliest deadline goes (ties: the later group deadline of the longer window, then the
larger weight, then the name).  Weights are exact fractions, so nothing adds up: at every slot of a
phase each source has had its share of the given weights to within less than one block.  What goes
next depends on how often each source has gone only.  The driver runs through the slots once and keeps
these numbers at every FRAME-th slot; tasks work out the slots of each frame from them.  When a source
has no block left, a new phase begins with the weights of those that remain; all rows are placed.

A null source counts as the empty one; a null key is a key like any other.  A source without a target weight (or a weight that is not
positive) comes after all weighted ones, in a last phase of equal weights.  Rows of equal source and key
share a place, and ties in hash order go by key.  An empty table gives no rows.  The sizes of all sources
reach the driver, one row per source; it steps through one slot per block, and keeps one number per frame and source.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import count, islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 32
#: Slots that a task works out at a time.
FRAME = 4096
#: Rows that one task ranks: sources are cut into hash ranges of about this many.
RANGE_ROWS = 1 << 16
SEED = 17


class Phase(NamedTuple):
    """begin: first slot; done: blocks served before; shares: exact, of one; marks: blocks served in the phase
    at each FRAME-th slot, all by source."""

    begin: int
    length: int
    done: dict[str, int]
    shares: dict[str, Fraction]
    marks: list[dict[str, int]]

    @property
    def slots(self) -> dict[str, list[int]]:
        """All slots of the phase by source."""
        out: dict[str, list[int]] = {s: [] for s in self.shares}
        for slot, s in enumerate(islice(serve(self.shares, self.marks[0]), self.length)):
            out[s].append(slot)
        return out

    @property
    def frame(self) -> int:
        """Slots until the schedule repeats: it does not inside its phase."""
        return self.length


def exact_shares(weights: Mapping[str, float]) -> dict[str, Fraction]:
    """The weights as fractions that add up to one, without rounding."""
    exact = {s: Fraction(w) if isinstance(w, int) else Fraction(float(w)) for s, w in weights.items()}
    total = sum(exact.values())
    return {s: w / total for s, w in exact.items()}


def serve(shares: Mapping[str, Fraction], served: Mapping[str, int], begin: int = 0) -> Iterator[str]:
    """Sources of the slots from ``begin`` on, when ``served`` blocks of each have gone before."""
    rate = {s: (w.numerator, w.denominator, -float(w)) for s, w in shares.items()}
    waiting = [(served[s] * d // a, s, served[s]) for s, (a, d, _) in rate.items()]
    heapq.heapify(waiting)
    ready: list[tuple] = []
    for slot in count(begin):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            a, d, weight = rate[s]
            due, beyond = divmod((j + 1) * d, a)
            heapq.heappush(ready, (due + (beyond > 0), not beyond, weight, s, j))
        due, _, _, s, j = heapq.heappop(ready)
        if slot >= due:
            raise RuntimeError("a block missed its deadline")
        yield s
        a, d, _ = rate[s]
        heapq.heappush(waiting, ((j + 1) * d // a, s, j + 1))


def quotas(weights: Mapping[str, float], frame: int) -> dict[str, int]:
    """Slots of a frame by source, at least one each, by largest remainder."""
    total = sum(weights.values())
    spare = frame - len(weights)
    exact = {s: w / total * spare for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: frame - sum(out.values())]:
        out[s] += 1
    return out


def frame_schedule(slots: Mapping[str, int], frame: int) -> dict[str, list[int]]:
    """Earliest deadline first over the windows of one frame: the slots of each source, ascending."""
    out: dict[str, list[int]] = {s: [] for s in slots}
    served = serve({s: Fraction(q, frame) for s, q in slots.items()}, dict.fromkeys(slots, 0))
    for slot, s in enumerate(islice(served, frame)):
        out[s].append(slot)
    return out


def phases(blocks: Mapping[str, int], weights: Mapping[str, float]) -> list[Phase]:
    """One phase per exhausted source at most."""
    left = {s: n for s, n in blocks.items() if n}
    done = dict.fromkeys(left, 0)
    out, begin = [], 0
    while left:
        live = {s: weights[s] for s in left if weights.get(s, 0) > 0} or dict.fromkeys(left, 1.0)
        shares, served, length, marks = exact_shares(live), dict.fromkeys(live, 0), 0, []
        for s in serve(shares, served.copy()):
            if length % FRAME == 0:
                marks.append(served.copy())
            length += 1
            served[s] += 1
            if served[s] == left[s]:
                break
        out.append(Phase(begin, length, {s: done[s] for s in live}, shares, marks))
        for s in live:
            done[s] += served[s]
            left[s] -= served[s]
            if not left[s]:
                del left[s]
        begin += length
    return out


def _laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks and slots of frames."""
    for batch in batches:
        for blob in batch.column("frame").to_pylist():
            k, begin, first, size, shares, served, done = pickle.loads(blob)
            at, rows = dict(served), []
            for slot, s in enumerate(islice(serve(shares, served, first), size), begin + first):
                rows.append((k, s, done[s] + at[s], slot))
                at[s] += 1
            columns = zip(*rows, strict=True)
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["phase", "s", "block", "slot"]
            )


def tempered(sizes: Mapping[str, int], power: float = 0.5) -> dict[str, float]:
    """Target weights by size to a power: small sources get more than their share, large ones less."""
    return {s: n**power for s, n in sizes.items()}


def placements(
    docs: DataFrame, weights: Mapping[str, float] | None = None, source: str = "source", key: str = "doc_id",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(source, key, block, phase, slot, place) for every distinct source and key.

    block: from 0 in its source; slot: of the block, from 0 over all; place: inside the block.
    ``weights`` by source; without, ``tempered`` sizes.  A null source goes by the name "".
    """
    spark = docs.sparkSession
    name = F.coalesce(F.col(source).cast("string"), F.lit(""))
    rows = docs.select(name.alias("s"), F.col(key).alias("key")).distinct()
    rows = rows.withColumn("hash", F.xxhash64(F.lit(SEED), "key"))
    sizes = {r["s"]: r["n"] for r in rows.groupBy("s").agg(F.count("*").alias("n")).collect()}
    plan = phases({s: -(-n // block_rows) for s, n in sizes.items()}, weights if weights is not None else tempered(sizes))
    frames = [
        (pickle.dumps((k, p.begin, i * FRAME, min(FRAME, p.length - i * FRAME), p.shares, mark, p.done), 5),)
        for k, p in enumerate(plan) for i, mark in enumerate(p.marks)
    ]
    slots = spark.createDataFrame(frames, "frame binary").mapInArrow(_laid, "phase int, s string, block long, slot long")
    # The rank of a row: inside its hash range, moved by the rows of its source's earlier ranges.
    ranges = max(1, -(-max(sizes.values(), default=0) // RANGE_ROWS))
    cut = F.floor((F.col("hash") / 2.0**64 + 0.5) * ranges).cast("int")
    rows = rows.withColumn("range", F.greatest(F.least(cut, F.lit(ranges - 1)), F.lit(0)))
    earlier = Window.partitionBy("s").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("s", "range").agg(F.count("*").alias("n"))
    before = before.select("s", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("s", "range").orderBy("hash", "key")) - 1 + F.col("before")
    ranked = rows.join(before, ["s", "range"]).withColumn("rank", rank)
    block = F.floor(F.col("rank") / block_rows)
    placed = ranked.select("s", "key", block.alias("block"), (F.col("rank") % block_rows).alias("place"))
    return placed.join(slots, ["s", "block"]).select(F.col("s").alias("source"), "key", "block", "phase", "slot", "place")


def mixed(
    docs: DataFrame, weights: Mapping[str, float] | None = None, source: str = "source", key: str = "doc_id",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The rows of ``docs`` in mixed order, sorted across and inside their partitions."""
    placed = placements(docs, weights, source, key, block_rows).select(
        F.struct("source", "key").alias("mix"), F.struct("slot", "place").alias("mix_at")
    )
    rows = docs.select(F.struct("*").alias("row"))
    own = F.struct(
        F.coalesce(F.col("row")[source].cast("string"), F.lit("")).alias("source"), F.col("row")[key].alias("key")
    )
    return rows.join(placed, own.eqNullSafe(F.col("mix"))).orderBy("mix_at").select("row.*")
