"""Removing repeated strings: a sampled suffix sort over all documents.

A byte goes if some string of SPAN bytes over it also starts anywhere else.  Suffixes that matter are
found by anchors: in every window of SPAN bytes the GRAM-byte string with the least hash (the first of
equals) is its anchor, so equal windows have equal anchors at equal places.  An anchor stands for the
run of window starts that share it; its context is the text those windows cover.

1. Anchors whose GRAM occurs once are done: nothing of their windows repeats.
2. Contexts that occur twice or more are done: all their windows repeat.
3. The rest, with one specimen of each context of the same GRAM, is sorted.  Suffixes are
   range-partitioned by the leading bytes of their anchors, by splitters that Spark samples; each
   bucket sorts its windows by multikey quicksort, eight bytes a token, groups of one retiring; equal
   windows stand together.  A GRAM with more than SPLIT contexts is cut at several buckets; its windows
   are compared across those boundaries by 128-bit digests.

A frequent passage is one specimen per distinct context however many copies there are.  A task holds
its bucket's share, never an unbounded group.

Null text reads as empty.  Strings never cross documents and are judged on the input.  Rows are
identified by id and text together: repeated rows count as copies of each other; null ids are
allowed.  Texts under SPAN bytes lose nothing.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screenloom.llm.common import gather_ranges, row_slices, run_starts, utf8, whole_groups
from screenloom.session import stored

SPAN = 200
GRAM = 64
WINDOW = SPAN - GRAM + 1
#: Contexts of one gram that stay in one bucket.
SPLIT = 8192
#: Contexts sorted at a time.
CONTEXTS = 4096
ANCHOR = "fp long, c long, d long, k long, lo int, size int, p int"
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def tokens_at(body: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as a number that sorts like them; zeros follow the end."""
    padded = np.concatenate([body, np.zeros(8, np.uint8)])
    return np.ndarray((len(body),), ">u8", padded, strides=(1,))


def gram_hashes(body: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes from each position on, by doubling from eight bytes."""
    h = tokens_at(body).astype(np.uint64)
    with np.errstate(over="ignore"):
        h *= np.uint64(_MIX[0])
        h ^= h >> np.uint64(32)
        step = 8
        while step < GRAM:
            later = np.zeros_like(h)
            later[: max(0, len(h) - step)] = h[step:]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(_MIX[1]) + later * np.uint64(_MIX[2])
            step *= 2
        h ^= h >> np.uint64(31)
    return h


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values from a position on, by block minima from both sides."""
    n = len(values)
    blocks = -(-n // width) + 1
    full = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = values
    grid = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(grid, axis=1).ravel()
    return np.minimum(ahead[:n], behind[width - 1 : n + width - 1])


def anchors_of(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, gram hash, first window start, number of window starts and place of each anchor in the slice."""
    size = np.diff(offsets)
    rows = np.flatnonzero(size >= SPAN)
    h = gram_hashes(body)
    with np.errstate(over="ignore"):
        order = (h * np.uint64(_MIX[3])) & np.uint64(0xFFFFFFFF00000000) | np.arange(len(h), dtype=np.uint64)
    ends = gather_ranges(np.maximum(offsets[1:] - GRAM + 1, offsets[:-1]), np.minimum(size, GRAM - 1))
    order[ends] = np.iinfo(np.uint64).max
    first = sliding_least(order, WINDOW)
    starts = gather_ranges(offsets[rows], size[rows] - SPAN + 1)
    owner = np.repeat(rows, size[rows] - SPAN + 1)
    place = (first[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begin = run_starts(owner, place)
    count = np.diff(np.append(begin, len(starts)))
    place = place[begin]
    return owner[begin], h[place].view(np.int64), starts[begin], count, place


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _anchors(docs: DataFrame) -> DataFrame:
    """All anchors of (d, text): gram hash, context hash, row, and the run of window starts."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            d, k = batch.column("d").to_numpy(), batch.column("k").to_numpy()
            for a, b in row_slices(np.diff(offsets)):
                body, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                row, fp, lo, count, place = anchors_of(body, own)
                view = memoryview(np.ascontiguousarray(body))
                c = [digest(view[x:y]) for x, y in zip(lo.tolist(), (lo + count + SPAN - 1).tolist(), strict=True)]
                row_start = own[row]
                columns = [
                    fp, np.array(c, np.uint64).view(np.int64), d[a:b][row], k[a:b][row],
                    (lo - row_start).astype(np.int32), count.astype(np.int32), (place - row_start).astype(np.int32),
                ]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["fp", "c", "d", "k", "lo", "size", "p"])

    return docs.mapInArrow(find, ANCHOR)


@F.arrow_udf(T.BinaryType())
def _pressed(column: pa.Array) -> pa.Array:
    press = zstandard.ZstdCompressor(level=1)
    return pa.array([press.compress(t) for t in pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()], pa.binary())


def _unpressed(z: bytes) -> bytes:
    return zstandard.decompress(z) if z else b""


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, k, start, stop): window starts whose strings occur elsewhere, as ranges, last included."""
    named = _named(docs, key, text)
    anchors = _anchors(named)
    # Stored, so that the join may split a frequent gram over tasks.
    twice = stored(anchors.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp"), "grams")
    met = stored(anchors.join(twice, "fp"), "anchors")
    shape = ["fp", "c", "size", (F.col("p") - F.col("lo")).alias("at")]
    contexts = stored(
        met.select(*shape, "d", "k", "lo").groupBy("fp", "c", "size", "at")
        .agg(F.count("*").alias("n"), F.min(F.struct("d", "k", "lo")).alias("one")), "contexts"
    )
    whole = contexts.filter("n > 1").select("fp", "c", "size", "at")
    settled = met.select(*shape, "d", "k", "lo").join(whole, ["fp", "c", "size", "at"])
    settled = settled.select("d", "k", F.col("lo").alias("start"), (F.col("lo") + F.col("size") - 1).alias("stop"))
    open_ = contexts.groupBy("fp").agg(F.count("*").alias("contexts"), F.min("n").alias("least")).filter("least = 1")
    parts = F.ceil(F.col("contexts") / SPLIT)
    specimens = contexts.join(open_.select("fp", parts.alias("parts")), "fp").select(
        "one.*", "fp", "c", "size", "at", (F.col("n") == 1).alias("single"),
        F.pmod("c", "parts").cast("int").alias("sub"), (F.col("parts") > 1).alias("split"),
    )
    sorted_ = stored(_sorted(_specimen_texts(named, specimens)), "sorted")
    found = sorted_.filter("g1 is null").select("d", "k", "start", "stop")
    return settled.union(found).union(_across(sorted_.filter("g1 is not null")))


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(d, k, text): a row goes by its id and the hash of its text."""
    return docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("d"), F.xxhash64(text).alias("k"), F.col(text).alias("text")
    )


def _specimen_texts(named: DataFrame, specimens: DataFrame) -> DataFrame:
    """Specimens with the bytes of their contexts and two leading tokens of their anchors."""
    wanted = specimens.groupBy("d", "k").agg(F.collect_list(F.struct("fp", "sub", "lo", "size", "at", "single", "split")).alias("w"))
    joined = named.select("d", "k", _pressed("text").alias("z")).join(wanted, ["d", "k"]).select("d", "k", "z", "w")
    names = ["lead1", "lead2", "fp", "d", "k", "sub", "lo", "size", "at", "single", "split", "body"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, k, z, w in zip(*(batch.column(c).to_pylist() for c in ("d", "k", "z", "w")), strict=True):
                body = _unpressed(z)
                for x in w:
                    own = body[x["lo"] : x["lo"] + x["size"] + SPAN - 1]
                    lead = [int.from_bytes(own[x["at"] + i : x["at"] + i + 8], "big") - (1 << 63) for i in (0, 8)]
                    rows.append((*lead, x["fp"], d, k, x["sub"], x["lo"], x["size"], x["at"], x["single"], x["split"], own))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    kinds = [pa.int64()] * 5 + [pa.int32()] * 4 + [pa.bool_()] * 2 + [pa.binary()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    return joined.mapInArrow(
        cut,
        "lead1 long, lead2 long, fp long, d long, k long, sub int, lo int, size int, at int, "
        "single boolean, split boolean, body binary",
    )


def _sorted(specimens: DataFrame) -> DataFrame:
    """Repeated windows of single contexts by bucket; and digests of the windows of grams that are cut."""

    keys = ["lead1", "lead2", "fp", "sub"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys, CONTEXTS):
            yield from _bucket_part(table)

    dealt = specimens.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(search, "d long, k long, start int, stop int, g1 long, g2 long")


def _bucket_part(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Sorts whole groups; of a gram that is cut it also tells what the other buckets may need."""
    fp, d, k, lo, size, at = (table.column(c).to_numpy() for c in ("fp", "d", "k", "lo", "size", "at"))
    single = table.column("single").to_numpy()
    body, offsets = utf8(table.column("body").combine_chunks())
    body, offsets = body[offsets[0] : offsets[-1]], offsets - offsets[0]
    edge = table.column("split").to_numpy()
    found = np.zeros(int(size.sum()), bool)
    first = np.cumsum(size) - size
    token = tokens_at(body)
    for back in range(int(at.max()) + 1):
        # Windows that start ``back`` bytes before their anchor: only such can equal each other.
        own = np.flatnonzero((back <= at) & (back > at - size))
        if len(own):
            equal = equal_strings(token, offsets[own] + at[own] - back, fp[own])
            found[first[own] + at[own] - back] = equal
    owner = np.repeat(np.arange(len(fp)), size)
    start = np.arange(len(found)) - first[owner]
    hit = found & single[owner]
    runs = run_starts(owner, hit.astype(np.int8)) if len(hit) else np.zeros(0, np.int64)
    stop = np.append(runs[1:], len(hit)) - 1
    runs, stop = runs[hit[runs]], stop[hit[runs]]
    base = lo[owner[runs]]
    none = pa.nulls(len(runs), pa.int64())
    names = ["d", "k", "start", "stop", "g1", "g2"]
    yield pa.RecordBatch.from_arrays(
        [pa.array(d[owner[runs]]), pa.array(k[owner[runs]]), pa.array((base + start[runs]).astype(np.int32)), pa.array((base + start[stop]).astype(np.int32)), none, none], names
    )
    if edge.any():
        view = memoryview(np.ascontiguousarray(body))
        every = np.flatnonzero(edge[owner])
        digests = [xxhash.xxh3_128_digest(view[x : x + SPAN]) for x in (offsets[:-1][owner[every]] + start[every]).tolist()]
        g = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        asks = single[owner[every]] & ~found[every]
        at_ = (lo[owner[every]] + start[every]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(d[owner[every]], mask=~asks), pa.array(k[owner[every]], mask=~asks), pa.array(at_), pa.array(at_), pa.array(g[:, 0]), pa.array(g[:, 1])], names
        )


def equal_strings(token: np.ndarray, pointer: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether a SPAN-byte string equals another of its group: multikey quicksort, a token at a time."""
    out = np.zeros(len(pointer), bool)
    order = np.argsort(group, kind="stable")
    part = group[order]
    for depth in range(0, SPAN, 8):
        own = token[pointer[order] + depth].astype(np.uint64)
        by = np.lexsort((own, part))
        order, part, own = order[by], part[by], own[by]
        start = run_starts(part, own)
        size = np.diff(np.append(start, len(order)))
        stay = np.repeat(size > 1, size)
        part = np.repeat(np.arange(len(start)), size)[stay]
        order = order[stay]
        if not len(order):
            return out
    out[order] = True
    return out


def _across(edges: DataFrame) -> DataFrame:
    """Windows of cut grams that a window of another bucket equals."""
    twice = edges.groupBy("g1", "g2").agg(F.count("*").alias("n")).filter("n > 1").select("g1", "g2")
    return edges.filter("d is not null").join(twice, ["g1", "g2"]).select("d", "k", "start", "stop")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", with_kept: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row.

    kept are the bytes left, null unless ``with_kept``.
    """
    ranges = repeated(docs, key, text).groupBy("d", "k").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    named = _named(docs, key, text).select("d", "k", _pressed("text").alias("z"))
    null_id = F.lit(-(2**63))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, spans, digest, kept = [], [], [], [], []
            ranges = batch.column("ranges")
            for i, z in enumerate(batch.column("z").to_pylist()):
                body = np.frombuffer(_unpressed(z), np.uint8)
                step = np.zeros(len(body) + 1, np.int64)
                if ranges[i].is_valid:
                    own = ranges[i].values
                    np.add.at(step, own.field("start").to_numpy(), 1)
                    np.add.at(step, own.field("stop").to_numpy() + SPAN, -1)
                gone = np.cumsum(step[:-1]) > 0
                left = body[~gone].tobytes()
                n.append(len(body))
                removed.append(int(gone.sum()))
                spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                digest.append(hashlib.sha256(left).hexdigest())
                kept.append(left if with_kept else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("d"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())],
                ["d", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    done = named.join(ranges, ["d", "k"], "left").select("d", "z", "ranges")
    out = done.mapInArrow(remove, "d long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumn("doc_id", F.when(F.col("d") != null_id, F.col("d"))).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"
    )
