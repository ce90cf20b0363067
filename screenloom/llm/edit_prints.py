"""Document fingerprints by a randomised edit embedding, and near-duplicate groups found by bit-sampled bands.

Embedding: a walk reads a text from its first code point; at step j it writes the character c it stands on
and moves on by r(j, c), which is 0 or 1, drawn once and shared by all texts.  Two texts within a small edit
distance fall into step again after each edit, so the written sequences differ in few places.  A long text
is walked in blocks of BLOCK code points, each from step 0, so that all walks of a batch go on side by side in
numpy; a shift at the start of a block is an edit like any other.  Step j of block b is place 3 * BLOCK * b + j.

Fingerprint: the symbols (four hashed bits of the character, a hex digit) at sampled places: the first 32, then
32 drawn from every octave 2^k .. 2^(k+1), so its length grows with the logarithm of the text.  Places of a
block after its walk has ended are '-'; those at the end are left out.  Likeness of two fingerprints: the
share of agreeing symbols where both have one, less what chance gives, times the share of places both have;
every sampled place weighs as many places as it stands for.  Equal texts have likeness 1.

Edited texts: the next document in the order of ids is the next row of a range.  Ranges of ids are cut at
sampled rows; the row at a cut goes to the range before it too, as its end, so every text moves once,
compressed, and none is gathered with all others.

Null texts are empty; the empty text has the empty fingerprint, alike (1) with another empty one and with
nothing else (0).  A null id counts as the largest long.  Equal ids follow each other in the order of a hash
of their texts; each row is a row of its own, and a row's next may be its copy.  One row is its own next.
Ids are cast to longs.  An empty table gives no row.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenloom.llm.common import roots, row_slices, run_starts, whole_groups
from screenloom.llm.components import components
from screenloom.session import stored

BLOCK = 4096
STEPS = 3 * BLOCK
SEED = 11
PER_OCTAVE = 32
#: Symbols that a hashed character can be.
SYMBOLS = 16
PAD = 255
#: Code points that are walked together; a longer text is walked alone.
SLICE = 1 << 21
#: Code points of a range, as long as there are no more than MOST_RANGES of them.
RANGE_CHARS = 1 << 23
MOST_RANGES = 1 << 15
#: Sampled rows per range that the cuts are taken from.
OVERSAMPLE = 16
LAST = (1 << 63) - 1

_rng = np.random.default_rng(SEED)
#: r(j, c) for every step and class of characters; class 0 is the end of a block, where walks stay.
_MOVES = np.concatenate([np.zeros((STEPS, 1), np.uint8), _rng.integers(0, 2, (STEPS, 255), np.uint8)], axis=1)
#: The symbol of a class, drawn anew for each of 256 steps.
_SYMBOL = _rng.integers(0, SYMBOLS, (256, 256), np.uint8)
_DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)
_VALUE = np.full(256, PAD, np.uint8)
_VALUE[_DIGITS] = np.arange(SYMBOLS)


@cache
def octave(k: int) -> np.ndarray:
    """Sampled places of an octave, ascending; k = 5 also holds the places before it."""
    if 1 << k <= PER_OCTAVE:
        return np.arange(2 << k)
    drawn = np.random.default_rng([SEED, k]).choice(1 << k if k < 24 else 1 << 24, PER_OCTAVE, replace=False)
    return np.sort(drawn.astype(np.int64) << max(k - 24, 0)) + (1 << k)


@cache
def places(octaves: int) -> tuple[np.ndarray, np.ndarray]:
    """All sampled places below 2^(octaves + 1), and how many places each stands for."""
    first = PER_OCTAVE.bit_length() - 1
    parts = [octave(k) for k in range(first, max(octaves, first) + 1)]
    weight = [np.ones(len(parts[0])), *(np.full(PER_OCTAVE, 2.0**k / PER_OCTAVE) for k in range(first + 1, max(octaves, first) + 1))]
    return np.concatenate(parts), np.concatenate(weight)


def classes(texts: list[str]) -> np.ndarray:
    """Class 1 to 255 of every code point, one text after the other."""
    out = []
    for a, b in row_slices(np.array([len(t) for t in texts], np.int64), SLICE):
        joined = texts[a] if b == a + 1 else "".join(texts[a:b])
        for i in range(0, len(joined), SLICE):
            code = np.frombuffer(joined[i : i + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)
            out.append((code % 255 + 1).astype(np.uint8))
    return np.concatenate(out) if out else np.zeros(0, np.uint8)


def embedded(texts: list[str]) -> np.ndarray:
    """Symbols at the sampled places, a row per text; PAD where a walk has ended."""
    sizes = np.array([len(t) for t in texts], np.int64)
    count = -(-sizes // BLOCK)
    place, _ = places(int(max(count.max(initial=0), 1) * STEPS - 1).bit_length() - 1)
    out = np.full((len(texts), len(place)), PAD, np.uint8)
    total = int(count.sum())
    if not total:
        return out
    row = np.repeat(np.arange(len(texts)), count)
    number = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(BLOCK, sizes[row] - number * BLOCK)
    # Blocks stand one after the other, each followed by a 0.
    body = np.zeros(int(sizes.sum()) + total, np.uint8)
    body[np.arange(int(sizes.sum())) + np.repeat(np.arange(total), length)] = classes(texts)
    at = np.cumsum(length + 1) - length - 1
    wanted: dict[int, list[tuple[int, int]]] = {}
    for i, p in enumerate(place.tolist()):
        if p // STEPS < count.max():
            wanted.setdefault(p % STEPS, []).append((p // STEPS, i))
    first = np.flatnonzero(number == 0)
    for j in range(STEPS):
        if not j % 64:
            on = body[at] != 0
            if not on.all():
                at, row, number = at[on], row[on], number[on]
                first = np.flatnonzero(number == 0)
            if not len(at):
                break
        char = body.take(at)
        for block, i in wanted.get(j, ()):
            here = first if not block else np.flatnonzero(number == block)
            seen = char[here]
            out[row[here], i] = np.where(seen > 0, _SYMBOL[j & 255].take(seen), PAD)
        at += _MOVES[j].take(char)
    return out


def as_text(symbols: np.ndarray) -> list[str]:
    """One fingerprint string per row."""
    digits = np.where(symbols == PAD, np.uint8(45), _DIGITS[np.minimum(symbols, SYMBOLS - 1)])
    return [r.tobytes().rstrip(b"-").decode() for r in digits]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of paired rows of symbols (0 to 1)."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1])), constant_values=PAD) for x in (a, b))
    _, weight = places(_octaves(width))
    has_a, has_b = a != PAD, b != PAD
    both = (has_a & has_b) @ weight
    either = (has_a | has_b) @ weight
    agree = (has_a & has_b & (a == b)) @ weight / np.maximum(both, 1e-300)
    beyond = np.maximum(0, (agree - 1 / SYMBOLS) / (1 - 1 / SYMBOLS))
    return np.where(either > 0, beyond * both / np.maximum(either, 1e-300), 1.0)


def _octaves(width: int) -> int:
    """The last octave of a fingerprint of ``width`` sampled places."""
    first = PER_OCTAVE.bit_length() - 1
    return first + -(-(width - 2 * PER_OCTAVE) // PER_OCTAVE)


def symbols_of(prints: list[str]) -> np.ndarray:
    """The symbols of fingerprint strings, a row each, to the longest one's full octave."""
    longest = max(map(len, prints), default=0)
    width = 2 * PER_OCTAVE + max(0, -(-(longest - 2 * PER_OCTAVE) // PER_OCTAVE)) * PER_OCTAVE
    joined = "".join(p.ljust(width, "-") for p in prints).encode()
    return _VALUE[np.frombuffer(joined, np.uint8)].reshape(len(prints), width)


def _place(key: str, text: str) -> tuple[Column, Column]:
    """What rows are ordered by: the id, and among equal ids a hash of the text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(F.lit(SEED), whole).alias("h")


def cuts(keys: DataFrame) -> tuple[list[tuple[int, int]], tuple[int, int] | None]:
    """(id, hash) of the first row of every range after the first, and of the first row of all.

    What comes back is at most OVERSAMPLE keys for each of MOST_RANGES ranges, give or take the draw.
    """
    n, chars, least = keys.agg(F.count("*"), F.sum("n"), F.min(F.struct("id", "h"))).first()
    if not n:
        return [], None
    ranges = min(MOST_RANGES, max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), chars // RANGE_CHARS))
    every = max(1, n // (ranges * OVERSAMPLE))
    drawn = keys.filter(F.pmod(F.xxhash64(F.lit(1), "id", "h"), F.lit(every)) == 0).select("id", "h").toArrow()
    rows = sorted(set(zip(drawn["id"].to_pylist(), drawn["h"].to_pylist(), strict=True)))
    step = max(1, len(rows) // ranges)
    return rows[step::step], (least["id"], least["h"])


def ranges_of(id_: np.ndarray, h: np.ndarray, cut: list[tuple[int, int]]) -> np.ndarray:
    """How many cuts are at or before each (id, hash)."""
    ids = np.array([c[0] for c in cut], np.int64)
    low, high = np.searchsorted(ids, id_, "left"), np.searchsorted(ids, id_, "right")
    for i in np.flatnonzero(low < high).tolist():
        high[i] = bisect_right(cut, (int(id_[i]), int(h[i])), low[i], high[i])
    return high


def in_ranges(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(range, guard, id, h, doc_id, body): compressed texts in the order of ids, each range in one partition.

    The first row of the next range (of the first one, for the last range) follows as a guard.
    """
    cut, least = cuts(stored(docs.select(*_place(key, text), F.coalesce(F.length(text), F.lit(0)).alias("n")), "keys"))
    ends = set(cut)
    held = docs.sparkSession.sparkContext.broadcast((cut, ends, least))
    body = F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body")
    hashed = docs.select(F.col(key).cast("long").alias("doc_id"), *_place(key, text), body)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, ends, least = held.value
        small = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            id_, h = batch.column("id").to_numpy(), batch.column("h").to_numpy()
            body = pa.array([small.compress(b) for b in batch.column("body").to_pylist()], pa.binary())
            own = ranges_of(id_, h, cut)
            pairs = list(zip(id_.tolist(), h.tolist(), strict=True))
            first = np.array([i for i, p in enumerate(pairs) if p in ends], np.int64)
            start = np.array([i for i, p in enumerate(pairs) if p == least], np.int64)
            row = np.concatenate([np.arange(len(own)), first, start])
            to = np.concatenate([own, own[first] - 1, np.full(len(start), len(cut))])
            guard = np.arange(len(row)) >= len(own)
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(to.astype(np.int32)), pa.array(guard), *(batch.column(c).take(taken) for c in ("id", "h", "doc_id")), body.take(taken)],
                ["range", "guard", "id", "h", "doc_id", "body"],
            )

    moved = hashed.mapInArrow(pack, "range int, guard boolean, id long, h long, doc_id long, body binary")
    return moved.repartitionById(len(cut) + 1, F.col("range")).sortWithinPartitions("range", "guard", "id", "h")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, bands_edited long, bands_next long"


def edited_texts(texts: list[str], following: list[str]) -> list[str]:
    """The second half of each text replaced by as much of the one that follows."""
    return [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following, strict=True)]


def with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, their likeness to it and to the next text, and the bands shared."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor()
        held = None  # the last row, whose next is yet to come
        for batch in batches:
            size = np.array([zstandard.frame_content_size(b.as_buffer()) for b in batch.column("body")], np.int64)
            for a, b in row_slices(size, SLICE):
                part = batch.slice(a, b - a)
                texts = [plain.decompress(x.as_buffer()).decode() for x in part.column("body")]
                ids, ranges, guards = (part.column(c).to_pylist() for c in ("doc_id", "range", "guard"))
                symbols = embedded(texts)
                if held is not None:
                    texts, ids, ranges, guards = [held[0], *texts], [held[1], *ids], [held[2], *ranges], [held[3], *guards]
                    width = max(symbols.shape[1], len(held[4]))
                    both = (held[4][None], symbols)
                    symbols = np.concatenate([np.pad(s, ((0, 0), (0, width - s.shape[1])), constant_values=PAD) for s in both])
                own = [i for i in range(len(texts) - 1) if not guards[i] and ranges[i] == ranges[i + 1]]
                if own:
                    yield _edited_rows([texts[i] for i in own], [texts[i + 1] for i in own], [ids[i] for i in own], symbols[own], symbols[np.array(own) + 1])
                held = (texts[-1], ids[-1], ranges[-1], guards[-1], symbols[-1])

    return in_ranges(docs, key, text).mapInArrow(work, EDITED)


def _edited_rows(texts: list[str], following: list[str], ids: list, symbols: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
    edited = edited_texts(texts, following)
    other = embedded(edited)
    bands, bands_edited, bands_next = (band_keys(s, lengths_of(s)) for s in (symbols, other, after))
    columns = [
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
        pa.array(as_text(symbols)),
        pa.array(as_text(other)),
        pa.array(likeness(symbols, other)),
        pa.array(likeness(symbols, after)),
        pa.array(shared_bands(bands, bands_edited)),
        pa.array(shared_bands(bands, bands_next)),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in EDITED.split(", ")])


# Near-duplicate groups

#: Bands of a block of 32 symbols, and the symbols (of four bits each) that a band samples.
BANDS = 8
BAND_SYMBOLS = 10
#: Likeness from which two fingerprints are linked.
NEAR = 0.9
#: Fingerprints of one bucket compared in one task with each other or with another such chunk.
CHUNK = 1024


def _sampled(block: int) -> np.ndarray:
    """The symbols that each band of a block samples."""
    rng = np.random.default_rng([SEED, 1, block])
    return np.stack([rng.choice(PER_OCTAVE, BAND_SYMBOLS, replace=False) for _ in range(BANDS)])


def band_keys(symbols: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Keys of all bands, a row per fingerprint: the sampled bits of its last two full blocks; -1 for a block it lacks.

    Texts whose fingerprints differ by less than a block in length share one of their two blocks.
    """
    full = length // PER_OCTAVE
    keys = np.full((len(symbols), 2 * BANDS), -1, np.int64)
    bits = np.where(symbols == PAD, 0, symbols).astype(np.int64)
    for back in (1, 2):
        for block in np.unique(full[full >= back] - back).tolist():
            here = np.flatnonzero(full - back == block)
            for band, chosen in enumerate(_sampled(block)):
                value = (bits[here][:, block * PER_OCTAVE + chosen] << (4 * np.arange(BAND_SYMBOLS))).sum(1)
                keys[here, (back - 1) * BANDS + band] = value | band << 40 | block << 48
    return keys


def lengths_of(symbols: np.ndarray) -> np.ndarray:
    """Symbols of each fingerprint up to its last one."""
    return np.where(symbols != PAD, np.arange(1, symbols.shape[1] + 1), 0).max(1, initial=0)


def shared_bands(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bands paired rows of keys share."""
    return ((a[:, :, None] == b[:, None, :]) & (a >= 0)[:, :, None]).any(2).sum(1)


def near_groups(prints: DataFrame, near: float = NEAR) -> DataFrame:
    """(doc_id, component_id) of (doc_id, fingerprint): the smallest id reachable over links of likeness ``near``.

    Distinct fingerprints are the nodes (told apart by 64-bit hashes).  Candidates share a band; every pair of a
    bucket is verified or already joined, large buckets chunk pair by chunk pair; buckets with the same
    members are compared once.  Fingerprints of less than 32 symbols (about 16 characters) group with equal ones only.
    A null id is in no group of others: it gets null where no other id has its text.
    """
    nodes = stored(
        prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")).withColumn("node", F.xxhash64("fingerprint")), "nodes"
    )

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("fingerprint").to_pylist()
            keys = band_keys(symbols_of(texts), np.array([len(t) for t in texts], np.int64))
            row, column = np.nonzero(keys >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(keys[row, column]), batch.column("node").take(pa.array(row))], ["band", "node"])

    bands = stored(nodes.select("fingerprint", "node").mapInArrow(band, "band long, node long"), "bands")
    members = F.sum(F.xxhash64("node").cast("decimal(38,0)"))
    buckets = bands.groupBy("band").agg(F.count("*").alias("n"), members.alias("members"), F.min("node").alias("least"))
    once = buckets.filter("n > 1").groupBy("n", "members", "least").agg(F.min("band").alias("band"))
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    met = bands.join(once.select("band", chunks.alias("chunks")), "band")
    own = F.pmod(F.xxhash64(F.lit(2), "node"), F.col("chunks")).cast("int")
    dealt = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("band", F.least("own", "other").alias("c"), F.greatest("own", "other").alias("d"), "node")
    keys = ["band", "c", "d"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, keys, rows=4 * CHUNK):
            node = part.column("node").to_numpy()
            symbols = symbols_of(part.column("fingerprint").to_pylist())
            start = run_starts(*(part.column(k).to_numpy() for k in keys))
            for a, b in zip(start.tolist(), [*start[1:].tolist(), len(node)], strict=True):
                head, tail = joined(symbols[a:b], near)
                yield pa.RecordBatch.from_arrays([pa.array(node[a:b][head]), pa.array(node[a:b][tail])], ["a", "b"])

    whole = dealt.join(nodes.select("node", "fingerprint"), "node").select(*keys, "node", "fingerprint")
    links = whole.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(link, "a long, b long")
    found = components(links)
    smallest = nodes.join(found, "node").groupBy("root").agg(F.min("first").alias("component_id"))
    named = nodes.join(found.join(smallest, "root").select("node", "component_id"), "node", "left")
    named = named.select("fingerprint", F.coalesce("component_id", "first").alias("component_id"))
    return prints.join(named, "fingerprint").select("doc_id", "component_id")


def joined(symbols: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest that joins all pairs of rows of likeness ``near``: each tree's leader is compared with all rows left."""
    n = len(symbols)
    tree = np.full(n, -1)
    heads, tails = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(n):
        if tree[i] >= 0 and tree[i] == tree[0]:
            continue
        # Rows of the first row's tree are joined already; every other row meets all rows.
        other = np.flatnonzero(np.arange(n) != i)
        hit = other[likeness(np.broadcast_to(symbols[i], (len(other), symbols.shape[1])), symbols[other]) >= near]
        if not i:
            tree[0] = 0
            tree[hit] = 0
        heads.append(np.full(len(hit), i))
        tails.append(hit)
    head, tail = np.concatenate(heads), np.concatenate(tails)
    root = roots(head, tail, n)
    leaf = np.flatnonzero(root != np.arange(n))
    return leaf, root[leaf]
