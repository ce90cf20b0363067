"""Byte-level BPE as a monoid: encode halves, join neighbours at their seam, concatenate back.

A sequence of tokens is the encoding of its bytes exactly when each two neighbours are *apart*:
encoding their joined bytes gives the two tokens again.  (Merges run by rank, then from the left.
Were some merge to cross a boundary, take the first one that does; until then both its sides have
merged as they do alone, so the same merge would cross it in the encoding of that pair.)  So two
encodings are joined by re-encoding a window around the seam, widened on a side until the token
outside it and the first token inside are apart; everything beyond then provably stands.

The pattern's matches are encoded one by one; their encodings join by concatenation.  A match of any
length is a balanced tree of halves, never one quadratic loop.

Null text reads as empty: no tokens, empty decoding.  Ids unknown to the table raise an error.
Encoding and decoding are columns: repeated rows and other columns of the caller do not matter.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenloom.llm.common import gather_ranges, give_back, no_cycle_search, row_slices, utf8

#: Bytes up to which a leaf is merged directly, and up to which the merge is a plain loop.
LEAF_BYTES = 4
LOOP_BYTES = 48
#: Entries that each memo (of matches, pieces, pairs) may hold; the older half goes when it is full.
MEMO = 100_000
#: Bytes up to which pieces, and characters up to which matches, go into the memos.
MEMO_BYTES = 48
#: Above every rank.
NEVER = 1 << 40
#: Matches of a long text that are read at a time, ids that are decoded at a leaf.
BLOCK = 1 << 16
#: Matches that are encoded together.
MATCHES = 1 << 18


class Memo:
    """A bounded memo; when the young half is full it takes the place of the old one."""

    def __init__(self):
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        out = self.young.get(key)
        if out is None and (out := self.old.get(key)) is not None:
            self.put(key, out)
        return out

    def put(self, key, value) -> None:
        if len(self.young) >= MEMO // 2:
            self.old, self.young = self.young, {}
        self.young[key] = value


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern)
        self.token = {r: t for t, r in ranks.items()}
        self._pieces = Memo()
        self._pairs = Memo()
        self._matches = Memo()

    def piece(self, body: bytes) -> tuple[int, ...]:
        """Encoding of some bytes: a token, or the tree over their halves."""
        known = self.ranks.get(body)
        if known is not None:
            return (known,)
        short = len(body) <= MEMO_BYTES
        out = self._pieces.get(body) if short else None
        if out is None:
            out = self.halves(body)
            if short:
                self._pieces.put(body, out)
        return out

    def halves(self, body: bytes) -> tuple[int, ...]:
        if len(body) <= LEAF_BYTES:
            return self.merged(body)
        half = len(body) // 2
        return self.join(self.piece(body[:half]), self.piece(body[half:]))

    def join(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
        """Encoding of the joined bytes of two encodings."""
        if not a or not b:
            return a + b
        i, j, mid = len(a) - 1, 1, self.pair(a[-1], b[0])
        while True:
            fits_left = i == 0 or self.pair(a[i - 1], mid[0]) == (a[i - 1], mid[0])
            fits_right = j == len(b) or self.pair(mid[-1], b[j]) == (mid[-1], b[j])
            if fits_left and fits_right:
                return a[:i] + mid + b[j:]
            i = i if fits_left else max(0, 2 * i - len(a))
            j = j if fits_right else min(len(b), 2 * j)
            mid = self.merged(b"".join(map(self.token.__getitem__, a[i:] + b[:j])))

    def pair(self, x: int, y: int) -> tuple[int, ...]:
        """Encoding of two tokens' joined bytes: the two themselves if they are apart."""
        out = self._pairs.get((x, y))
        if out is None:
            out = self.merged(self.token[x] + self.token[y])
            self._pairs.put((x, y), out)
        return out

    def merged(self, body: bytes) -> tuple[int, ...]:
        """Merge by rank, then from the left."""
        if len(body) > LOOP_BYTES:
            return self._merged_by_heap(body)
        get, parts = self.ranks.get, [body[i : i + 1] for i in range(len(body))]
        pairs = [get(body[i : i + 2], NEVER) for i in range(len(body) - 1)]
        while pairs and (best := min(pairs)) < NEVER:
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], NEVER)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], NEVER)
        return tuple(map(self.ranks.__getitem__, parts))

    def _merged_by_heap(self, body: bytes) -> tuple[int, ...]:
        """The same for long windows; n log n by a heap over linked parts."""
        n, get = len(body), self.ranks.get
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(body[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := end[i]) >= n or end[j] != stop:
                continue
            alive[j] = 0
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := get(body[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := get(body[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[body[i : end[i]]])
            i = end[i]
        return tuple(out)

    def match(self, text: str) -> tuple[int, ...]:
        """Ids of one match of the pattern, by way of the memo."""
        out = self._matches.get(text)
        if out is None:
            body = text.encode("utf-8", "surrogatepass")
            known = self.ranks.get(body)
            out = self.halves(body) if known is None else (known,)
            if len(text) <= MEMO_BYTES:
                self._matches.put(text, out)
        return out

    def ids_of(self, matches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all matches, one after the other, and how many each has; distinct ones are encoded once."""
        coded = pa.array(matches, pa.large_string()).dictionary_encode()
        each = [self.match(x) for x in coded.dictionary.to_pylist()]
        size = np.fromiter(map(len, each), np.int64, len(each))
        ids = np.fromiter(chain.from_iterable(each), np.int32, int(size.sum()))
        use = coded.indices.to_numpy()
        return ids[gather_ranges((np.cumsum(size) - size)[use], size[use])], size[use]

    @no_cycle_search()
    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, one after the other, and how many each text has."""
        ids, counts = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        matches: list[str] = []
        ends: list[tuple[int, int]] = []

        def encode() -> None:
            found, size = self.ids_of(matches)
            ids.append(found)
            done = np.concatenate([[0], np.cumsum(size)])
            stops = [n for _, n in ends]
            for (i, stop), start in zip(ends, [0, *stops], strict=False):
                counts[i] += done[stop] - done[start]
            matches.clear()
            ends.clear()

        for i, text in enumerate(texts):
            rest = self.split.finditer(text or "")
            # A block at a time, so that a long text is never held as a list of all its matches.
            while block := [m.group() for m in islice(rest, BLOCK)] if text and len(text) > BLOCK else self.split.findall(text or ""):
                matches += block
                ends.append((i, len(matches)))
                if len(matches) >= MATCHES:
                    encode()
                if len(text) <= BLOCK:
                    break
        encode()
        return np.concatenate(ids), counts

    def encode(self, text: str) -> list[int]:
        return self.batch([text])[0].tolist()


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        size = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        for t, r in ranks.items():
            size[r] = len(t)
        self.size = size
        self.start = np.cumsum(size) - size
        body = bytearray(int(size.sum()))
        for t, r in ranks.items():
            body[self.start[r] : self.start[r] + len(t)] = t
        self.body = np.frombuffer(bytes(body), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """Concatenation up the tree of halves; a leaf is one gather over the token table."""
        if len(ids) > BLOCK:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size) or not self.size[ids].all()):
            raise ValueError("a token id is not in the rank table")
        return self.body[gather_ranges(self.start[ids], self.size[ids])].tobytes()


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of bounded size, so that few rows are Python objects at a time."""
    return row_slices(np.diff(np.asarray(column.offsets) if pa.types.is_list(column.type) else utf8(column)[1]))


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text") -> Column:
    """The token ids of a text column, an array<int>.

    The rank table is read on the driver and broadcast: its size is that of the file, whatever the data.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    @F.arrow_udf("array<int>")
    def encode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(ranks.value, pattern)
        for column in columns:
            done = [pa.array([], pa.list_(pa.int32()))]
            for a, b in _slices(column.cast(pa.large_binary())):
                ids, counts = encoder.batch(column.slice(a, b - a).to_pylist())
                done.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(ids)))
            out = pa.concat_arrays(done)
            del done
            give_back()
            yield out

    return encode(F.col(text))


def decoded(docs: DataFrame, path: str, ids: str = "ids") -> Column:
    """The bytes of a column of token ids; null ids decode to no bytes."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    @F.arrow_udf("binary")
    def decode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(ranks.value)
        for column in columns:
            values = column.values.to_numpy(zero_copy_only=False)
            offsets = np.asarray(column.offsets)
            done = [pa.array([], pa.binary())]
            for a, b in _slices(column):
                done.append(pa.array([decoder.decode(values[x:y]) for x, y in pairwise(offsets[a : b + 1])], pa.binary()))
            out = pa.concat_arrays(done)
            del done
            give_back()
            yield out

    return decode(F.col(ids))


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> Column:
    """A struct of the token ids of a text column and ``exact``: whether they decode to its bytes.

    Both directions run in one Python worker, so ids are not sent out and back to be decoded.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    @F.arrow_udf("ids array<int>, exact boolean")
    def both(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, decoder = Encoder(ranks.value, pattern), Decoder(ranks.value)
        for column in columns:
            body = column.cast(pa.large_binary())
            done, exact = [pa.array([], pa.list_(pa.int32()))], []
            for a, b in _slices(body):
                ids, counts = encoder.batch(column.slice(a, b - a).to_pylist())
                ends = np.cumsum([0, *counts])
                exact += [decoder.decode(ids[x:y]) == (body[i].as_py() or b"") for i, (x, y) in enumerate(pairwise(ends), a)]
                done.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)))
            out = pa.StructArray.from_arrays([pa.concat_arrays(done), pa.array(exact, pa.bool_())], ["ids", "exact"])
            del done, body
            give_back()
            yield out

    return both(F.col(text))


def there_and_back(docs: DataFrame, path: str, pattern: str, text: str = "text") -> Column:
    """A struct of the token ids of a text column and ``body``, the bytes they decode to, by one Python worker."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    @F.arrow_udf("ids array<int>, body binary")
    def both(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, decoder = Encoder(ranks.value, pattern), Decoder(ranks.value)
        for column in columns:
            done, bodies = [pa.array([], pa.list_(pa.int32()))], [pa.array([], pa.binary())]
            for a, b in _slices(column.cast(pa.large_binary())):
                ids, counts = encoder.batch(column.slice(a, b - a).to_pylist())
                ends = np.cumsum([0, *counts])
                bodies.append(pa.array([decoder.decode(ids[x:y]) for x, y in pairwise(ends)], pa.binary()))
                done.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)))
            out = pa.StructArray.from_arrays([pa.concat_arrays(done), pa.concat_arrays(bodies)], ["ids", "body"])
            del done, bodies
            give_back()
            yield out

    return both(F.col(text))
