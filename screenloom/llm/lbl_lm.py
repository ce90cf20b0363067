"""Scoring texts: a log-bilinear neural language model trained by noise-contrastive estimation.

The model predicts a token from the two before it.  Every frequent word (at most VOCAB), the end, and
``tail`` (all other words) has a vector of its own as context and as target.  A context's vector is the
sum of its words' vectors, each through the matrix of its position.  Words lie in classes, runs of
like frequency, about the square root of their number; a word's probability is its class's softmax
times its own softmax inside the class, so matrix products normalise exactly.  A word of the tail gets
its share of it from smoothed counts, with a slot for unknown words; the probabilities of all tokens
then add up to one.

Training contrasts the observed class with noise classes and the observed word with noise words of its
class.  It starts from the unigram model.  Every task learns from all tokens of its own training rows,
one step per BATCH tokens, and hands on the changes of the rows of weights that it touched; Spark sums
them by row of weights, and each row moves by the mean of its changes, weighted by how often it was used.
ROUNDS such passes are made, so steps grow with the tokens.

Counts of words cover all training rows, by a shuffle on the word.  The most frequent words, at most
HEAD, travel to the tasks; the other words of each text meet their counts in a join.  Sizes broadcast and
collected are HEAD words of at most LONGEST bytes and the model of VOCAB rows, whatever the table.

Null text reads as empty: one token, the end.  Repeated rows are scored and learned as they occur.
Ties in frequency go by word.  Without training rows all counts are zero, and the end and the tail
equally likely.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenloom.llm.common import give_back, row_slices, run_starts, utf8
from screenloom.session import stored

END, TAIL = 0, 1
HEAD = 200_000
#: The most frequent words of the head, which have vectors; the others are words of the tail.
VOCAB = 1 << 15
LONGEST = 64
#: Bytes of words a task holds before it counts them and hands the counts on, and rows of counts of a batch.
COUNTED = 1 << 25
HANDED = 1 << 17
WIDTH = 16
ROUNDS = 1
BATCH = 2048
#: Noise classes of a batch, and noise words of each token inside its class.
NOISE = 64
WITHIN = 2
RATE = 0.1
#: Numbers of a block of scores, few enough for a core's cache, and tokens scored at a time.
CELLS = 1 << 17
TOKENS = 1 << 19
#: Rows of vectors fetched at a time, and words of a class from which on its repeated contexts are worth finding.
FETCHED = 1 << 12
REPEATED = 64
#: Bytes of text that are read at a time to be scored.
SCORED_BYTES = 1 << 22
#: Exponentials of products up to this, and sums of them, neither overflow nor vanish.
SAFE = 60.0


@dataclass(frozen=True)
class Counts:
    """Of training tokens: the frequent words with their counts, ends, all tokens, distinct tokens."""

    words: list[bytes]
    count: np.ndarray
    ends: int
    tokens: int
    distinct: int

    @property
    def slots(self) -> float:
        return float(self.tokens + self.distinct + 1)

    @property
    def by_place(self) -> np.ndarray:
        """Counts of the end, of all words of the tail, and of the words with vectors."""
        own = self.count[:VOCAB]
        return np.concatenate([[self.ends, self.tokens - self.ends - own.sum()], own]).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Vectors by place (targets and classes end in a bias); class c holds the places bounds[c] to bounds[c + 1]."""

    context: np.ndarray
    position: np.ndarray
    target: np.ndarray
    group: np.ndarray
    bounds: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        """The class of each place."""
        return np.repeat(np.arange(len(self.group), dtype=np.int32), np.diff(self.bounds))

    def hidden(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Vectors of contexts (first: directly before), with a last component of one for the bias."""
        return self.joined(self.context.take(first, axis=0), self.context.take(second, axis=0))

    def joined(self, before: np.ndarray, further: np.ndarray) -> np.ndarray:
        """The same from the vectors of both words."""
        out = np.ones((len(before), WIDTH + 1), np.float32)
        np.matmul(before, self.position[0], out=out[:, :WIDTH])
        out[:, :WIDTH] += further @ self.position[1]
        return out

    def log_probs(self, first: np.ndarray, second: np.ndarray, token: np.ndarray, owner: np.ndarray | None = None) -> np.ndarray:
        """Natural log-probability of each token (a place) after its context."""
        owner = self.owner if owner is None else owner
        # The class's product and, where it holds others, the word's inside it come from one row of weights.
        many = np.diff(self.bounds) > 1
        chosen = self.target * many.take(owner)[:, None]
        chosen += self.group.take(owner, axis=0)
        out = np.empty(len(token))
        for a in range(0, len(token), TOKENS):
            piece = slice(a, a + TOKENS)
            out[piece] = self._block(first[piece], second[piece], token[piece], owner, chosen)
        return out

    def _block(self, first: np.ndarray, second: np.ndarray, token: np.ndarray, owner: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        code, at = np.unique(second.astype(np.int64) << 32 | first, return_inverse=True)
        hidden = self.hidden(code & 0xFFFFFFFF, code >> 32)
        out = -_log_sum(hidden, self.group).take(at)
        for a in range(0, len(token), FETCHED):
            piece = slice(a, a + FETCHED)
            out[piece] += np.einsum("ij,ij->i", hidden.take(at[piece], axis=0), chosen.take(token[piece], axis=0))
        own = owner.take(token)
        order = _order(own, len(self.group))
        ends = np.searchsorted(own.take(order), np.arange(len(self.group) + 1))
        for c in np.flatnonzero((np.diff(self.bounds) > 1) & (np.diff(ends) > 0)):
            here = order[ends[c] : ends[c + 1]]
            words, near = self.target[self.bounds[c] : self.bounds[c + 1]], at.take(here)
            if len(words) < REPEATED:
                out[here] -= _log_sum(hidden.take(near, axis=0), words)
            else:
                seen, back = np.unique(near, return_inverse=True)
                out[here] -= _log_sum(hidden.take(seen, axis=0), words).take(back)
        return out


def _log_sum(hidden: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of the summed exponentials of all products, a block at a time.

    Products that all lie within SAFE of zero need not be brought below it first.
    """
    out, step = np.empty(len(hidden)), max(1, CELLS // len(target))
    ones = np.ones(len(target), np.float32)
    # No product is larger than the lengths of both vectors allow, with the last components' apart.
    reach = [(np.sqrt(np.vecdot(x[:, :-1], x[:, :-1]).max()), np.abs(x[:, -1]).max()) for x in (hidden, target)]
    safe = reach[0][0] * reach[1][0] + reach[0][1] * reach[1][1] <= SAFE
    for a in range(0, len(hidden), step):
        score = hidden[a : a + step] @ target.T
        most = None
        if not safe and not (score.max() <= SAFE and score.min() >= -SAFE):
            most = score.max(1, keepdims=True)
            score -= most
        np.exp(score, out=score)
        total = np.log((score @ ones).astype(np.float64))
        out[a : a + step] = total if most is None else total + most[:, 0]
    return out


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after the other, and how many each text has; null reads as empty.

    A-Z lower-cased; words lie between ASCII white space.
    """
    body, offsets = utf8(column)
    body, offsets = body[offsets[0] : offsets[-1]], offsets - offsets[0]
    lower = body + (((body - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))
    texts = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(offsets), pa.py_buffer(lower))
    split = pc.ascii_split_whitespace(texts)
    words = split.flatten().cast(pa.large_binary())
    # White space at either end of a text leaves an empty word there.
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    size = np.diff(np.append(0, np.cumsum(full)).take(split.offsets.to_numpy()))
    return words if full.all() else words.filter(pa.array(full)), size


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over all rows of a column text: counted by task, then by word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        size = 0
        for batch in batches:
            column = batch.column("text")
            for a, b in row_slices(np.diff(utf8(column)[1])):
                held.append(words_of(column.slice(a, b - a))[0])
                size += held[-1].nbytes
                if size >= COUNTED:
                    yield from _counted(held)
                    held, size = [], 0
        yield from _counted(held)
        held.clear()
        give_back()

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(held: list[pa.Array]) -> Iterator[pa.RecordBatch]:
    found = pa.chunked_array(held, pa.large_binary()).value_counts()
    for a in range(0, len(found), HANDED):
        piece = found.slice(a, HANDED).flatten()
        yield pa.RecordBatch.from_arrays([piece[0].cast(pa.binary()), piece[1]], ["word", "n"])


def gather(texts: DataFrame, counts: DataFrame, head: int = HEAD) -> Counts:
    ends = texts.count()
    n, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # The least frequency class (16 to each doubling) down to which all words fit the head.
    grade = F.floor(F.log2("n") * 16)
    short = counts.filter(F.length("word") <= LONGEST)
    grades = sorted(short.groupBy(grade.alias("grade")).count().collect(), reverse=True)
    fits = [r["grade"] for r, all_ in zip(grades, np.cumsum([r["count"] for r in grades]), strict=True) if all_ <= head]
    top = short.filter(grade >= (fits[-1] if fits else 1 << 20)).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    return Counts(top["word"].to_pylist(), top["n"].to_numpy(), ends, n + ends, distinct + (ends > 0))


class Reader:
    """Tokens of a slice of texts as places in the head (0 the end, from 2 the words, 1 all others)."""

    def __init__(self, words: list[bytes]):
        self.head = pa.array(words, pa.large_binary())

    def read(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Places of all tokens, where each text begins, and the words of all texts."""
        words, size = words_of(column)
        ends = np.cumsum(size + 1)
        out = np.full(len(words) + len(size), END, np.int32)
        inside = np.ones(len(out), bool)
        inside[ends - 1] = False
        out[inside] = pc.fill_null(pc.index_in(words, value_set=self.head), TAIL - 2).to_numpy(zero_copy_only=False) + 2
        return out, ends - size - 1, words

    @staticmethod
    def contexts(classes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class before each token and the one before that; before a text there are ends."""
        first, second = np.roll(classes, 1), np.roll(classes, 2)
        first[starts] = second[starts] = END
        later = starts + 1
        second[later[later < np.append(starts[1:], len(classes))]] = END
        return first, second


def unigram_model(known: Counts) -> Model:
    """Where training starts: classes and words by their smoothed counts, whatever stands before."""
    count = known.by_place + 1.0
    places = len(count)
    mass = np.cumsum(np.sqrt(count[2:]))
    wanted = int(np.ceil(np.sqrt(places)))
    run = np.floor((mass - np.sqrt(count[2:])) / (mass[-1] if len(mass) else 1) * wanted).astype(np.int64)
    bounds = np.concatenate([[0, 1], 2 + np.flatnonzero(np.diff(run, prepend=-1)), [places]])
    total = np.add.reduceat(count, bounds[:-1])
    group = np.zeros((len(total), WIDTH + 1), np.float32)
    group[:, WIDTH] = np.log(total / total.sum())
    target = np.zeros((places, WIDTH + 1), np.float32)
    target[:, WIDTH] = np.log(count / np.repeat(total, np.diff(bounds)))
    context = np.random.default_rng(29).normal(0, 0.1, (places, WIDTH)).astype(np.float32)
    position = np.stack([np.eye(WIDTH), 0.5 * np.eye(WIDTH)]).astype(np.float32)
    return Model(context, position, target, group, bounds)


def _lots(count: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lots by which places of a class are drawn by their counts without a search.

    A place drawn evenly from its class stays with the probability in the first array; else the second names
    the place to take.  The place that lacks most is filled up by one that has too much.
    """
    keeps, instead = np.ones(len(count)), np.arange(len(count))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        left = (count[a:b] * ((b - a) / count[a:b].sum())).tolist()
        short, ample = [i for i, x in enumerate(left) if x < 1], [i for i, x in enumerate(left) if x >= 1]
        while short and ample:
            i, j = short.pop(), ample[-1]
            keeps[a + i], instead[a + i] = left[i], a + j
            left[j] -= 1 - left[i]
            if left[j] < 1:
                short.append(ample.pop())
    return keeps, instead


class Learner:
    """A copy of the model that learns from tokens: noise-contrastive steps, step sizes by past slopes."""

    def __init__(self, model: Model, known: Counts):
        self.model = Model(*(np.array(w, order="C") for w in (model.context, model.position, model.target, model.group)), model.bounds)
        self.start, self.owner = model, model.owner
        self.rng = np.random.default_rng(31)
        count = known.by_place + 1.0
        share = np.add.reduceat(count, model.bounds[:-1])
        self.share_cut = np.cumsum(share / share.sum())[:-1]
        self.first_of, self.size_of = model.bounds[:-1], np.diff(model.bounds)
        self.keeps, self.instead = _lots(count, model.bounds)
        self.log_noise = np.log(NOISE * share / share.sum()).astype(np.float32)
        self.log_within = np.log(WITHIN * count / share[self.owner]).astype(np.float32)
        self.past = [np.ones_like(w) for w in (self.model.context, self.model.position, self.model.target, self.model.group)]
        self.used, self.seat = np.zeros(len(self.owner), np.int64), np.zeros(len(self.owner), np.int64)
        self.alone = self.size_of.take(self.owner) == 1
        self.cells = {pairs: np.zeros((0, pairs), np.int64) for pairs in (WIDTH // 2, WIDTH // 2 + 1)}
        self.steps = 0

    def learn(self, first: np.ndarray, second: np.ndarray, token: np.ndarray) -> None:
        order = self.rng.permutation(len(token))
        # In a batch the words that are alone in their class come last: they have no noise words.
        alone = self.alone.take(token.take(order))
        batch = np.arange(len(order)) // BATCH
        order = order.take(_order(2 * batch + alone, 2 * len(order) // BATCH + 2))
        first, second, token = (x.take(order).astype(np.int64) for x in (first, second, token))
        with np.errstate(over="ignore"):
            for a in range(0, len(order), BATCH):
                piece = slice(a, a + BATCH)
                self.step(first[piece], second[piece], token[piece], int(np.count_nonzero(~alone[piece])))

    def step(self, first: np.ndarray, second: np.ndarray, token: np.ndarray, many: int) -> None:
        """Learn from a batch; of all tokens the first ``many`` share their class with others."""
        m, rng = self.model, self.rng
        # Rows of weights are fetched once a step; all else works on the few that it holds.
        near, (before_at, further_at) = self._seated(first, second)
        context = m.context.take(near, axis=0)
        before, further = context.take(before_at, axis=0), context.take(further_at, axis=0)
        hidden = m.joined(before, further)
        own = self.owner.take(token)
        # The class against classes drawn for the whole batch; one drawn often counts as often.
        drawn = np.bincount(np.searchsorted(self.share_cut, rng.random(NOISE)), minlength=len(m.group))
        noise = np.flatnonzero(drawn)
        often = drawn.take(noise).astype(np.float32)[:, None]
        true, false = m.group.take(own, axis=0), m.group.take(noise, axis=0)
        rise = _slope(self.log_noise.take(own) - np.einsum("ij,ij->i", hidden, true)) - 1
        against = -false
        against[:, WIDTH] += self.log_noise.take(noise)
        fall = _slope(hidden @ against.T)
        true *= rise[:, None]
        back = fall @ (often * false)
        back += true
        # A last column of zeros makes their number even, as sums want it.
        even = np.zeros((len(hidden), WIDTH + 2), np.float32)
        even[:, : WIDTH + 1] = hidden
        groups = self._sums(len(m.group), own, rise[:, None] * even)[:, : WIDTH + 1]
        groups[noise] += often * (fall.T @ hidden)
        # The word against words of its class.
        if many:
            inside = hidden[:many]
            word = np.empty((1 + WITHIN, many), np.int64)
            word[0] = token[:many]
            word[1:] = self._drawn(self.first_of.take(own[:many]), self.size_of.take(own[:many])).T
            rows, (place,) = self._seated(word.ravel())
            kept = m.target.take(rows, axis=0)
            target = kept.take(place, axis=0).reshape(*word.shape, WIDTH + 1)
            slope = _slope(self.log_within.take(word) - np.einsum("bd,kbd->kb", inside, target))
            slope[0] -= 1
            back[:many] += np.einsum("kb,kbd->bd", slope, target)
            total = self._sums(len(rows), place, (slope[:, :, None] * even[:many]).reshape(-1, WIDTH + 2))
            self._move(m.target, self.past[2], rows, kept, np.ascontiguousarray(total[:, : WIDTH + 1]))
        # What goes back to the contexts is summed by word before it passes the matrices.
        back = np.ascontiguousarray(back[:, :WIDTH])
        slopes = [self._sums(len(near), at, back) for at in (before_at, further_at)]
        turns = np.stack([context.T @ x for x in slopes])
        slopes = slopes[0] @ m.position[0].T + slopes[1] @ m.position[1].T
        self._move(m.context, self.past[0], near, context, slopes)
        # Classes that were not used have slopes of zero and stay.
        self._move(m.group, self.past[3], slice(None), m.group, groups)
        self._move(m.position, self.past[1], slice(None), m.position, turns, RATE / 10)
        self.steps += 1

    def _seated(self, *places: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The distinct places, which count as used, and where among them each one stands."""
        ordered = np.sort(_short(np.concatenate(places), len(self.seat)), kind="stable")
        starts = run_starts(ordered)
        rows = ordered.take(starts).astype(np.int64)
        self.used[rows] += np.diff(starts, append=len(ordered))
        self.seat[rows] = np.arange(len(rows))
        return rows, [self.seat.take(x) for x in places]

    def _sums(self, size: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Sums of the rows of values that go to each of ``size`` rows.

        Numpy adds by index quickly to flat arrays only, and two numbers at a time as parts of complex ones.
        """
        pairs = values.shape[1] // 2
        if len(self.cells[pairs]) < size:
            self.cells[pairs] = np.arange(size * pairs).reshape(-1, pairs)
        total = np.zeros((size, pairs), np.complex64)
        np.add.at(total.reshape(-1), self.cells[pairs].take(at, axis=0).ravel(), values.view(np.complex64).ravel())
        return total.view(np.float32)

    def _drawn(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """WITHIN places of each class, which begins at ``start``, by their counts."""
        mark = self.rng.random((len(start), WITHIN))
        mark *= size[:, None]
        place = mark.astype(np.int64)
        mark -= place
        place += start[:, None]
        return np.where(mark < self.keeps.take(place), place, self.instead.take(place))

    @staticmethod
    def _move(
        weights: np.ndarray, past: np.ndarray, rows: np.ndarray | slice, held: np.ndarray, slope: np.ndarray, rate: float = RATE
    ) -> None:
        """Move rows of weights, ``held`` so far, against their slopes."""
        size = slope * slope
        size += past if isinstance(rows, slice) else past.take(rows, axis=0)
        _put(past, rows, size)
        np.sqrt(size, out=size)
        np.divide(slope, size, out=size)
        size *= np.float32(rate)
        _put(weights, rows, np.subtract(held, size, out=size))

    def changes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of weights that were used, how often, and their changes (see ``_flat``)."""
        used = np.append(self.used, np.full(len(self.model.group) + 2 * WIDTH, self.steps))
        rows = np.flatnonzero(used)
        return rows, used[rows], (_flat(self.model) - _flat(self.start))[rows]


def _slope(against: np.ndarray) -> np.ndarray:
    """The logistic function of minus ``against``, in its place; where the exponential overflows it is zero."""
    np.exp(against, out=against)
    against += 1
    return np.reciprocal(against, out=against)


def _put(weights: np.ndarray, rows: np.ndarray | slice, values: np.ndarray) -> None:
    """Replace rows of weights; a row is put as one cell, which numpy does faster than number by number."""
    if isinstance(rows, slice):
        weights[rows] = values
    else:
        cell = np.dtype((np.void, values.shape[1] * values.itemsize))
        weights.view(cell).reshape(-1)[rows] = values.view(cell).reshape(-1)


def _short(at: np.ndarray, below: int) -> np.ndarray:
    """Numbers from 0 to ``below``; short numbers are sorted by their digits."""
    return at.astype(np.uint16) if below <= 1 << 16 else at


def _order(at: np.ndarray, below: int) -> np.ndarray:
    """A stable order of numbers from 0 to ``below``."""
    return np.argsort(_short(at, below), kind="stable")


def _flat(m: Model) -> np.ndarray:
    """All weights as rows: of each place (context, target), each class, each line of the position matrices."""
    out = np.zeros((len(m.context) + len(m.group) + 2 * WIDTH, 2 * WIDTH + 1), np.float32)
    out[: len(m.context), :WIDTH], out[: len(m.context), WIDTH:] = m.context, m.target
    out[len(m.context) : -2 * WIDTH, WIDTH:] = m.group
    out[-2 * WIDTH :, :WIDTH] = m.position.reshape(-1, WIDTH)
    return out


def _unflat(rows: np.ndarray, bounds: np.ndarray) -> Model:
    places = bounds[-1]
    position = rows[-2 * WIDTH :, :WIDTH].reshape(2, WIDTH, WIDTH)
    return Model(rows[:places, :WIDTH], position, rows[:places, WIDTH:], rows[places : -2 * WIDTH, WIDTH:], bounds)


def train(texts: DataFrame, known: Counts, rounds: int = ROUNDS) -> Model:
    """Each round: tasks learn from all their tokens; rows of weights move by the means of their changes."""
    model = unigram_model(known)
    names = [f"w{i}" for i in range(2 * WIDTH + 1)]
    kinds = "place long, n long, " + ", ".join(f"{w} float" for w in names)
    means = [(F.sum(F.col("n") * F.col(w).cast("double")) / F.sum("n")).cast("float").alias(w) for w in names]
    for _ in range(rounds if known.tokens else 0):
        held = texts.sparkSession.sparkContext.broadcast((known, model))

        def learn(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            known, model = held.value
            reader, learner = Reader(known.words[:VOCAB]), Learner(model, known)
            for batch in batches:
                column = batch.column("text")
                sizes = np.diff(utf8(column)[1])
                for a, b in row_slices(sizes):
                    token, starts, _ = reader.read(column.slice(a, b - a))
                    learner.learn(*reader.contexts(token, starts), token)
            rows, used, change = learner.changes()
            for a in range(0, len(rows), 1 << 14):
                piece = slice(a, a + (1 << 14))
                columns = [rows[piece], used[piece], *np.ascontiguousarray(change[piece].T)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["place", "n", *names])

        moved = texts.mapInArrow(learn, kinds).groupBy("place").agg(*means).toArrow()
        rows = _flat(model)
        rows[moved["place"].to_numpy()] += np.stack([moved[w].to_numpy() for w in names], axis=1)
        model = _unflat(rows, model.bounds)
    return model


def scores(docs: DataFrame, in_training: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row, log10.

    ``in_training`` is a column that says which rows the counts and the model learn from.
    """
    texts = docs.filter(in_training).select(F.col(text).alias("text"))
    counts = stored(count_words(texts), "counts")
    known = gather(texts, counts)
    model = train(texts, known)
    held = docs.sparkSession.sparkContext.broadcast((known, model))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = held.value
        reader, tables, owner = Reader(known.words), _tables(known), model.owner
        for batch in batches:
            column = batch.column("text")
            for a, b in row_slices(np.diff(utf8(column)[1]), SCORED_BYTES):
                piece = batch.slice(a, b - a)
                yield _scored(piece.column("key"), piece.column("text"), reader, model, owner, tables)
                give_back()

    near = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = near.schema["key"].dataType.simpleString()
    part = near.mapInArrow(score, f"key {kind}, n_tokens long, n_known long, base double, lm double, far array<struct<word: binary, times: long>>")
    part = stored(part.withColumn("row", F.monotonically_increasing_id()), "scored")
    # Words outside the head meet their counts; a text names each of its words once, with its frequency.
    met = part.select("row", F.inline("far")).join(counts, "word", "left").select(
        "row", "times", F.coalesce("n", F.lit(0)).alias("n"),
        (F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(known.slots))).alias("base"),
    )
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("more"), F.sum("base").alias("rest"))
    return part.drop("far").join(sums, "row", "left").select(
        F.col("key").alias("doc_id"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        (F.col("lm") + F.coalesce("rest", F.lit(0.0))).alias("score"),
    )


def _tables(known: Counts) -> tuple[np.ndarray, np.ndarray, float]:
    """By place in the head: log10 of the smoothed share, whether seen; and the log10 weight of the tail."""
    count = np.concatenate([[known.ends, 0], known.count])
    base = np.log10((count + 1) / known.slots)
    base[TAIL] = 0
    own = np.delete(known.by_place, TAIL)
    rest = known.slots - (own[own > 0] + 1).sum()
    return base, count > 0, float(np.log10(known.slots / max(rest, 1)))


def _scored(
    keys: pa.Array, column: pa.Array, reader: Reader, model: Model, owner: np.ndarray, tables: tuple
) -> pa.RecordBatch:
    base, seen, tail = tables
    token, starts, words = reader.read(column)
    # A tail token: its place, then its share of the tail; far words get that share's count by the join.
    kind = np.where(token < len(owner), token, TAIL)
    lm = model.log_probs(*reader.contexts(kind, starts), kind, owner) / np.log(10)
    lm += np.where(kind == TAIL, base[token] + tail, 0.0)
    size = np.diff(np.append(starts, len(token)))
    far = np.flatnonzero(token == TAIL)
    text = np.repeat(np.arange(len(size)), size)[far]
    # Words have no ends between them, of which one stands after each text.
    missing = words.take(pa.array(far - text)).dictionary_encode()
    code, times = np.unique(text << 32 | missing.indices.to_numpy(), return_counts=True)
    named = missing.dictionary.take(pa.array(code & 0xFFFFFFFF)).cast(pa.binary())
    offsets = np.append(0, np.cumsum(np.bincount(code >> 32, minlength=len(size))))
    return pa.RecordBatch.from_arrays(
        [
            keys,
            pa.array(size),
            pa.array(np.add.reduceat(seen[token].astype(np.int64), starts)),
            pa.array(np.add.reduceat(base[token], starts)),
            pa.array(np.add.reduceat(lm, starts)),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([named, times], ["word", "times"])),
        ],
        ["key", "n_tokens", "n_known", "base", "lm", "far"],
    )
