"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting is one pass over the labelled texts (numpy bins per Arrow slice, summed by Spark); the
matrix of log-probabilities is small and fixed in size, so it is broadcast; scoring gathers its
rows for the n-grams that occur, a bounded number at a time, and sums them per text.

Null text: language ``und``, score 0.  A text without a letter: likewise.  A text of any length is
read whole.  Rows without a language teach nothing.  With no teachable row every text is ``und``.
Tied languages: the alphabetically first.  Repeated rows count as often as they occur.  The
prediction is a column, so other columns of the caller, whatever their names, stay untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenloom.llm.common import by_slices, row_slices

UNKNOWN = "und"
#: n-gram lengths, in characters.
ORDERS = (1, 2, 3)
BUCKETS = 1 << 14
ALPHA = 0.5
#: Bytes that the broadcast matrix may take; with very many languages the buckets get fewer.
MATRIX_BYTES = 64 << 20
#: Characters whose n-grams are hashed at once, and bytes of log-probabilities gathered at once.
BLOCK = 1 << 19
GATHER_BYTES = 1 << 24
#: Set before and after every text.
PAD = "\0" * (max(ORDERS) - 1)
RESULT = "struct<lang_pred:string,score:double>"


@dataclass(frozen=True)
class Model:
    """log_prob has a row per bucket and a column per language."""

    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray


def buckets_for(languages: int, most: int = BUCKETS) -> int:
    """Hash buckets such that the matrix stays within MATRIX_BYTES."""
    n = most
    while n > 256 and n * max(languages, 1) * 8 > MATRIX_BYTES:
        n //= 2
    return n


def _hashed(code: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of the n-grams that start at each code point but the last PAD ones: a column per order."""
    n = len(code) - len(PAD)
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    out = np.empty((n, len(ORDERS)), np.int32)
    with np.errstate(over="ignore"):
        h = code[:n] * np.uint32(0x9E3779B1)
        for k in range(1, max(ORDERS) + 1):
            if k > 1:
                h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + code[k - 1 : n + k - 1]
            if k in ORDERS:
                out[:, ORDERS.index(k)] = ((h + np.uint32(k)) * np.uint32(0xC2B2AE35)) >> shift
    return out


def hashed_grams(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of the texts, and where each text's n-grams begin.

    Texts are lower-cased and set apart by padding, so that n-grams see where a text begins and ends
    and none spans two texts.
    """
    lowered = [PAD + t.lower() for t in texts]
    size = np.array([len(t) for t in lowered])
    code = np.frombuffer(("".join(lowered) + PAD).encode("utf-32-le", "surrogatepass"), np.uint32)
    return _hashed(code, buckets).ravel(), np.concatenate([[0], np.cumsum(size)[:-1]]) * len(ORDERS)


def gram_blocks(texts: list[str], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """hashed_grams in blocks, each with the number of its first text; a text longer than a block is several blocks."""
    for a, b in row_slices(np.array([len(t) for t in texts]), BLOCK):
        if b > a + 1 or len(texts[a]) <= BLOCK:
            yield *hashed_grams(texts[a:b], buckets), a
            continue
        whole = PAD + texts[a].lower() + PAD
        for i in range(0, len(whole) - len(PAD), BLOCK):
            # Blocks overlap by what an n-gram reads ahead.
            piece = whole[i : i + BLOCK + len(PAD)].encode("utf-32-le", "surrogatepass")
            yield _hashed(np.frombuffer(piece, np.uint32), buckets).ravel(), np.zeros(1, np.int64), a


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS) -> Model:
    """Learn from every row of ``docs`` that has a language and a text.

    What reaches the driver is one count per language and bucket, bounded by MATRIX_BYTES.
    """
    taught = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).dropna()
    sizes = {r["lang"]: r["n"] for r in taught.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    buckets = buckets_for(len(languages), buckets)
    place = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * buckets, np.int64)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            langs = np.array([place[x] for x in batch.column("lang").to_pylist()])
            for index, starts, a in gram_blocks(texts, buckets):
                length = np.diff(np.append(starts, len(index)))
                cell = index + np.repeat(langs[a : a + len(starts)] * buckets, length)
                total += np.bincount(cell, minlength=len(total))
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], ["cell", "n"])

    counts = np.zeros((len(languages), buckets))
    if languages:
        summed = taught.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        counts.ravel()[summed["cell"].to_numpy()] = summed["n"].to_numpy()
    log_prob = np.log(counts + ALPHA) - np.log(counts.sum(1, keepdims=True) + ALPHA * buckets)
    prior = np.array([sizes[x] for x in languages], float)
    return Model(languages, np.log(prior / max(prior.sum(), 1)), np.ascontiguousarray(log_prob.T))


def predict_texts(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and its posterior probability for each text."""
    lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not model.languages:
        return lang, score
    rows = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    if not rows:
        return lang, score
    total = np.repeat(model.log_prior[None], len(rows), axis=0)
    step = max(1, GATHER_BYTES // (8 * len(model.languages)))
    for index, starts, a in gram_blocks([texts[i] for i in rows], len(model.log_prob)):
        for i in range(0, len(index), step):
            # The texts that have n-grams among these, from the one that begins before or at the first.
            low = np.searchsorted(starts, i, "right") - 1
            high = np.searchsorted(starts, min(i + step, len(index)))
            here = np.maximum(starts[low:high] - i, 0)
            total[a + low : a + high] += np.add.reduceat(model.log_prob[index[i : i + step]], here, axis=0)
    odds = np.exp(total - total.max(1, keepdims=True))
    score[rows] = 1 / odds.sum(1)
    for i, k in zip(rows, odds.argmax(1).tolist(), strict=True):
        lang[i] = model.languages[k]
    return lang, score


def predicted(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A struct column (lang_pred, score) for the texts of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def told(column: pa.Array) -> pa.Array:
        lang, score = predict_texts(column.to_pylist(), held.value)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], ["lang_pred", "score"])

    @F.arrow_udf(RESULT)
    def predict(column: pa.Array) -> pa.Array:
        return by_slices(column, told, pa.struct([("lang_pred", pa.string()), ("score", pa.float64())]))

    return predict(F.col(text))
