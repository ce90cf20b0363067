import hashlib
import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from cases import documents, none, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from screenloom.llm import bpe_tree, language_id, simhash

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe_tree.read_ranks(PATH)
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OURS = [bpe_tree.Encoder(RANKS, public_tokenizers.PATTERN)]


# Language identification


def test_language_separates_held_out_texts(spark):
    rng = random.Random(3)
    make = {"xx": "abcd efgh", "yy": "pqrs tuvw"}
    rows = [(k, "".join(rng.choice(make[k]) for _ in range(60)), k) for k in ("xx", "yy") for _ in range(40)]
    docs = spark.createDataFrame(rows, "truth string, text string, lang string")
    model = language_id.fit(docs.filter("rand(1) < 0.5"))
    out = docs.select("truth", language_id.predicted(docs, model).alias("g")).select("truth", "g.*").collect()
    assert all(r.lang_pred == r.truth and 0.5 < r.score <= 1 for r in out)


def test_language_scores_equal_brute_force():
    texts, langs = ["abab", "abc", "xyz xy"], ["a", "a", "x"]
    grams = lambda t: [
        x for i in range(len(t) + 2) for x in bytes_of(t, i)
    ]

    def bytes_of(t, i):
        padded = "\0\0" + t + "\0\0"
        return [padded[i : i + k] for k in language_id.ORDERS]

    index, starts = language_id.hashed_grams(texts, 1 << 14)
    for k, t in enumerate(texts):
        own = index[starts[k] : (list(starts) + [len(index)])[k + 1]]
        alone, _ = language_id.hashed_grams([t], 1 << 14)
        assert own.tolist() == alone.tolist() and len(own) == len(grams(t))
    counts = np.zeros((2, 1 << 14))
    for k, x in enumerate(langs):
        own, _ = language_id.hashed_grams([texts[k]], 1 << 14)
        np.add.at(counts[0 if x == "a" else 1], own, 1)
    prob = np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * (1 << 14)))
    model = language_id.Model(["a", "x"], np.log([2 / 3, 1 / 3]), prob.T.copy())
    lang, score = language_id.predict_texts(["abx", None, "", "12"], model)
    own, _ = language_id.hashed_grams(["abx"], 1 << 14)
    want = [math.log(2 / 3) + prob[0][own].sum(), math.log(1 / 3) + prob[1][own].sum()]
    assert lang == ["a" if want[0] >= want[1] else "x", "und", "und", "und"]
    assert score[0] == pytest.approx(1 / (1 + math.exp(min(want) - max(want)))) and not score[1:].any()


def test_language_odd_rows_and_empty_table(spark):
    docs = documents(spark)
    for taught in (docs, none(spark)):
        model = language_id.fit(taught)
        out = docs.select("*", language_id.predicted(docs, model).alias("g")).collect()
        assert len(out) == docs.count()
        for r in out:
            letters = any(c.isalpha() for c in r.text or "")
            assert (r.g.lang_pred == "und") == (not letters or not model.languages)
            assert 0 <= r.g.score <= 1 and r.lang_pred == "z"
    assert none(spark).select(language_id.predicted(docs, model)).count() == 0


def test_matrix_stays_bounded():
    assert language_id.buckets_for(4) == language_id.BUCKETS
    assert language_id.buckets_for(10_000) * 10_000 * 8 <= language_id.MATRIX_BYTES


def test_long_text_and_many_languages_in_little_memory():
    """A text of 20 million characters, and 200 languages, take blocks of a fixed size; sums stay those of one pass."""
    rng = np.random.default_rng(1)
    many = language_id.Model([f"l{i:03d}" for i in range(200)], np.zeros(200), rng.normal(size=(language_id.BUCKETS, 200)))
    texts = ["".join(rng.choice(list("abc d"), 3000)) for _ in range(60)]
    long = "ab cΣ İx" * 2_500_000
    tracemalloc.start()
    language_id.predict_texts(texts, many)
    few = language_id.Model(["a", "b"], np.zeros(2), many.log_prob[:, :2].copy())
    lang, _ = language_id.predict_texts([long], few)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400e6 and lang[0] in "ab"


def test_blocks_do_not_change_sums(monkeypatch):
    rng = random.Random(2)
    texts = [words(rng, n) for n in (1, 3, 50, 400)] + ["Σ", "aİb" * 30]
    prob = np.random.default_rng(3).normal(size=(language_id.BUCKETS, 3)) / 100
    model = language_id.Model(["x", "y", "z"], np.zeros(3), prob)
    want = language_id.predict_texts(texts, model)
    monkeypatch.setattr(language_id, "BLOCK", 37)
    monkeypatch.setattr(language_id, "GATHER_BYTES", 3 * 8 * 11)
    got = language_id.predict_texts(texts, model)
    assert got[0] == want[0] and np.allclose(got[1], want[1])


# Byte-level BPE


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abehrst 's\n\té漢🙂.0", max_size=80) | st.text(max_size=40))
def test_bpe_equals_library_and_round_trips(text):
    want = THEIRS.encode_ordinary(text)
    assert OURS[0].encode(text) == want
    assert bpe_tree.Decoder(RANKS).decode(np.array(want, np.int64)) == text.encode()


@pytest.mark.parametrize("unit", ["a", "er", " ", "=-", "\n", "the", "ab c"])
def test_bpe_long_runs(unit):
    text = unit * 3000
    assert OURS[0].encode(text) == THEIRS.encode_ordinary(text)


def test_bpe_batches_of_any_size(monkeypatch):
    """Texts cut at blocks, flushed early, with a memo that keeps losing its older half."""
    rng = random.Random(8)
    texts = [words(rng, rng.randint(0, 60)) for _ in range(40)] + ["", None, words(rng, 400)]
    want = [THEIRS.encode_ordinary(t or "") for t in texts]
    for name, value in (("BLOCK", 64), ("MATCHES", 50), ("MEMO", 8)):
        monkeypatch.setattr(bpe_tree, name, value)
        ids, counts = bpe_tree.Encoder(RANKS, public_tokenizers.PATTERN).batch(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_bpe_heap_equals_loop():
    rng = random.Random(5)
    for _ in range(50):
        body = words(rng, 12).encode()[:47]
        assert OURS[0].merged(body) == OURS[0]._merged_by_heap(body)


def test_bpe_columns(spark):
    docs = documents(spark).select("*", bpe_tree.encoded(documents(spark), PATH, public_tokenizers.PATTERN).alias("t"))
    out = docs.select("*", bpe_tree.decoded(docs, PATH, "t").alias("d")).collect()
    for r in out:
        assert r.t == THEIRS.encode_ordinary(r.text or "") and bytes(r.d) == (r.text or "").encode()
    empty = none(spark)
    assert empty.select(bpe_tree.encoded(empty, PATH, public_tokenizers.PATTERN)).count() == 0


def test_bpe_round_trip_in_one_worker(spark):
    """Same ids as the encoder's column, whatever the slices; odd rows and empty tables included."""
    docs = documents(spark)
    both = bpe_tree.round_trip(docs, PATH, public_tokenizers.PATTERN)
    out = docs.select("text", bpe_tree.encoded(docs, PATH, public_tokenizers.PATTERN).alias("t"), both.alias("made")).collect()
    assert out and all(r.made.exact and r.made.ids == r.t == THEIRS.encode_ordinary(r.text or "") for r in out)
    assert none(spark).select(bpe_tree.round_trip(none(spark), PATH, public_tokenizers.PATTERN)).count() == 0


def test_bpe_unknown_id():
    with pytest.raises(ValueError):
        bpe_tree.Decoder(RANKS).decode(np.array([60_000]))


def test_bpe_decoding_tree():
    ids = np.array(THEIRS.encode_ordinary("tree of halves " * 30_000))
    assert hashlib.sha256(bpe_tree.Decoder(RANKS).decode(ids)).digest() == hashlib.sha256(b"tree of halves " * 30_000).digest()


# SimHash


def brute_print(text):
    parts = (text or "").encode().lower().split()
    grams = [b" ".join(parts[i : i + 3]) for i in range(max(1, len(parts) - 2))] if parts else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash_equals_brute_force(spark):
    docs = documents(spark)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    rows = sorted({(r.doc_id, r.text) for r in docs.collect()}, key=lambda r: r[0])
    prints = [brute_print(t) for _, t in rows]
    assert [got[i].fp % (1 << 64) for i, _ in rows] == prints
    assert [got[i].component_id for i, _ in rows] == [rows[k][0] for k in brute_components(prints)]
    assert simhash.near_duplicates(docs).count() == docs.count()
    assert simhash.near_duplicates(none(spark)).count() == 0


@pytest.mark.parametrize("chunk", [8, 4096])
def test_simhash_links_of_clustered_prints(spark, monkeypatch, chunk):
    """Chains of flipped bits, many in one bucket, also cut into chunks."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(7)
    prints = set()
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(40):
            for _ in range(rng.choice([1, 2, 3, 4, 5])):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    root = {r.node: r.root for r in simhash.linked(nodes).collect()}
    want = brute_components(prints)
    groups = Counter(want)
    for i, x in enumerate(signed):
        assert (x in root) == (groups[want[i]] > 1)
    by_root = {}
    for i, x in enumerate(signed):
        if x in root:
            assert by_root.setdefault(root[x], want[i]) == want[i]
    assert len(by_root) == sum(n > 1 for n in groups.values())


def test_thresholds_satisfy_the_pigeonhole():
    for scale in (1, 1e3, 1e7):
        plan = simhash.allocate(np.full((8, 256), scale))
        assert sum(t + 1 for *_, t in plan) == simhash.DISTANCE + 1
        assert all(a < b <= c for (_, _, _), (a, b, _), (c, _, _) in zip([(0, 0, 0), *plan], plan, [*plan[1:], (8, 8, 0)]))


def test_print_is_a_column(spark):
    docs = documents(spark)
    assert docs.select("*", simhash.fingerprint("text").alias("f")).select(F.count("f")).first()[0] == docs.count()
