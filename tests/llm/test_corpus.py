import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import documents, none, words
from pyspark.sql import functions as F

import corpus_pipeline
from screenloom.llm import lbl_lm, pfair_mix, pii_boost, suffix_dedup

# Suffixes


def brute_removed(texts):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 200] for b in bodies for i in range(len(b) - 199))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def repeated_texts(seed):
    rng = random.Random(seed)
    passage = words(rng, 90)
    texts = [words(rng, 60) + passage + words(rng, 30) for _ in range(6)]
    texts += [passage[30:240] + words(rng, 20), passage[:199], passage[:200], passage[1:202], "ab" * 300, "x" * 450]
    texts += [words(rng, 70)] * 2 + [words(rng, 50) + "é漢" * 60, words(rng, 50) + "é漢" * 60, None, "", "short"]
    return texts


@pytest.mark.parametrize("split", [1, 8192])
def test_repeats_equal_brute_force(spark, monkeypatch, split):
    """Also with every gram cut at buckets, compared across their boundaries."""
    monkeypatch.setattr(suffix_dedup, "SPLIT", split)
    texts = repeated_texts(1)
    rows = [(i if i else None, t, "x", 3) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, kept int")
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.deduplicated(docs).collect()}
    for (i, *_), want in zip(rows, brute_removed(texts), strict=True):
        assert (*got[i][:4], bytes(got[i][4])) == want


def test_repeats_of_odd_rows(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    got = sorted(tuple(r)[:5] for r in suffix_dedup.deduplicated(docs).collect())
    want = sorted((r.doc_id, *w[:4]) for r, w in zip(rows, brute_removed([r.text for r in rows]), strict=True))
    assert got == want
    assert suffix_dedup.deduplicated(none(spark)).count() == 0


# Personal data


def brute_spans(t):
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for kind, p in kinds.items():
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True,
                "card": 14 <= len(digits) <= 19 and pii_boost.luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii_boost.KINDS.index(s[0])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    parts = ["a.b@c.de", "@", "x@y", "a@b@c.d", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "4539 1488 0343 6467", "+1 (415) 555-2671", "+", " ", ".", "-", "9", "00", "é", "漢", "(", "x@y.z@w.v", "0001.2.3.4", "\n"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert pii_boost.base_spans(t) == brute_spans(t), t
    long = "a" * 200_000 + "1" * 100_000 + " 1-" * 50_000 + "@" * 1000 + "+" * 1000
    assert [s[0] for s in pii_boost.base_spans(long)] == []


def test_trees_learn_and_add_spans(spark):
    rng = random.Random(3)
    texts = []
    for i in range(600):
        digits = "".join(rng.choice("0123456789") for _ in range(7))
        sign = "+" if i % 2 else ""
        phone = f"call {sign}1 (415) {digits[:3]}-{digits[3:]} now"
        texts.append(f"{words(rng, 10)} {phone} {words(rng, 10)} order {digits} of 12.5 units")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii_boost.fit(docs)
    found = docs.select("text", pii_boost.spans(docs, model).alias("s"), pii_boost.redacted(docs, model).alias("r")).collect()
    for r in found:
        base = [(x.kind, x.start, x.end) for x in r.s if x.base]
        assert base == brute_spans(r.text)
        assert all(r.text[a:b] not in r.r for _, a, b in base)
        taken = sorted((x.start, x.end) for x in r.s if not x.base)
        assert all(a[1] <= b[0] for a, b in zip(taken, taken[1:]))


def test_planted_loose_forms_are_found_and_clean_numbers_stay(spark):
    rng = random.Random(8)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    part = lambda: str(rng.randint(1, 254))

    def card():
        body = "4" + number(14)
        return next(body + c for c in "0123456789" if pii_boost.luhn(body + c))

    def text(*middle):
        return " ".join(f"{words(rng, 9)} {m}" for m in middle) + " " + words(rng, 9)

    def plain():
        groups = card()
        return text(
            f"mail {words(rng, 1)}.{number(2)}@{words(rng, 1)}.org", f"host {'.'.join(part() for _ in range(4))}",
            f"card {' '.join(groups[i : i + 4] for i in range(0, 16, 4))}", f"call +1 (415) {number(3)}-{number(4)}",
        )

    loose, clean = [], []
    for _ in range(40):
        digits = card()
        wanted = [
            f"j{number(2)} (at) {words(rng, 1)} (dot) org", "[.]".join(part() for _ in range(4)),
            ".".join(digits[i : i + 4] for i in range(0, 16, 4)), f"1 (415) {number(3)}-{number(4)}",
        ]
        cues = ("mail", "host", "card", "call")
        loose.append((text(*(f"{c} {w}" for c, w in zip(cues, wanted, strict=True))), wanted))
        clean.append(text(f"order {number(10)}", f"version 2021.{number(1)}.{number(2)}.3", f"dated 2019-04-{rng.randint(10, 28)}", f"boxes @ 12.{number(2)} each"))
    rows = [*(plain() for _ in range(600)), *(t for t, _ in loose), *clean]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    model = pii_boost.fit(docs)
    assert set(model) == set(pii_boost.KINDS) and all(np.isfinite(m.threshold) for m in model.values())
    for k in range(4):
        hit = [any(not base and t[a:b] == w[k] for _, a, b, base in pii_boost.all_spans(t, model)) for t, w in loose]
        assert np.mean(hit) >= 0.9, pii_boost.KINDS[k]
    assert sum(len(pii_boost.all_spans(t, model)) for t in clean) <= 3


def test_boosting_and_threshold():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 4))
    y = ((x[:, 1] > 0.2) & (x[:, 3] < 0.5)).astype(float)
    trees = pii_boost.boost(x[:2000], y[:2000])
    margin = trees.margin(x[2000:])
    assert ((margin > 0) == (y[2000:] > 0)).mean() > 0.95
    cut = pii_boost.calibrated_threshold(margin, y[2000:])
    assert y[2000:][margin >= cut].mean() >= pii_boost.PRECISION
    assert pii_boost.calibrated_threshold(np.zeros(100), np.zeros(100)) == np.inf


def test_spans_of_odd_rows(spark):
    docs = documents(spark)
    for taught in (docs, none(spark)):
        out = docs.select("*", pii_boost.spans(docs, pii_boost.fit(taught)).alias("s")).collect()
        assert all([(x.kind, x.start, x.end) for x in r.s if x.base] == brute_spans(r.text or "") for r in out)


# Mixing


def test_frame_keeps_every_share_within_a_block():
    weights = {"a": 0.5, "b": 0.3, "c": 0.17, "d": 0.03}
    slots = pfair_mix.frame_schedule(pfair_mix.quotas(weights, 1024), 1024)
    assert sorted(s for x in slots.values() for s in x) == list(range(1024))
    for x in slots.values():
        served = np.cumsum(np.bincount(x, minlength=1024))
        assert np.abs(served - len(x) / 1024 * np.arange(1, 1025)).max() < 1


def test_mixture_places_every_row(spark):
    rows = [(i, "big" if i % 3 else ("small" if i % 2 else None), "t") for i in range(3000)]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, source string, slot string")
    weights = {"big": 1.0, "small": 1.0}
    out = pfair_mix.placements(docs, weights, block_rows=10).collect()
    assert sorted(r.key for r in out) == list(range(3000))
    slots = {}
    for r in out:
        assert slots.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    assert sorted(slots) == list(range(len(slots)))
    # While both have blocks they alternate; then big alone; sources without a weight come last.
    assert [slots[i][0] for i in range(100)].count("small") == 50
    assert {slots[i][0] for i in range(len(slots) - 50, len(slots))} == {""}
    for name in ("big", "small", ""):
        own = [b for _, (s, b) in sorted(slots.items()) if s == name]
        assert own == list(range(len(own)))
    assert pfair_mix.mixed(docs, weights).count() == 3002
    assert pfair_mix.mixed(none(spark)).count() == 0


def test_phase_shares_stay_within_a_block():
    plan = pfair_mix.phases({"a": 900, "b": 300, "c": 37}, {"a": 1.0, "b": 1.0, "c": 0.5})
    assert sum(p.length for p in plan) == 1237
    for p in plan:
        for s, slots in p.slots.items():
            at = np.array([k * p.frame + x for k in range(-(-p.length // p.frame)) for x in slots])
            served = np.searchsorted(at, np.arange(1, p.length + 1), side="left")
            assert np.abs(served - len(slots) / p.frame * np.arange(1, p.length + 1)).max() < 1


def furthest(order, weights):
    """The greatest distance of a source from its share of the given weights, over all slots."""
    t = np.arange(1, len(order) + 1)
    total = sum(weights.values())
    return max(np.abs(np.cumsum(np.array(order) == s) - w / total * t).max() for s, w in weights.items())


def test_given_weights_are_kept_over_many_frames():
    many = {f"s{i:02d}": math.sqrt(n) for i, n in enumerate([100_000, *range(9_000, 18_500, 500)])}
    for weights in ({"a": 0.9, "b": 0.05, "c": 0.05}, many):
        slots = 20 * pfair_mix.FRAME
        total = sum(weights.values())
        plan = pfair_mix.phases({s: int(w / total * slots) for s, w in weights.items()}, weights)
        frame, length = plan[0].frame, plan[0].length
        repeats = range(-(-length // frame))
        order = [s for _, s in sorted((k * frame + x, s) for s, own in plan[0].slots.items() for x in own for k in repeats)][:length]
        assert length > 19 * pfair_mix.FRAME
        assert furthest(order, weights) < 1


def test_rows_keep_given_weights_across_frames(spark, monkeypatch):
    monkeypatch.setattr(pfair_mix, "FRAME", 16)
    weights = {"a": 0.9, "b": 0.05, "c": 0.05}
    rows = [(i, "a" if i % 20 < 18 else "bc"[i % 2]) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    out = pfair_mix.placements(docs, weights, block_rows=3).collect()
    assert sorted(r.key for r in out) == list(range(6000))
    slots = {r.slot: (r.source, r.block, r.phase) for r in out}
    assert sorted(slots) == list(range(len(slots)))
    order = [slots[i][0] for i in range(len(slots)) if slots[i][2] == 0]
    assert len(order) > 100 * pfair_mix.FRAME and furthest(order, weights) < 1


# Language model


def test_scores_equal_brute_counts_and_sum_to_one(spark, monkeypatch):
    docs = documents(spark)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    rows = docs.select("doc_id", "text").collect()
    tokens = [(r.text or "").encode().lower().split() + [None] for r in rows]
    count = Counter(x for r, t in zip(rows, tokens, strict=True) if zlib.crc32(str(r.doc_id).encode()) % 7 != 2 for x in t)
    total, slots = sum(count.values()), sum(count.values()) + len(count) + 1
    for head in (40, 200_000):
        monkeypatch.setattr(lbl_lm.gather, "__defaults__", (head,))
        got = sorted(lbl_lm.scores(docs, fold).collect(), key=lambda r: (r.doc_id, r.n_tokens))
        want = sorted((r.doc_id, len(t), sum(count[x] > 0 for x in t), sum(math.log10((count[x] + 1) / slots) for x in t)) for r, t in zip(rows, tokens, strict=True))
        assert [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(a, b, c, total) for a, b, c, _ in want]
        assert np.allclose([r.base_score for r in got], [w[3] for w in want])
        assert all(r.score < 0 for r in got)
    assert all(r.train_tokens == 0 and r.base_score == 0 for r in lbl_lm.scores(docs, F.lit(False)).collect())
    assert lbl_lm.scores(none(spark), fold).count() == 0


def known_words(n=400, tail=500):
    count = np.arange(2 * n, n, -1) ** 2
    return lbl_lm.Counts([b"w%d" % i for i in range(n)], count, 70, int(70 + count.sum() + tail), n + 61)


def test_words_and_tail_are_normalised(monkeypatch):
    monkeypatch.setattr(lbl_lm, "TOKENS", 1000)
    known, rng = known_words(), np.random.default_rng(3)
    learner, places = lbl_lm.Learner(lbl_lm.unigram_model(known), known), len(known.words) + 2
    learner.learn(*rng.integers(0, places, (3, 20_000)))
    model = learner.model
    assert len(model.group) == len(model.bounds) - 1 > 10 and (np.diff(model.bounds) > 0).all()
    assert np.array_equal(model.bounds[model.owner], np.repeat(model.bounds[:-1], np.diff(model.bounds)))
    for first, second in ((0, 0), (5, 300), (1, 399)):
        every = np.arange(places)
        assert np.exp(model.log_probs(np.full(places, first), np.full(places, second), every)).sum() == pytest.approx(1, abs=1e-5)
    # The far words' shares of the tail, with one slot for unknown words, add up to one as well.
    base, _, tail = lbl_lm._tables(known)
    far, rows = known.distinct - len(known.words) - 1, known.tokens - known.ends - known.count.sum()
    assert (rows + far + 1) / known.slots * 10**tail == pytest.approx(1)


def test_noise_words_are_drawn_by_their_counts_without_a_search():
    known = known_words()
    count, bounds = known.by_place + 1.0, lbl_lm.unigram_model(known).bounds
    keeps, instead = lbl_lm._lots(count, bounds)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    assert (owner[instead] == owner).all() and (keeps >= 0).all() and (keeps <= 1).all()
    # What a place keeps and what others leave to it make its share of its class.
    share = (keeps + np.bincount(instead, 1 - keeps, len(count))) / np.diff(bounds)[owner]
    assert np.allclose(share, count / np.add.reduceat(count, bounds[:-1])[owner])
    learner = lbl_lm.Learner(lbl_lm.unigram_model(known), known)
    c = int(np.diff(bounds).argmax())
    drawn = learner._drawn(np.full(50_000, bounds[c]), np.full(50_000, bounds[c + 1] - bounds[c])).ravel()
    seen = np.bincount(drawn, minlength=len(count))[bounds[c] : bounds[c + 1]] / len(drawn)
    assert seen.sum() == 1 and np.abs(seen - share[bounds[c] : bounds[c + 1]]).max() < 0.01


@pytest.mark.parametrize("size", [1, 15, 400])
def test_sums_of_exponentials_are_exact_for_small_and_large_products(size):
    rng = np.random.default_rng(1)
    hidden, target = (rng.normal(0, 1, (n, lbl_lm.WIDTH + 1)).astype(np.float32) for n in (500, 90))
    target *= np.float32(size)
    score = (hidden @ target.T).astype(np.float64)
    most = score.max(1)
    assert np.allclose(lbl_lm._log_sum(hidden, target), np.log(np.exp(score - most[:, None]).sum(1)) + most, rtol=1e-5, atol=1e-5)


def test_words_are_those_of_python_on_slices_of_odd_texts():
    odd = [None, "", " ", "A b", " Zz\tÄÉ x y\x0bq ", "\x00 \x1c\x1d a\x85b", "[@`{ [A]\r\n\x0c", "\n", "end  ", "ß" * 40 + " K"]
    odd.append("".join(map(chr, range(300))))
    for kind in (pa.string(), pa.large_string(), pa.binary(), pa.large_binary()):
        column = pa.array(odd, pa.string()).cast(kind)
        for a, n in ((0, len(odd)), (3, 5), (5, 0), (1, 2), (len(odd) - 1, 1)):
            words, size = lbl_lm.words_of(column.slice(a, n))
            want = [(t or "").encode().lower().split() for t in odd[a : a + n]]
            assert words.to_pylist() == [w for ws in want for w in ws] and size.tolist() == list(map(len, want))
    reader = lbl_lm.Reader([b"a", b"end", b"b"])
    token, starts, _ = reader.read(pa.array(["b zz A", None, "end"]))
    assert token.tolist() == [4, 1, 2, 0, 0, 3, 0] and starts.tolist() == [0, 4, 5]


def test_counts_do_not_depend_on_how_many_words_a_task_holds(spark, monkeypatch):
    texts = documents(spark).select("text")
    want = Counter(w for r in texts.collect() for w in (r.text or "").encode().lower().split())
    monkeypatch.setattr(lbl_lm, "HANDED", 7)
    for held in (1, 50, 1 << 22):
        monkeypatch.setattr(lbl_lm, "COUNTED", held)
        monkeypatch.setattr(lbl_lm.row_slices, "__defaults__", (64,))
        assert {bytes(r.word): r.n for r in lbl_lm.count_words(texts).collect()} == want


def test_a_step_fetches_each_row_of_weights_once():
    class Fetched(np.ndarray):
        rows = 0

        def take(self, at, **kwargs):
            Fetched.rows += np.size(at)
            return np.asarray(self).take(at, **kwargs)

    known, rng = known_words(), np.random.default_rng(5)
    learner = lbl_lm.Learner(lbl_lm.unigram_model(known), known)
    m = learner.model
    learner.model = lbl_lm.Model(m.context.view(Fetched), m.position, m.target.view(Fetched), m.group, m.bounds)
    learner.learn(*rng.integers(0, len(m.context), (3, lbl_lm.BATCH)))
    assert 0 < Fetched.rows <= 2 * len(m.context) and learner.steps == 1


def test_a_step_moves_rows_by_their_summed_slopes(monkeypatch):
    known, rng = known_words(), np.random.default_rng(7)
    learner = lbl_lm.Learner(lbl_lm.unigram_model(known), known)
    learner.learn(*rng.integers(0, len(known.words) + 2, (3, 5000)))
    m, past = learner.model, [np.array(x, np.float64) for x in learner.past]
    old = [np.array(x, np.float64) for x in (m.context, m.position, m.target, m.group)]
    first, second, token = rng.integers(0, len(m.context), (3, 700))
    token = np.concatenate([token[learner.size_of[learner.owner[token]] > 1], [0, 0, 1]])
    first, second, many, drawn = first[: len(token)], second[: len(token)], len(token) - 3, {}
    monkeypatch.setattr(learner, "_drawn", lambda *x, f=learner._drawn: drawn.setdefault("words", f(*x)))
    again = np.random.default_rng()
    again.bit_generator.state = learner.rng.bit_generator.state
    noise = np.searchsorted(learner.share_cut, again.random(lbl_lm.NOISE))
    used = learner.used.copy()
    learner.step(first, second, token, many)

    def slope(x):
        return 1 / (1 + np.exp(-x))

    context, position, target, group = old
    turn = [np.zeros_like(x) for x in old]
    for i, (f, s, t) in enumerate(zip(first, second, token, strict=True)):
        hidden, own = np.append(context[f] @ position[0] + context[s] @ position[1], 1), learner.owner[t]
        pairs = [(3, group, own, slope(hidden @ group[own] - learner.log_noise[own]) - 1)]
        pairs += [(3, group, c, slope(hidden @ group[c] - learner.log_noise[c])) for c in noise]
        if i < many:
            pairs += [(2, target, w, slope(hidden @ target[w] - learner.log_within[w]) - (k == 0)) for k, w in enumerate([t, *drawn["words"][i]])]
        back = sum(x * weights[row] for _, weights, row, x in pairs)[:-1]
        for which, _, row, x in pairs:
            turn[which][row] += x * hidden
        for k, w in enumerate((f, s)):
            turn[0][w] += position[k] @ back
            turn[1][k] += np.outer(context[w], back)
    rates = (lbl_lm.RATE, lbl_lm.RATE / 10, lbl_lm.RATE, lbl_lm.RATE)
    for new, was, before, t, rate in zip((m.context, m.position, m.target, m.group), old, past, turn, rates, strict=True):
        assert np.allclose(new, was - rate * t / np.sqrt(before + t * t), atol=2e-4)
    places = np.concatenate([first, second, token[:many], drawn["words"].ravel()])
    assert np.array_equal(learner.used - used, np.bincount(places, minlength=len(used)))


@pytest.mark.parametrize("repeated", [1, 1 << 20])
def test_scores_are_plain_softmaxes_of_class_and_word(monkeypatch, repeated):
    monkeypatch.setattr(lbl_lm, "REPEATED", repeated)
    monkeypatch.setattr(lbl_lm, "FETCHED", 100)
    known, rng = known_words(), np.random.default_rng(9)
    learner = lbl_lm.Learner(lbl_lm.unigram_model(known), known)
    learner.learn(*rng.integers(0, len(known.words) + 2, (3, 9000)))
    m, (first, second, token) = learner.model, rng.integers(0, len(known.words) + 2, (3, 1500))
    hidden = np.c_[m.context[first] @ m.position[0] + m.context[second] @ m.position[1], np.ones(len(token))]
    group, word = np.exp(hidden @ m.group.T), np.exp(hidden @ m.target.T)
    own, rows = m.owner[token], np.arange(len(token))
    inside = np.add.reduceat(word, m.bounds[:-1], axis=1)
    want = np.log(group[rows, own] / group.sum(1)) + np.log(word[rows, token] / inside[rows, own])
    assert np.allclose(m.log_probs(first, second, token), want, atol=1e-4)


def test_model_starts_as_unigram_and_weights_survive_flattening():
    known = known_words()
    model = lbl_lm.unigram_model(known)
    every = np.arange(len(known.words) + 2)
    share = (known.by_place + 1) / (known.by_place + 1).sum()
    assert np.allclose(model.log_probs(every, every[::-1], every), np.log(share), atol=1e-4)
    again = lbl_lm._unflat(lbl_lm._flat(model), model.bounds)
    assert all(np.array_equal(getattr(model, w), getattr(again, w)) for w in ("context", "position", "target", "group"))


def chained(spark, n, seed):
    """Each word is one of two that the word before allows: 300 words, far more than any fixed list of classes."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at, text = rng.randrange(300), []
        for _ in range(60):
            text.append(f"w{at}")
            at = (at * 7 + rng.choice([1, 2])) % 300
        rows.append((i, " ".join(text)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_held_out_scores_beat_counts(spark):
    docs = chained(spark, 1500, 5).repartition(4)
    out = lbl_lm.scores(docs, F.col("doc_id") % 7 != 2).filter(F.col("doc_id") % 7 == 2)
    base, score, tokens = out.agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert score > base + 0.5 * tokens


# Pipeline


def test_pipeline_stages(spark, tmp_path):
    docs = documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    letters = {r.doc_id: r.text for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in out} <= set(letters) and len(out) < docs.count() and all(r.exact for r in out)


def test_repeated_ids_lose_only_the_text_that_has_a_copy(spark):
    copied, alone, third = (words(random.Random(i), 80) for i in range(3))
    rows = [(1, copied), (2, copied), (2, alone), (3, third), (3, third), (None, third), (None, third)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    got = Counter((r.doc_id, r.text) for r in out.collect())
    assert got == {(1, copied): 1, (2, alone): 1, (3, third): 1, (None, third): 2}
