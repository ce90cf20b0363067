"""Edit fingerprints, filter audit and Ns-bounds clustering against brute force."""

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest
from cases import documents, none, words
from pyspark.sql import functions as F

from screenloom.llm import edit_prints, filter_audit, ns_clusters

# Edit fingerprints


def walked(text):
    """Symbols at all places, one step after the other."""
    out = {}
    for block in range(0, len(text), edit_prints.BLOCK):
        part, i = text[block : block + edit_prints.BLOCK], 0
        for j in range(edit_prints.STEPS):
            if i == len(part):
                break
            c = ord(part[i]) % 255 + 1
            out[block // edit_prints.BLOCK * edit_prints.STEPS + j] = edit_prints._SYMBOL[j & 255, c]
            i += int(edit_prints._MOVES[j, c])
    return out


@pytest.mark.parametrize("block", [8, 4096])
def test_walks_equal_single_steps(monkeypatch, block):
    monkeypatch.setattr(edit_prints, "BLOCK", block)
    monkeypatch.setattr(edit_prints, "STEPS", 3 * block)
    rng = random.Random(4)
    texts = ["", "a", "é漢🙂", words(rng, 30), words(rng, 300), "x" * 5000, words(rng, 2)]
    got = edit_prints.embedded(texts)
    place, _ = edit_prints.places(40)
    for text, row in zip(texts, got, strict=True):
        want = walked(text)
        assert [want.get(p, edit_prints.PAD) for p in place[: len(row)].tolist()] == row.tolist()


def test_fingerprints_of_edited_texts_equal_brute_force(spark, monkeypatch):
    """Also over many ranges, with ids that repeat, are null or lie at a cut."""
    monkeypatch.setattr(edit_prints, "RANGE_CHARS", 2000)
    monkeypatch.setattr(edit_prints, "OVERSAMPLE", 1)
    docs = documents(spark)
    extra = spark.createDataFrame([(None, "no id at all", "en", "s", 1, "", "", "")], docs.schema)
    rows = docs.unionByName(extra)
    got = edit_prints.with_edits(rows).collect()
    key = rows.select("doc_id", "text", *edit_prints._place("doc_id", "text")).orderBy("id", "h").collect()
    texts = [r.text or "" for r in key]
    following = texts[1:] + texts[:1]
    edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following, strict=True)]
    prints = [edit_prints.as_text(edit_prints.embedded([t]))[0] for t in texts]
    want = sorted(
        (r.doc_id is None, r.doc_id or 0, len(t), hashlib.sha256(e.encode()).hexdigest(), p)
        for r, t, e, p in zip(key, texts, edited, prints, strict=True)
    )
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars, r.edited_sha256, r.fingerprint) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    # A text and its edited text share a band only where sampled bits agree, so equal ones share all.
    assert all(r.bands_edited == r.bands_next == 16 for r in got if r.n_chars > 100 and r.fingerprint == r.edited_fingerprint and r.near_next == 1)
    assert edit_prints.with_edits(none(spark)).count() == 0
    one = edit_prints.with_edits(docs.limit(1)).first()
    assert one.near_next == 1


def test_likeness_falls_with_edits_and_is_low_for_others():
    rng = random.Random(7)
    texts = [words(rng, 400) for _ in range(60)]
    base = edit_prints.embedded(texts)
    assert (edit_prints.likeness(base, base) == 1).all()
    few = ["".join(c for i, c in enumerate(t) if i not in {100, 700}) for t in texts]
    half = edit_prints.edited_texts(texts, texts[1:] + texts[:1])
    near = np.median(edit_prints.likeness(base, edit_prints.embedded(few)))
    mixed = np.median(edit_prints.likeness(base, edit_prints.embedded(half)))
    apart = np.median(edit_prints.likeness(base[:-1], base[1:]))
    assert near > 0.85 > 0.65 > mixed > 0.35 > 0.2 > apart
    strings = edit_prints.as_text(base)
    read = edit_prints.symbols_of(strings)
    width = min(read.shape[1], base.shape[1])
    assert np.array_equal(read[:, :width], base[:, :width]) and (base[:, width:] == edit_prints.PAD).all()


@pytest.mark.parametrize("chunk", [4, 1024])
def test_near_groups_hold_planted_copies(spark, monkeypatch, chunk):
    """Bands find what a comparison of all pairs finds, also where buckets are cut into chunks."""
    monkeypatch.setattr(edit_prints, "CHUNK", chunk)
    rng = random.Random(9)
    texts = []
    for _ in range(6):
        t = words(rng, 300)
        texts += [t, t, t[:-3], t + " end", t[:500] + "qq" + t[500:], t.replace("a", "a", 1)]
    texts += [words(rng, 50) for _ in range(8)] + ["", "", "ab", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    prints = edit_prints.with_edits(docs).select("doc_id", "fingerprint").cache()
    got = {r.doc_id: r.component_id for r in edit_prints.near_groups(prints).collect()}
    held = {r.doc_id: r.fingerprint for r in prints.collect()}
    symbols = edit_prints.symbols_of([held[i] for i in range(len(texts))])
    a, b = np.triu_indices(len(texts), 1)
    hit = edit_prints.likeness(symbols[a], symbols[b]) >= edit_prints.NEAR
    root = edit_prints.roots(a[hit], b[hit], len(texts))
    assert [got[i] for i in range(len(texts))] == root.tolist()
    assert len({got[i] for i in range(36)}) < 15


# Filters


def brute_audit(docs, labels):
    told = {}
    for r in labels:
        if r.doc_id is not None:
            good, toxic = told.get(r.doc_id, (False, False))
            told[r.doc_id] = (good or r.quality == 1, toxic or r.toxic == 1)
    first = {}
    for r in docs:
        if r.doc_id is not None:
            t = r.text or ""
            first[t] = min(first.get(t, r.doc_id), r.doc_id)
    parts = {}
    for r in docs:
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": r.doc_id is not None and first[t] < r.doc_id,
        }
        parts.setdefault(r.source or "", []).append(({k for k in f if f[k]}, *told.get(r.doc_id, (False, False))))
    out = {}
    for part, rows in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                past = set(order[:k])
                here = [r for r in rows if x in r[0] and not past & r[0]]
                kept = sum(not (past | {x}) & r[0] for r in rows)
                shapley[x] += len(here)
                out[part, "".join(order), k + 1] = [
                    kept, len(here), sum(x in r[0] for r in rows) - len(here), sum(r[0] == {x} for r in rows),
                    sum(r[1] for r in here), sum(r[2] for r in here),
                ]
        for (p, order, k), row in out.items():
            if p == part:
                row.append(shapley[order[k - 1]])
    return out


def test_audit_equals_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        text = words(rng, rng.choice([3, 49, 50, 51, 80]))
        text = rng.choice([text, text.upper(), text + " #", (text + " ") * 3, None, "", "SAME text"])
        rows.append((rng.choice([i, i, i, 5, None]), text, rng.choice(["a", "b", None, ""]), "clash"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mask string")
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in [*range(0, 150, 2), 4, 4, None]]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(docs, labels).collect()
    want = brute_audit(docs.collect(), labels.collect())
    assert {tuple(r)[:3]: list(r)[3:] for r in got} == want and len(got) == len(want)
    assert filter_audit.filter_audit(docs.limit(0), labels).count() == 0
    assert filter_audit.filter_audit(docs, labels.limit(0)).agg(F.sum("toxic_lost")).first()[0] == 0


def test_audit_of_odd_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(3, 1, 1)], "doc_id long, quality int, toxic int")
    got = {tuple(r)[:3]: list(r)[3:] for r in filter_audit.filter_audit(docs, labels).collect()}
    assert got == brute_audit(docs.collect(), labels.collect())


# Centroids


def brute_clusters(rows, k, rounds, width):
    kept = []
    for i, x in rows:
        if x is not None and len(x) == width and all(c is not None and np.isfinite(c) for c in x):
            kept.append((i, [int(np.floor(256 * float(c))) for c in x]))
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    centroids = [x for _, x in start[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    nearest = lambda x: min((far(x, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        for j in range(len(centroids)):
            mine = [x for (_, x), o in zip(kept, own, strict=True) if o == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return [(i, nearest(x)[1], nearest(x)[0]) for i, x in kept], centroids


@pytest.mark.parametrize("scale", [1.0, 3e4])
def test_clusters_equal_brute_force(spark, scale):
    """Clustered and spread vectors, ties, copies, nulls; large components leave doubles."""
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(7, 4)) * 3
    x = [(middle[i % 7] + rng.normal(size=4) * 0.2) * scale for i in range(300)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(900 + i, rows[0][1]) for i in range(5)] + [(3, [0.0] * 4), (None, [0.5] * 4)]
    rows += [(800, None), (801, [1.0]), (802, [float("nan")] * 4), (803, [float("inf")] * 4), (804, [None] * 4), (805, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("x"))
    found, centroids, work = ns_clusters.clustered(frame, clusters=9, width=4)
    want, middle = brute_clusters(rows, 9, ns_clusters.ROUNDS, 4)
    plain = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(plain, map(tuple, found.collect()))) == sorted(map(plain, want))
    assert centroids.tolist() == middle
    # Bounds rule most pairs out after the first round.
    assert work[0] == len(want) * 9 and work[-1] < work[0] / 3
    told = ns_clusters.with_digests(found, centroids).collect()
    assert {r.inertia for r in told} == {sum(w[2] for w in want)}
    for r in told:
        assert r.cluster_inertia == sum(w[2] for w in want if w[1] == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, middle[r.cluster])).encode()).hexdigest()


def test_few_or_no_vectors(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    found, centroids, _ = ns_clusters.clustered(frame, width=2)
    assert len(centroids) == 2 and found.agg(F.sum("distance")).first()[0] == 0
    for rows in (frame.limit(0), frame.filter("vec_id > 5")):
        found, centroids, _ = ns_clusters.clustered(rows, width=2)
        assert ns_clusters.with_digests(found, centroids).count() == 0
