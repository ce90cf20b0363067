import math
import random

import numpy as np
import pytest
from cases import documents, none
from pyspark.sql import functions as F

from screenloom.llm import ann_scan, chat_format, cover_tree, vectors
from screenloom.llm.common import roots

ODD = [None, [], [0.0] * 6] + [[x, 1.0, 0.0, 0.0, 0.0, 0.0] for x in (math.nan, math.inf, None)]


def table(spark, x, odd=True):
    rows = [(i, v.tolist(), "a", 1) for i, v in enumerate(x)]
    rows += [(len(x) + i, v, "b", 2) for i, v in enumerate(ODD)] if odd else []
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, list string, rank int")


def clustered(seed, n=300, width=6):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((30, width))
    x = base[rng.integers(0, 30, n)] * rng.uniform(0.5, 2, (n, 1)) + 0.12 * rng.standard_normal((n, width))
    x[50:60] = x[49]
    return x


# Neighbours


def test_neighbours_find_the_nearest(spark):
    x = clustered(1)
    got = ann_scan.neighbours(table(spark, x), F.col("vec_id") % 10 == 0).collect()
    score = x @ x.T
    hits = total = 0
    for q in range(0, len(x), 10):
        rows = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21))
        own = [(-r.score, r.vec_id) for r in rows]
        assert own == sorted(own) and q not in {r.vec_id for r in rows}
        assert np.allclose([r.score for r in rows], score[q][[r.vec_id for r in rows]])
        want = np.lexsort((np.arange(len(x)), -np.where(np.arange(len(x)) == q, -np.inf, score[q])))[:20]
        hits += len({r.vec_id for r in rows} & set(want.tolist()))
        total += 20
    assert hits / total >= 0.9 and {r.query_id for r in got} == set(range(0, len(x), 10))


def test_neighbours_ties_repeats_and_few(spark):
    x = np.array([[1.0, 0]] * 5 + [[0.5, 0.5]])
    rows = table(spark, x, odd=False)
    got = ann_scan.neighbours(rows.union(rows), F.col("vec_id") == 2, k=20).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 3, 4, 5]
    assert ann_scan.neighbours(rows.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("n", [300, 900])
def test_neighbours_of_vectors_without_structure(spark, n):
    x = np.random.default_rng(n).standard_normal((n, 24)) * np.random.default_rng(n + 1).uniform(0.5, 2, (n, 1))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann_scan.neighbours(rows, F.col("vec_id") % 5 == 0).collect()
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    want = {(q, int(c)) for q in range(0, n, 5) for c in np.argsort(-score[q])[:20]}
    assert len(got) == len(want) and len({(r.query_id, r.vec_id) for r in got} & want) >= 0.9 * len(want)


def test_neighbours_with_one_id_are_rows_of_their_own(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 2.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0])]
    rows = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann_scan.neighbours(rows, F.col("vec_id") == 0).collect()
    want = [(0, 1, 1, 1.0), (0, 1, 1, 2.0), (0, 2, 0, 0.0), (0, 2, 0, 0.0)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want


def test_scan_abandons_but_keeps_the_best():
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((3000, 64)), rng.standard_normal((20, 64))
    row, at, score = ann_scan.adaptive_scan(q, np.full(20, -1), np.full(20, -np.inf), x, np.arange(3000), ann_scan.rotation(64), 10)
    want = np.argsort(-(q @ x.T), axis=1)[:, :10]
    assert sum(len(set(at[row == i]) & set(want[i])) for i in range(20)) >= 195
    assert np.allclose(score, (q[row] * x[at]).sum(1))


# Cover trees


def brute(x, usable, cosine=0.9):
    n = np.linalg.norm(x, axis=1)
    near = (x @ x.T / np.outer(n, n) >= cosine) & np.outer(usable, usable)
    np.fill_diagonal(near, False)
    return near


@pytest.mark.parametrize("chunk", [40, 2048])
def test_cover_tree_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(cover_tree, "CHUNK", chunk)
    x = clustered(3)
    rows = table(spark, x)
    got = {r.vec_id: r for r in cover_tree.near_duplicates(rows.union(rows)).collect()}
    near = brute(x, np.ones(len(x), bool))
    assert len(got) == len(x) + len(ODD)
    root = roots(*np.nonzero(near), len(x))
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id) == (near[i].sum(), root[i])
    for i in range(len(x), len(got)):
        assert (got[i].n_links, got[i].component_id) == (0, i)
    assert cover_tree.near_duplicates(rows.limit(0)).count() == 0


def test_tree_levels_nest():
    x = clustered(4, 200)
    tree = cover_tree.build(x, np.arange(200), np.ones(200, np.int64))
    u = cover_tree.unit(x)
    for above, level in zip(tree.levels, tree.levels[1:]):
        assert (above.node == level.parent[level.node]).all()
        assert set(above.center) <= set(level.center)
        apart = np.linalg.norm(u - u[level.center[level.node]], axis=1)
        assert (apart <= level.radius[level.node] + 1e-7).all()


def test_usable(spark):
    rows = table(spark, np.array([[1.0, 2.0]]))
    assert [r[0] for r in rows.orderBy("vec_id").select(vectors.usable("embedding")).collect()] == [True] + [False] * len(ODD)


# Chats


def test_snapshots_collapse(spark):
    rng = random.Random(5)
    rows, chats = [], {}
    for c in range(60):
        base = [("user" if i % 2 == 0 else "assistant", rng.choice(["a", "b", None, ""])) for i in range(rng.randint(1, 4))]
        chats[c] = base
        rows += [(c, 2 * i + 1, r, t, "x", 0) for i, (r, t) in enumerate(base)]
    rows += [(None, 1, "user", "only here", "x", 0), (90, None, None, "n", "x", 0), (90, 5, "user", "n", "x", 0)]
    schema = "conv_id long, turn long, role string, text string, part string, at int"
    table = spark.createDataFrame(rows + rows[:7], schema)
    got = {r.conv_id: r for r in chat_format.rendered(table).collect()}
    want = set()
    for c, s in chats.items():
        longer = any(len(o) > len(s) and o[: len(s)] == s for o in chats.values())
        if not longer and not any(o == s and d < c for d, o in chats.items()):
            want.add(c)
    assert set(got) == want | {None, 90}
    for c in want:
        text = "".join(f"<|im_start|>{r}\n{t or ''}<|im_end|>\n" for r, t in chats[c])
        assert (got[c].rendered, got[c].n_turns, got[c]["part"]) == (text, len(chats[c]), 0)
    assert got[90].rendered.startswith("<|im_start|>unknown\nn<|im_end|>")
    assert chat_format.rendered(table.limit(0)).count() == 0


def test_long_chats_go_in_spans_and_parts(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "SPAN", 4)
    monkeypatch.setattr(chat_format, "PART", 3)
    rows = [(1, t, "user", f"m{t}") for t in range(20)] + [(2, t, "user", f"m{t}") for t in range(11)]
    rows += [(3, t + 7, "user", f"m{t}") for t in range(20)]  # equal to the first, numbered otherwise
    got = chat_format.rendered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("part").collect()
    assert {r.conv_id for r in got} == {1} and [r["part"] for r in got] == list(range(7))
    assert "".join(r.rendered for r in got) == "".join(f"<|im_start|>user\nm{t}<|im_end|>\n" for t in range(20))


def test_tables_used_elsewhere(spark):
    assert documents(spark).count() > none(spark).count() == 0
