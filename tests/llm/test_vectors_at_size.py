"""What vector operators send through the driver and write to disk."""

import pickle

import numpy as np
from pyspark.sql import functions as F

from screenloom.llm import ann_scan, cover_tree, vectors


def test_blocks_of_queries_never_pass_the_driver(spark):
    x = np.random.default_rng(3).standard_normal((400, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = ann_scan.neighbours(rows, F.col("vec_id") % 2 == 0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert found.count() == 200 * 20
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_lean_vectors_lose_nothing():
    x = np.array([[0.5, -0.0], [1e-3, 1e300]])
    assert vectors.lean(x) is x and vectors.lean(x[:1]).dtype == np.float32
    single = np.float32([[0.1, 7]]).astype(float)
    assert (vectors.lean(single).astype(float) == single).all()


def test_no_tree_is_shuffled_for_a_pair(spark, monkeypatch):
    x = np.random.default_rng(4).standard_normal((500, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(cover_tree, "CHUNK", 20)
    seen = []
    kept = cover_tree.stored
    monkeypatch.setattr(cover_tree, "stored", lambda df, kind="table": (seen.append((kind, df)), kept(df, kind))[1])
    assert cover_tree.near_duplicates(rows).count() == 500
    met = next(df for kind, df in seen if kind == "met")
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_trees_and_forests_are_stored_short():
    x = np.random.default_rng(5).standard_normal((300, 8))
    x[100:] = x[:200] + 0.01 * x[100:]
    tree = cover_tree.build(x, np.arange(300) * 10, np.ones(300, np.int64))
    back = cover_tree.opened(pickle.dumps(cover_tree.slim(tree)))
    for a, b in zip(tree.levels, back.levels, strict=True):
        assert all((u == v).all() for u, v in zip(a, b, strict=True))
    heads, tails = cover_tree._forest([np.array([9, 7]), np.array([5, 8, 7])], [np.array([7, 5]), np.array([9, 8, 5])])
    assert sorted(zip(heads[0].tolist(), tails[0].tolist(), strict=True)) == [(7, 5), (9, 5)]


def test_zeros_of_both_signs_are_one_point(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, -0.0]), (3, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [1.0]), (None, [1.0, 0.0]), (5, None), (5, None)]
    got = cover_tree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 3, 1), (2, 3, 1), (3, 0, 3), (3, 3, 1), (4, 3, 1), (5, 0, 5)]
