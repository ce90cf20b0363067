import tracemalloc

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from screenloom.operators import attribution
from screenloom.operators.attribution import Leaf
from screenloom.plans import model_queries


def test_rows_of_one_file_are_explained_in_many_tasks(spark, monkeypatch):
    rows = spark.range(0, 450, 1, 1).select(F.col("id").alias("row_id"), array_to_vector(F.array(F.col("id") / 450, F.col("id") % 7 / 7)).alias("features"))
    leaves = [Leaf(1.0, (0,), (float("-inf"),), (0.5,), (0.4,)), Leaf(-1.0, (0, 1), (0.5, float("-inf")), (float("inf"), 0.3), (0.6, 0.5))]
    whole = attribution.attributions(rows, leaves)
    assert whole.rdd.getNumPartitions() == 1
    monkeypatch.setattr(attribution, "TASK_ROWS", 100)
    dealt = attribution.attributions(rows, leaves)
    assert dealt.rdd.getNumPartitions() == 5
    assert sorted(dealt.collect()) == sorted(whole.collect())


def test_tables_of_patterns_take_little_memory():
    rng = np.random.default_rng(5)
    used = np.argsort(rng.random((600, 12)), 1)[:, :10]
    low = rng.normal(-1, 0.5, used.shape)
    group = attribution.LeafGroup(rng.random(600), used, low, low + 1.5, rng.random(used.shape) * 0.8 + 0.1)
    x = rng.normal(size=(1500, 12))
    tracemalloc.start()
    phi = attribution.batch_attributions(x, [group])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isfinite(phi).all() and peak < 64e6


def test_rows_of_one_row_group_are_fitted_by_many_tasks(spark, tmp_path, monkeypatch):
    numbers = spark.range(400).select(F.col("id").alias("vec_id"), (F.col("id") % 10).cast("int").alias("label"), F.array(F.col("id").cast("float")).alias("embedding"))
    numbers.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(model_queries, "FIT_ROWS", 100)
    rows, _ = model_queries._split_rows(spark, str(tmp_path))
    assert rows.count() == 400 and rows.select(F.input_file_name()).distinct().count() == 4


def test_tasks_grow_with_the_table(spark, monkeypatch):
    rows = spark.range(0, 4000, 1, 1).select(F.col("id").alias("row_id"), array_to_vector(F.array(F.col("id") / 4000)).alias("features"))
    monkeypatch.setattr(attribution, "TASK_ROWS", 100)
    monkeypatch.setattr(attribution, "TASKS_A_CORE", 2)
    leaves = [Leaf(1.0, (0,), (float("-inf"),), (0.5,), (0.4,)), Leaf(-1.0, (0,), (0.5,), (float("inf"),), (0.6,))]
    dealt = attribution.attributions(rows, leaves)
    assert dealt.rdd.getNumPartitions() == 8 and dealt.count() == 4000
    monkeypatch.setattr(attribution, "MOST_ROWS", 200)
    assert attribution.attributions(rows, leaves).rdd.getNumPartitions() == 20


def test_tables_of_every_pattern_and_odd_values():
    rng = np.random.default_rng(6)
    for d in range(1, 9):
        cover = rng.uniform(0, 1, (5, d))
        cover[0, 0] = 1.0
        assert np.allclose(attribution.every_pattern(cover), attribution.pattern_values(attribution._bits(np.arange(2**d), d), cover), rtol=1e-12, atol=1e-15)
    inf = float("inf")
    low, high = np.array([[-inf, 0.0], [0.5, -inf], [0.5, 0.7]]), np.array([[0.5, inf], [inf, 0.0], [0.5, 0.2]])
    group = attribution.LeafGroup(np.ones(3), np.array([[0, 1]] * 3), low, high, np.full((3, 2), 0.5))
    x = np.array([[a, b] for a in (float("nan"), -inf, -0.0, 0.0, 0.5, 0.6, inf) for b in (float("nan"), -inf, 0.0, 1.0, inf)])
    inside = (x[None] > low[:, None]) & (x[None] <= high[:, None])
    values = sum(attribution.pattern_values(one.astype(float), np.full((1, 2), 0.5))[0].T for one in inside)
    assert np.allclose(attribution.batch_attributions(x, [group]), values)
