"""Shapley attributions of Spark ML tree ensembles, and what is read from them.

A tree is a sum over its leaves; a leaf's share depends only on the features on
its path.  For each leaf and path feature the path-dependent Shapley value is a
closed form over the other path features, evaluated per pattern of intervals and
looked up for whole Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from screenloom import constants as K
from screenloom.operators.boosting import BoostedModel
from screenloom.session import scratch_path

# Numbers that a table of patterns may hold at a time; some five arrays of this size are at work.
CELLS = 1 << 19


@dataclass(frozen=True)
class Leaf:
    value: float
    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    cover: tuple[float, ...]


def read_nodes(spark: SparkSession, model) -> pd.DataFrame:
    """Node table of a fitted tree ensemble, from its saved form.

    The driver holds the model itself, so it can hold its nodes; their number is set by the model's parameters.
    """
    if isinstance(model, BoostedModel):
        return model.node_table()
    path = scratch_path(spark, "ensemble")
    model.write().save(path)
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("tree_id", "meta", "weight")
    n = F.col("nodeData")
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree_id"),
        n["id"].alias("node_id"),
        n["leftChild"].alias("left_id"),
        n["rightChild"].alias("right_id"),
        n["prediction"].alias("prediction"),
        n["impurityStats"].alias("stats"),
        n["split"]["featureIndex"].alias("feature"),
        F.try_element_at(n["split"]["leftCategoriesOrThreshold"], F.lit(1)).alias("threshold"),
        n["split"]["numCategories"].alias("n_categories"),
    )
    return nodes.join(weights.drop("meta"), "tree_id").toPandas()


def leaf_paths(nodes: pd.DataFrame, classes: bool) -> list[Leaf]:
    """All leaves with, per path feature, the interval (low, high] and the cover ratio.

    ``classes``: the ensemble averages class shares (random forest); otherwise it
    sums weighted predictions (boosted trees).
    """
    leaves: list[Leaf] = []
    n_trees = nodes["tree_id"].nunique()
    for _, tree in nodes.groupby("tree_id"):
        by_id = {r.node_id: r for r in tree.itertuples()}

        def weight(r) -> float:
            return float(sum(r.stats)) if classes else float(r.stats[0])

        todo = [(by_id[0], {})]
        while todo:
            node, path = todo.pop()
            if node.left_id < 0:
                if classes:
                    value = float(node.stats[1]) / weight(node) / n_trees
                else:
                    value = float(node.prediction) * float(node.weight)
                items = sorted(path.items())
                leaves.append(
                    Leaf(
                        value,
                        tuple(f for f, _ in items),
                        tuple(b[0] for _, b in items),
                        tuple(b[1] for _, b in items),
                        tuple(b[2] for _, b in items),
                    )
                )
                continue
            if node.n_categories >= 0:
                raise ValueError("categorical splits are not supported")
            f, cut, total = int(node.feature), float(node.threshold), weight(node)
            low, high, cover = path.get(f, (-math.inf, math.inf, 1.0))
            left, right = by_id[node.left_id], by_id[node.right_id]
            todo.append((left, {**path, f: (low, min(high, cut), cover * weight(left) / total)}))
            todo.append((right, {**path, f: (max(low, cut), high, cover * weight(right) / total)}))
    return leaves


def base_value(leaves: list[Leaf]) -> float:
    """Expected output: every leaf weighted by its share of the training weight."""
    return sum(leaf.value * math.prod(leaf.cover) for leaf in leaves)


@dataclass(frozen=True)
class LeafGroup:
    """Leaves with equally many path features, as arrays (leaf, path feature)."""

    value: np.ndarray
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    cover: np.ndarray


def grouped(leaves: list[Leaf], used: list[int]) -> list[LeafGroup]:
    """Leaves by path length; features are numbered by their place in ``used``."""
    place = {f: i for i, f in enumerate(used)}
    by_length: dict[int, list[Leaf]] = {}
    for leaf in leaves:
        if leaf.features:  # a bare root explains nothing
            by_length.setdefault(len(leaf.features), []).append(leaf)
    return [
        LeafGroup(
            np.array([leaf.value for leaf in some]),
            np.array([[place[f] for f in leaf.features] for leaf in some]),
            np.array([leaf.low for leaf in some]),
            np.array([leaf.high for leaf in some]),
            np.array([leaf.cover for leaf in some]),
        )
        for some in by_length.values()
    ]


def pattern_values(inside: np.ndarray, cover: np.ndarray) -> np.ndarray:
    """Shapley values (leaf, path feature, pattern) of leaves of value 1.

    A row matters to a leaf only by which path intervals it lies in: ``inside`` (pattern, path feature) holds such
    patterns, ``cover`` (leaf, path feature) the ratios.  The value of feature i is its own difference times the
    mean, over t from 0 to 1, of the product of t * inside + (1 - t) * cover over the other features.  That is a
    polynomial in t of known degree, so a few fixed nodes give its mean exactly, and one product per node serves
    all features of the path.
    """
    d = cover.shape[1]
    node, weight = np.polynomial.legendre.leggauss(-(-d // 2))
    out = np.zeros((len(cover), d, len(inside)))
    o, z = inside.T[None], cover[:, :, None]
    for t, w in zip((node + 1) / 2, weight / 2, strict=True):
        factor = t * o + (1 - t) * z
        out += w * factor.prod(1, keepdims=True) / factor
    return (o - z) * out


def every_pattern(cover: np.ndarray) -> np.ndarray:
    """``pattern_values`` of all patterns, (leaf, path feature, 2**d); bit j of a pattern's number is feature j.

    The product over all features is built a feature at a time, once per node; a share is then a weighted sum of such
    products over the nodes, with weights that depend on the feature and its bit alone: one matrix product per leaf.
    """
    n, d = cover.shape
    node, weight = np.polynomial.legendre.leggauss(-(-d // 2))
    t, w = ((node + 1) / 2)[None, :, None], (weight / 2)[None, :, None]
    z = cover[:, None]
    out_, in_ = (1 - t) * z, t + (1 - t) * z
    product = np.ones((n, len(node), 1))
    for j in range(d):
        product = np.concatenate([product * out_[:, :, j, None], product * in_[:, :, j, None]], 2)
    shares = [np.matmul((w * gap / factor).transpose(0, 2, 1), product) for gap, factor in ((-z, out_), (1 - z, in_))]
    for j in range(d):
        one = shares[1][:, j].reshape(n, -1, 2, 1 << j)[:, :, 1]
        shares[0][:, j].reshape(n, -1, 2, 1 << j)[:, :, 1] = one
    return shares[0]


def batch_attributions(x: np.ndarray, groups: list[LeafGroup]) -> np.ndarray:
    """Shapley values of a batch, (rows, used features).

    A leaf has at most 2**d patterns: their values are computed once and looked up by row.  Values are read as their
    places between the ensemble's thresholds, so an interval is a range of small numbers.
    """
    places, ranges = _places(x, groups)
    out = np.zeros(x.T.shape)
    found, code = np.empty(len(x)), np.empty(len(x), np.int64)
    for group, (low, span) in zip(groups, ranges, strict=True):
        d = group.features.shape[1]
        every = 2**d <= len(x)
        step = max(1, CELLS // (d * 2**d)) if every else 1
        for first in range(0, len(group.value), step):
            chunk = range(first, min(first + step, len(group.value)))
            if every:
                tables = every_pattern(group.cover[chunk.start : chunk.stop])
            for leaf in chunk:
                short = np.zeros(len(x), np.uint16 if d <= 16 else np.int64)
                for j, f in enumerate(group.features[leaf]):
                    within = places[f] - low[leaf, j] <= span[leaf, j]
                    short |= within.astype(short.dtype) << short.dtype.type(j)
                np.copyto(code, short)
                if every:
                    table = tables[leaf - first]
                else:  # only the patterns that occur
                    seen, where = np.unique(code, return_inverse=True)
                    np.copyto(code, where)
                    table = pattern_values(_bits(seen, d), group.cover[leaf : leaf + 1])[0]
                table = table * group.value[leaf]
                for j, f in enumerate(group.features[leaf]):
                    out[f] += table[j].take(code, out=found, mode="clip")  # all codes are in range
    return out.T


def _places(x: np.ndarray, groups: list[LeafGroup]) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
    """Place of every value between the thresholds of its feature, and of each group's intervals the first place and
    how many more there are.  What lies in no interval (NaN, minus infinity) has a place after all."""
    features = np.concatenate([g.features.ravel() for g in groups]) if groups else np.zeros(0, np.int64)
    cut = np.concatenate([np.stack([g.low, g.high]).reshape(2, -1) for g in groups], 1) if groups else np.zeros((2, 0))
    order = np.argsort(features, kind="stable")
    bounds = np.searchsorted(features[order], np.arange(x.shape[1] + 1))
    first, last = np.zeros(len(features), np.int64), np.zeros(len(features), np.int64)
    places, most = [], 0
    for f, column in enumerate(x.T):
        own = order[bounds[f] : bounds[f + 1]]
        edges = np.unique(cut[:, own])
        edges = edges[np.isfinite(edges)]
        first[own] = np.where(cut[0, own] == -np.inf, 0, np.searchsorted(edges, cut[0, own]) + 1)
        last[own] = np.searchsorted(edges, cut[1, own])
        places.append(np.where(column > -np.inf, np.searchsorted(edges, column), len(edges) + 1))
        most = max(most, len(edges) + 1)
    # Unsigned: what lies below an interval wraps to a number beyond it; an empty one begins beyond all places.
    kind = np.min_scalar_type(most + 1)
    empty = last < first
    first, span = np.where(empty, most + 1, first).astype(kind), np.where(empty, 0, last - first).astype(kind)
    ends = np.cumsum([g.features.size for g in groups], dtype=np.int64)
    own = [(slice(e - g.features.size, e), g.features.shape) for g, e in zip(groups, ends, strict=True)]
    return [p.astype(kind) for p in places], [(first[at].reshape(shape), span[at].reshape(shape)) for at, shape in own]


def _bits(codes: np.ndarray, d: int) -> np.ndarray:
    return ((codes[:, None] >> np.arange(d)) & 1).astype(float)


ATTRIBUTION_SCHEMA = "row_id BIGINT, feature_index INT, value DOUBLE, shap DOUBLE"


#: Rows that a task explains, at least and at most.  Tables of patterns are made for each task, so few rows cost as
#: much as some thousands; more than that take memory.
TASK_ROWS, MOST_ROWS = 2_500, 16_384
#: Tasks for each core, where rows allow.
TASKS_A_CORE = 4


def attributions(
    df: DataFrame, leaves: list[Leaf], features: str = "features", id_col: str = K.ROW_ID
) -> DataFrame:
    """Long table of the non-zero attributions of every row.

    Only the features that the ensemble uses leave the JVM.  Rows are dealt anew, so that a task's work does not grow
    with the files they come from, and a task takes its rows at one go.
    """
    used = sorted({f for leaf in leaves for f in leaf.features}) or [0]
    shared = df.sparkSession.sparkContext.broadcast((np.array(used), grouped(leaves, used)))

    def explained(row_id: list[np.ndarray], x: list[np.ndarray]) -> pd.DataFrame:
        row_id, x = np.concatenate(row_id), np.concatenate(x)
        names, groups = shared.value
        phi = batch_attributions(x, groups)
        row, col = np.nonzero(phi)
        columns = {"row_id": row_id[row], "feature_index": names[col].astype(np.int32), "value": x[row, col], "shap": phi[row, col]}
        return pd.DataFrame(columns)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if batch.empty:
                continue
            if sum(len(r) for r, _ in held) + len(batch) > MOST_ROWS and held:
                yield explained(*zip(*held, strict=True))
                held = []
            held.append((batch["row_id"].to_numpy(), np.stack(batch["x"].to_numpy())))
        if held:
            yield explained(*zip(*held, strict=True))

    sliced = VectorSlicer(inputCol=features, outputCol="_used", indices=used).transform(df)
    rows = sliced.select(F.col(id_col).cast("bigint").alias("row_id"), vector_to_array("_used").alias("x"))
    n = df.count()
    each = max(TASK_ROWS, min(MOST_ROWS, -(-n // (TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism))))
    tasks = max(1, -(-n // each))
    return rows.repartition(tasks, "row_id").mapInPandas(explain, ATTRIBUTION_SCHEMA)


def name_features(attr: DataFrame, names: list[str]) -> DataFrame:
    """Add ``feature``; the names are a model parameter, as long as the vector is wide."""
    table = F.array(*[F.lit(n) for n in names])
    return attr.withColumn("feature", F.get(table, F.col("feature_index")))


def global_importance(attr: DataFrame, n_rows: int, top: int | None = None) -> DataFrame:
    """Mean absolute attribution over all ``n_rows`` explained rows; absent pairs count as 0."""
    table = attr.groupBy("feature_index").agg(
        (F.sum(F.abs("shap")) / n_rows).alias("mean_abs_shap")
    )
    ordered = table.orderBy(F.desc("mean_abs_shap"), "feature_index")
    return ordered if top is None else ordered.limit(top)


def local_top(attr: DataFrame, k: int = K.LOCAL_TOP) -> DataFrame:
    """The k strongest features of each row with their direction.

    The rank limit is applied before the shuffle as well, and a row has at most
    as many attributions as there are features.
    """
    order = Window.partitionBy("row_id").orderBy(F.desc(F.abs("shap")), "feature_index")
    return (
        attr.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .withColumn("direction", F.when(F.col("shap") > 0, "toxic").otherwise("non-toxic"))
    )
