"""Boosted trees grown in lock step: all settings and folds share one binned table.

Features are binned to bytes once, and the table is kept as blocks of rows.  A level of all trees of all
models is one pass: every block adds up gradients by (model, node, feature, bin), sums meet by (model, node),
and what comes back is one split per node.  A fold is held out by leaving its rows out of the sums, so folds
need no tables of their own, and a model's margins on its held-out rows come with the fit.  Gradients are
rounded to multiples of 1 / QUANTUM; their sums are whole numbers, so the trees do not depend on how rows are
dealt to blocks, tasks or machines.

Where all rows make one block (BLOCK_BYTES), its sums are whole as they stand; then a task takes the block (a
broadcast of that bounded size) and grows some of the models to the end by the same functions.

Trees are second order: leaves -G / (H + PENALTY), a split needs hessian ``min_child_weight`` on both sides and a
gain over ``gamma``; ``subsample`` draws rows by a hash of their id, ``colsample`` columns, anew for each tree.
Ties go to the first feature and bin.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenloom import constants as K
from screenloom.session import stored

BINS = 32
PENALTY = 1.0
QUANTUM = 2.0**20
#: Bytes of binned features in a block.
BLOCK_BYTES = 32 << 20
#: Blocks, at least, of a table that is more than one: all cores take part.
LEAST_BLOCKS = 64
#: Sums of a level that tasks hand to the driver as they are; larger ones meet in a shuffle.
DIRECT_BYTES = 256 << 10
#: Rows, and values, of the sample that bin edges are taken from.
EDGE_ROWS, EDGE_CELLS = 20_000, 1 << 23
#: Trees after which margins are written to the blocks anew; until then every level works out theirs once more.
KEEP = 4
#: Flags that are turned into numbers at a time: they stay in the cache.
FLAG_CELLS = 1 << 18
#: Bytes of sums that a task holds before it hands them on.
COMBINE_BYTES = 128 << 20


@dataclass(frozen=True)
class Setting:
    """What one model is grown with; rows of the fold ``held`` are left out."""

    trees: int
    depth: int
    rate: float
    subsample: float
    colsample: float
    least_hessian: float
    gamma: float
    seed: int = K.SEED
    held: int | None = None

    @classmethod
    def of(cls, params: Mapping, held: int | None = None, seed: int = K.SEED) -> "Setting":
        p = {**K.BOOSTED, **params}
        return cls(
            int(p["n_estimators"]), int(p["max_depth"]), float(p["learning_rate"]), float(p["subsample"]),
            float(p["colsample"]), float(p["min_child_weight"]), float(p["gamma"]), seed, held,
        )


@dataclass
class Tree:
    """Nodes by heap number (root 1, children 2i and 2i + 1); feature -1 is a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    @classmethod
    def blank(cls, depth: int) -> "Tree":
        n = 2 << depth
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.uint8), np.zeros(n), np.zeros(n))


@dataclass
class Block:
    bins: np.ndarray
    key: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    fold: np.ndarray
    margin: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))


# The steps that both ways of growing are made of


def gradients(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-margin))
    return np.rint((p - label) * weight * QUANTUM), np.rint(p * (1 - p) * weight * QUANTUM)


def drawn_rows(key: np.ndarray, setting: Setting, tree: int) -> np.ndarray:
    """Whether each row is in the sample of a tree: by a mixed hash of its key."""
    if setting.subsample >= 1:
        return np.ones(len(key), bool)
    salt = int(np.random.default_rng([setting.seed, tree]).integers(1 << 63))
    z = key.astype(np.uint64) + np.uint64(salt)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (z ^ (z >> np.uint64(31))) >> np.uint64(11) < np.uint64(int(setting.subsample * 2**53))


def drawn_columns(width: int, setting: Setting, tree: int) -> np.ndarray:
    n = max(1, int(setting.colsample * width))
    return np.sort(np.random.default_rng([setting.seed, tree, 1]).choice(width, n, replace=False))


def offsets(sizes: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Where the bins of each drawn column begin, and where the last one's end."""
    return np.concatenate([[0], np.cumsum(sizes[columns])])


@dataclass
class Cells:
    """The drawn columns of some binned rows: those of two bins as rows of flags, the others each by itself."""

    flags: np.ndarray
    rows: np.ndarray
    picked: np.ndarray
    lines: np.ndarray
    two: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, bins: np.ndarray, use: np.ndarray, columns: np.ndarray, sizes: np.ndarray, turned: np.ndarray | None = None) -> "Cells":
        """``use``: the numbers of the rows.  ``turned``: the bins by column, if more trees need them."""
        two = sizes[columns] <= 2
        turned = bins.T if turned is None else turned
        lines = np.array([turned[c][use] for c in columns[~two]], np.uint8)
        picked = columns[two]
        if 2 * len(picked) >= bins.shape[1]:
            # Whole rows are read faster than most of their columns.
            return cls(bins, use, picked, lines, two, offsets(sizes, columns))
        return cls(bins[np.ix_(use, picked)], np.arange(len(use)), np.arange(len(picked)), lines, two, offsets(sizes, columns))

    def sums(self, place: np.ndarray, k: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient sums by (node place, bin of a column) over the rows that have a place.

        All are sums of whole numbers, so the order in which they are added makes no difference.
        """
        use = np.flatnonzero(place >= 0)
        at, both = place[use], np.stack([g[use], h[use]])
        made = np.zeros((2, k, int(self.offset[-1])))
        width = np.diff(self.offset)
        for line, a, n in zip(self.lines, self.offset[:-1][~self.two], width[~self.two], strict=True):
            code = at * n
            code += line[use]
            for v in (0, 1):
                made[v, :, a : a + n] = np.bincount(code, both[v], k * n).reshape(k, n)
        if self.two.any():
            order = np.argsort(at, kind="stable")
            use, at, both = use[order], at[order], both[:, order]
            bounds = np.searchsorted(at, np.arange(k + 1))
            ones, total = np.zeros((2, k, len(self.picked))), np.zeros((2, k, 1))
            step = max(16, FLAG_CELLS // self.flags.shape[1])
            for i in range(k):
                total[:, i, 0] = both[:, bounds[i] : bounds[i + 1]].sum(1)
                for a in range(bounds[i], bounds[i + 1], step):
                    b = min(a + step, bounds[i + 1])
                    ones[:, i] += (both[:, a:b] @ self.flags[self.rows[use[a:b]]].astype(np.float64))[:, self.picked]
            first, pair = self.offset[:-1][self.two], width[self.two] == 2
            made[:, :, first] = total - ones
            made[:, :, first[pair] + 1] = ones[:, :, pair]
        return made[0], made[1]


@dataclass
class Splits:
    """Best split of each node: column (-1 for none), bin, and what goes left of what there is."""

    column: np.ndarray
    bin: np.ndarray
    g_left: np.ndarray
    h_left: np.ndarray
    g: np.ndarray
    h: np.ndarray


def best_splits(g: np.ndarray, h: np.ndarray, offset: np.ndarray, setting: Setting) -> Splits:
    """From whole sums; g and h of the result are sums, still times QUANTUM."""

    def left_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        total = v.cumsum(1)
        before = np.where(offset[:-1] > 0, total[:, offset[:-1] - 1], 0)
        return total - np.repeat(before, np.diff(offset), axis=1), total[:, offset[1] - 1]

    (g_left, g_all), (h_left, h_all) = left_of(g), left_of(h)
    score = lambda a, b: (a / QUANTUM) ** 2 / (b / QUANTUM + PENALTY)
    rest_g, rest_h = g_all[:, None] - g_left, h_all[:, None] - h_left
    gain = score(g_left, h_left) + score(rest_g, rest_h) - score(g_all, h_all)[:, None]
    least = max(setting.least_hessian * QUANTUM, 1)
    gain[(h_left < least) | (rest_h < least)] = -np.inf
    cell = gain.argmax(1)
    every = np.arange(len(gain))
    column = np.searchsorted(offset, cell, "right") - 1
    cut = cell - offset[column]
    column = np.where(gain[every, cell] > max(setting.gamma, 1e-12), column, -1)
    return Splits(column, cut, g_left[every, cell], h_left[every, cell], g_all, h_all)


def put(tree: Tree, nodes: np.ndarray, columns: np.ndarray, splits: Splits, setting: Setting, last: bool) -> np.ndarray:
    """Writes a level into the tree; the nodes of the next level that may be split are returned."""
    leaf = lambda g, h: -setting.rate * (g / QUANTUM) / (h / QUANTUM + PENALTY)
    tree.value[nodes], tree.cover[nodes] = leaf(splits.g, splits.h), splits.h / QUANTUM
    cut = np.flatnonzero(splits.column >= 0)
    at = nodes[cut]
    tree.feature[at], tree.bin[at] = columns[splits.column[cut]], splits.bin[cut]
    left, right = (splits.g_left[cut], splits.h_left[cut]), (splits.g[cut] - splits.g_left[cut], splits.h[cut] - splits.h_left[cut])
    following = []
    for child, (g, h) in ((2 * at, left), (2 * at + 1, right)):
        tree.value[child], tree.cover[child] = leaf(g, h), h / QUANTUM
        following.append(child[h >= 2 * max(setting.least_hessian * QUANTUM, 1)])
    return np.zeros(0, np.int64) if last else np.sort(np.concatenate(following))


def routes(tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column, bin and left child of every node; a leaf is its own left child, and nothing is beyond its bin."""
    on = tree.feature >= 0
    own = np.arange(len(tree.feature))
    return np.where(on, tree.feature, 0).astype(np.int64), np.where(on, tree.bin, 255).astype(np.uint8), np.where(on, 2 * own, own)


def stepped(route: tuple[np.ndarray, np.ndarray, np.ndarray], bins: np.ndarray, first: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The node of each row one level on; ``bins`` lie in one line, in which ``first`` tells where rows begin."""
    column, cut, left = route
    at = column.take(node)
    at += first
    return left.take(node) + (bins.take(at) > cut.take(node))


def routed(tree: Tree, bins: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The node of each row one level on; rows in leaves stay."""
    return stepped(routes(tree), bins.reshape(-1), np.arange(0, bins.size, bins.shape[1] or 1), node)


def leaves(tree: Tree, bins: np.ndarray, depth: int) -> np.ndarray:
    node = np.ones(len(bins), np.int64)
    route, line, first = routes(tree), bins.reshape(-1), np.arange(0, bins.size, bins.shape[1] or 1)
    for _ in range(depth):
        node = stepped(route, line, first, node)
    return node


def places(nodes: np.ndarray, size: int) -> np.ndarray:
    """Place of each heap number among ``nodes``; -1 for others."""
    out = np.full(size, -1, np.int64)
    out[nodes] = np.arange(len(nodes))
    return out


def grown(block: Block, setting: Setting, sizes: np.ndarray) -> tuple[list[Tree], np.ndarray]:
    """All trees of a model whose rows are one block, and the margins of all its rows."""
    fitting = np.ones(len(block.bins), bool) if setting.held is None else block.fold != setting.held
    if not fitting.any():
        raise ValueError("no rows to fit on")
    margin, trees = np.zeros(len(block.bins)), []
    turned = np.ascontiguousarray(block.bins.T) if (sizes > 2).any() else None
    for t in range(setting.trees):
        columns = drawn_columns(len(sizes), setting, t)
        use = np.flatnonzero(fitting & drawn_rows(block.key, setting, t))
        cells = Cells.of(block.bins, use, columns, sizes, turned)
        g, h = gradients(margin[use], block.label[use], block.weight[use])
        tree, node = Tree.blank(setting.depth), np.ones(len(block.bins), np.int64)
        nodes, made = np.ones(1, np.int64), None
        for level in range(setting.depth):
            made = _level_sums(cells, node[use], nodes, len(tree.value), g, h, made)
            found = best_splits(*made[1], cells.offset, setting)
            nodes = put(tree, nodes, columns, found, setting, level == setting.depth - 1)
            node = routed(tree, block.bins, node)
            if not len(nodes):
                break
        trees.append(tree)
        margin += tree.value[node]
    return trees, margin


def _level_sums(cells: Cells, node: np.ndarray, nodes: np.ndarray, size: int, g: np.ndarray, h: np.ndarray, before: tuple | None) -> tuple:
    """(nodes, their sums).  Below the root the smaller child of a node is summed; the other is what it leaves of ``before``."""
    if before is None:
        return nodes, cells.sums(places(nodes, size)[node], len(nodes), g, h)
    parents = np.unique(nodes >> 1)
    rows = np.bincount(node, minlength=size)
    small = 2 * parents + (rows[2 * parents + 1] < rows[2 * parents])
    own = cells.sums(places(small, size)[node], len(small), g, h)
    parent, above = np.searchsorted(parents, nodes >> 1), np.searchsorted(before[0], nodes >> 1)
    whole = (nodes == small[parent])[:, None]
    return nodes, tuple(np.where(whole, s[parent], b[above] - s[parent]) for s, b in zip(own, before[1], strict=True))


# The binned table


@dataclass
class Binned:
    """Blocks of binned rows (block, blob), the edges of the bins, and the number of rows."""

    blocks: DataFrame
    edges: list[np.ndarray]
    n: int

    @property
    def sizes(self) -> np.ndarray:
        """Bins of every feature."""
        return np.array([len(e) + 1 for e in self.edges])

    @property
    def whole(self) -> bool:
        return self.n * len(self.edges) <= BLOCK_BYTES

    @classmethod
    def of(
        cls, df: DataFrame, id_col: str | None = None, label: str = K.LABEL, weight: str = "w_pos", fold: str | None = None,
        edges: list[np.ndarray] | None = None,
    ) -> "Binned":
        """``features`` is a vector column.  Without an id, rows are told apart by a hash of their features.

        Without ``edges`` the bins are cut by ``bin_edges``.
        """
        key = F.xxhash64(id_col if id_col else vector_to_array("features"))
        chosen = df.select(
            key.alias("key"),
            F.col(label).cast("double").alias("label"),
            F.col(weight).cast("double").alias("weight"),
            (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold"),
            vector_to_array("features").alias("x"),
        )
        n, width = chosen.agg(F.count("*"), F.max(F.size("x"))).first()
        if not n:
            raise ValueError("no rows to fit on")
        edges = bin_edges(chosen, n, width) if edges is None else edges
        count = -(-n * width // BLOCK_BYTES)
        count = count if count == 1 else max(count, LEAST_BLOCKS)
        dealt = chosen.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(count)).cast("int"))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            for batch in batches:
                number = batch.column("block").to_numpy()
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                bins = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], 1).astype(np.uint8)
                parts = [bins, *(batch.column(c).to_numpy() for c in ("key", "label", "weight", "fold"))]
                for b in np.unique(number).tolist():
                    # Rows are sorted by block: those before are complete.
                    for done in [k for k in held if k < b]:
                        yield _packed(done, held.pop(done))
                    held.setdefault(b, []).append([p[number == b] for p in parts])
            for b, rows in held.items():
                yield _packed(b, rows)

        tasks = max(-(-n * width // BLOCK_BYTES), min(count, df.sparkSession.sparkContext.defaultParallelism))
        moved = dealt.repartition(tasks, F.col("block") % F.lit(tasks)).sortWithinPartitions("block", "key")
        return cls(stored(moved.mapInArrow(pack, "block int, blob binary"), "blocks"), edges, n)

    def only(self) -> Block:
        """The one block of a table that is whole."""
        return pickle.loads(self.blocks.first()["blob"])


def _packed(number: int, parts: list) -> pa.RecordBatch:
    block = Block(*(np.concatenate(p) for p in zip(*parts, strict=True)))
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([pickle.dumps(block, 5)], pa.binary())], ["block", "blob"])


def bin_edges(rows: DataFrame, n: int, width: int) -> list[np.ndarray]:
    """Upper edges of all bins but the last, from a sample drawn by hash: midpoints of few values, else quantiles."""
    most = max(1, min(EDGE_ROWS, EDGE_CELLS // max(width, 1)))
    share = (most + 10 * most**0.5 + 10) / n
    near = rows.filter(F.col("key") <= int(-(2.0**63) + share * 2.0**64)) if share < 1 else rows
    table = near.orderBy("key").limit(most).select("x").toArrow()["x"].combine_chunks()
    x = table.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if len(table) else np.zeros((0, width))
    out = []
    for column in x.T:
        values = np.unique(column[np.isfinite(column)])
        if len(values) > BINS:
            values = np.unique(np.quantile(column[np.isfinite(column)], np.linspace(0, 1, BINS + 1), method="lower"))
            out.append(values[1:-1])
        else:
            out.append((values[:-1] + values[1:]) / 2)
    return out


# Models


@dataclass
class BoostedModel:
    """Fitted trees: node arrays (tree, heap number) with thresholds in place of bins."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    depth: int

    @classmethod
    def of(cls, trees: list[Tree], edges: list[np.ndarray], depth: int) -> "BoostedModel":
        feature = np.stack([t.feature for t in trees])
        threshold = np.zeros(feature.shape)
        for t, node in zip(*np.nonzero(feature >= 0), strict=True):
            threshold[t, node] = edges[feature[t, node]][trees[t].bin[node]]
        return cls(feature, threshold, np.stack([t.value for t in trees]), np.stack([t.cover for t in trees]), depth)

    def getMaxDepth(self) -> int:  # noqa: N802 - as Spark's models name it
        return self.depth

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Summed leaf values of rows of features."""
        out = np.zeros(len(x))
        tree = np.arange(len(self.feature))[None]
        for a in range(0, len(x), 256):
            part = x[a : a + 256]
            row = np.arange(len(part))[:, None]
            node = np.ones((len(part), len(self.feature)), np.int64)
            for _ in range(self.depth):
                f = self.feature[tree, node]
                on = f >= 0
                # As in binning, a NaN is beyond every edge.
                left = part[row, np.where(on, f, 0)] <= self.threshold[tree, node]
                node = np.where(on, 2 * node + ~left, node)
            out[a : a + 256] = self.value[tree, node].sum(1)
        return out

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Adds rawPrediction, probability and prediction, as Spark's classifiers do."""
        held = df.sparkSession.sparkContext.broadcast(self)

        @F.arrow_udf("double")
        def margin(column: pa.Array) -> pa.Array:
            x = column.flatten().to_numpy(zero_copy_only=False)
            return pa.array(held.value.margins(x.reshape(len(column), -1)) if len(column) else np.zeros(0))

        raw, p = F.col("_margin"), 1 / (1 + F.exp(-F.col("_margin")))
        out = df.withColumn("_margin", margin(vector_to_array(features)))
        out = out.withColumn("rawPrediction", array_to_vector(F.array(-raw, raw)))
        out = out.withColumn("probability", array_to_vector(F.array(1 - p, p)))
        return out.withColumn("prediction", (p > 0.5).cast("double")).drop("_margin")

    def node_table(self) -> pd.DataFrame:
        """One row per node that is reached, in the columns of attribution.read_nodes."""
        rows = []
        for t in range(len(self.feature)):
            todo = [1]
            while todo:
                i = todo.pop()
                split = self.feature[t, i] >= 0
                children = (2 * i - 1, 2 * i) if split else (-1, -1)
                rows.append((t, i - 1, *children, self.value[t, i], [self.cover[t, i]], self.feature[t, i] if split else -1, self.threshold[t, i], -1, 1.0))
                todo += [2 * i, 2 * i + 1] if split else []
        return pd.DataFrame(rows, columns=["tree_id", "node_id", "left_id", "right_id", "prediction", "stats", "feature", "threshold", "n_categories", "weight"])

    def save(self, spark: SparkSession, path: str) -> None:
        n = self.feature.shape[1]
        rows = [
            (t, self.depth, *(v[t].tolist() for v in (self.feature, self.threshold, self.value, self.cover)))
            for t in range(len(self.feature))
        ]
        assert n == 2 << self.depth
        kind = "tree_id INT, depth INT, feature ARRAY<INT>, threshold ARRAY<DOUBLE>, value ARRAY<DOUBLE>, cover ARRAY<DOUBLE>"
        spark.createDataFrame(rows, kind).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "BoostedModel":
        rows = spark.read.parquet(path).orderBy("tree_id").collect()
        parts = [np.array([r[c] for r in rows]) for c in ("feature", "threshold", "value", "cover")]
        return cls(*parts, rows[0]["depth"])


@dataclass(frozen=True)
class BoostedTrees:
    """Settings that can be fitted to a table with ``features``, ``label`` and ``w_pos``."""

    params: Mapping
    seed: int = K.SEED

    def copy(self) -> "BoostedTrees":
        return self

    def getMaxIter(self) -> int:  # noqa: N802 - as Spark's estimators name it
        return Setting.of(self.params).trees

    def getMaxDepth(self) -> int:  # noqa: N802
        return Setting.of(self.params).depth

    def fit(self, df: DataFrame) -> BoostedModel:
        setting = Setting.of(self.params, seed=self.seed)
        binned = Binned.of(df, K.ROW_ID if K.ROW_ID in df.columns else None)
        return BoostedModel.of(fit_all(binned, [setting])[0], binned.edges, setting.depth)


def fit_all(binned: Binned, settings: Sequence[Setting]) -> list[list[Tree]]:
    """The trees of every setting; they come to the driver, and settings bound their size."""
    if not binned.whole:
        return _in_lock_step(binned, settings)[0]
    return [trees for trees, _ in _by_task(binned, settings, lambda block, trees, margin: trees)]


def scores(binned: Binned, settings: Sequence[Setting]) -> DataFrame:
    """(model, label, fold, score, error): every row scored by every setting; ``model`` is the setting's place."""
    spark = binned.blocks.sparkSession
    kind = "model int, label int, fold int, score double, error string"

    def told(model: int, block: Block, margin: np.ndarray) -> pa.RecordBatch:
        n = len(margin)
        columns = [np.full(n, model, np.int32), block.label.astype(np.int32), block.fold, 1 / (1 + np.exp(-margin))]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(n, pa.string())], ["model", "label", "fold", "score", "error"])

    if not binned.whole:
        _, state = _in_lock_step(binned, settings)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for blob in batch.column("blob").to_pylist():
                    block = pickle.loads(blob)
                    for m in range(len(block.margin)):
                        yield told(m, block, block.margin[m])

        return state.mapInArrow(each, kind)
    held = spark.sparkContext.broadcast((binned.only(), list(settings), binned.sizes))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, settings, sizes = held.value
        for batch in batches:
            for m in batch.column("id").to_pylist():
                try:
                    yield told(m, block, grown(block, settings[m], sizes)[1])
                except Exception as e:  # noqa: BLE001 - the failure is the result
                    columns = [[m], [None], [None], [None], [f"{type(e).__name__}: {e}"]]
                    types = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["model", "label", "fold", "score", "error"])

    return _numbers(spark, len(settings)).mapInArrow(grow, kind)


def _numbers(spark: SparkSession, n: int) -> DataFrame:
    """The places of the settings, each in a partition of its own."""
    return spark.range(0, n, 1, n)


def _by_task(binned: Binned, settings: Sequence[Setting], pick) -> list:
    """``pick`` of every model's fit, each grown in a task over the one block; in the order of the settings."""
    spark = binned.blocks.sparkSession
    held = spark.sparkContext.broadcast((binned.only(), list(settings), binned.sizes))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, settings, sizes = held.value
        for batch in batches:
            for m in batch.column("id").to_pylist():
                out = pickle.dumps((pick(block, *grown(block, settings[m], sizes)), None), 5)
                yield pa.RecordBatch.from_arrays([pa.array([m]), pa.array([out], pa.binary())], ["m", "out"])

    rows = _numbers(spark, len(settings)).mapInArrow(grow, "m long, out binary").toArrow().sort_by("m")
    return [pickle.loads(r) for r in rows["out"].to_pylist()]


def _in_lock_step(binned: Binned, settings: Sequence[Setting]) -> tuple[list[list[Tree]], DataFrame]:
    """The trees of every setting, and the blocks with the final margins of every setting."""
    settings = list(settings)
    sizes = binned.sizes
    trees: list[list[Tree]] = [[] for _ in settings]
    state = stored(_advanced(binned.blocks, settings, [[] for _ in settings]), "state")
    since = [0] * len(settings)
    for t in range(max(s.trees for s in settings)):
        live = {m: np.ones(1, np.int64) for m, s in enumerate(settings) if t < s.trees}
        if t and t % KEEP == 0:
            state = stored(_advanced(state, settings, [ts[a:] for ts, a in zip(trees, since, strict=True)]), "state")
            since = [len(ts) for ts in trees]
        fresh = {m: Tree.blank(settings[m].depth) for m in live}
        for level in range(max(settings[m].depth for m in live)):
            nodes = {m: n for m, n in live.items() if len(n) and level < settings[m].depth}
            if not nodes:
                break
            recent = [ts[a:] for ts, a in zip(trees, since, strict=True)]
            for m, found in _level(state, settings, sizes, recent, fresh, nodes, t, level).items():
                last = level == settings[m].depth - 1
                live[m] = put(fresh[m], nodes[m], drawn_columns(len(sizes), settings[m], t), found, settings[m], last)
        for m, tree in fresh.items():
            trees[m].append(tree)
    rest = [ts[a:] for ts, a in zip(trees, since, strict=True)]
    return trees, stored(_advanced(state, settings, rest), "state")


def _advanced(state: DataFrame, settings: list[Setting], recent: list[list[Tree]]) -> DataFrame:
    """The blocks with the values of recent trees added to their margins."""
    held = state.sparkSession.sparkContext.broadcast(recent)

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column("block").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                block = pickle.loads(blob)
                if not len(block.margin):
                    block.margin = np.zeros((len(settings), len(block.bins)))
                for m, trees in enumerate(held.value):
                    block.margin[m] = _margin(block, m, trees, settings[m].depth)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([pickle.dumps(block, 5)], pa.binary())], ["block", "blob"])

    return state.mapInArrow(advance, "block int, blob binary")


def _margin(block: Block, m: int, recent: list[Tree], depth: int) -> np.ndarray:
    out = block.margin[m].copy()
    for tree in recent:
        out += tree.value[leaves(tree, block.bins, depth)]
    return out


def _level(state: DataFrame, settings: list[Setting], sizes: np.ndarray, recent: list[list[Tree]], fresh: dict[int, Tree], nodes: dict[int, np.ndarray], t: int, level: int) -> dict[int, Splits]:
    """Best splits of the given nodes of every model: one pass over the blocks, one shuffle of their sums."""
    held = state.sparkSession.sparkContext.broadcast((settings, recent, fresh, nodes))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settings, recent, fresh, nodes = held.value
        total: dict[tuple[int, int], np.ndarray] = {}
        size = 0
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                block = pickle.loads(blob)
                for m, at in nodes.items():
                    s = settings[m]
                    use = drawn_rows(block.key, s, t)
                    use &= True if s.held is None else block.fold != s.held
                    part = Block(block.bins[use], block.key[use], block.label[use], block.weight[use], block.fold[use], block.margin[:, use])
                    g, h = gradients(_margin(part, m, recent[m], s.depth), part.label, part.weight)
                    node = leaves(fresh[m], part.bins, level)
                    place = places(at, len(fresh[m].value))[node]
                    inside = np.flatnonzero(place >= 0)
                    cells = Cells.of(part.bins, inside, drawn_columns(len(sizes), s, t), sizes)
                    made = np.stack(cells.sums(place[inside], len(at), g[inside], h[inside]), 1)
                    for i, one in zip(at.tolist(), made, strict=True):
                        if (m, i) in total:
                            total[m, i] += one
                        else:
                            total[m, i] = one
                            size += one.nbytes
                    if size > COMBINE_BYTES:
                        yield _summed(total)
                        total, size = {}, 0
        if total:
            yield _summed(total)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settings = held.value[0]
        key, total = None, None
        for batch in batches:
            for m, i, blob in zip(batch.column("model").to_pylist(), batch.column("node").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                one = np.frombuffer(blob).reshape(2, -1)
                if key == (m, i):
                    total = total + one
                    continue
                if key is not None:
                    yield _split_row(key, total, settings[key[0]], sizes, t)
                key, total = (m, i), one
        if key is not None:
            yield _split_row(key, total, settings[key[0]], sizes, t)

    parts = state.select("blob").mapInArrow(add, "model int, node int, blob binary")
    if 16 * sum(len(at) for at in nodes.values()) * int(sizes.sum()) <= DIRECT_BYTES:
        return _met(parts.toArrow(), settings, sizes, nodes, t)
    met = parts.repartition("model", "node").sortWithinPartitions("model", "node")
    table = met.mapInArrow(meet, SPLIT).toPandas()
    out = {}
    # A tree whose sample is empty has no row.
    for m in nodes:
        rows = table[table["model"] == m]
        rows = rows.set_index("node").reindex(nodes[m].tolist())
        rows = rows.fillna({"feature": -1} | dict.fromkeys(("bin", "g_left", "h_left", "g", "h"), 0)).astype({"feature": int, "bin": int})
        out[int(m)] = Splits(*(rows[c].to_numpy() for c in ("feature", "bin", "g_left", "h_left", "g", "h")))
    return out


def _met(parts: pa.Table, settings: list[Setting], sizes: np.ndarray, nodes: dict[int, np.ndarray], t: int) -> dict[int, Splits]:
    """The same from the sums of every task, few as they are."""
    out = {}
    held: dict[tuple[int, int], np.ndarray] = {}
    for m, i, blob in zip(*(parts[c].to_pylist() for c in ("model", "node", "blob")), strict=True):
        one = np.frombuffer(blob).reshape(2, -1)
        held[m, i] = held[m, i] + one if (m, i) in held else one
    for m, at in nodes.items():
        offset = offsets(sizes, drawn_columns(len(sizes), settings[m], t))
        made = np.stack([held.get((m, i), np.zeros((2, int(offset[-1])))) for i in at.tolist()], 1)
        out[int(m)] = best_splits(*made, offset, settings[m])
    return out


SPLIT = "model int, node int, feature int, bin int, g_left double, h_left double, g double, h double"


def _summed(total: dict) -> pa.RecordBatch:
    models, nodes = zip(*total, strict=True)
    blobs = [v.tobytes() for v in total.values()]
    return pa.RecordBatch.from_arrays([pa.array(models, pa.int32()), pa.array(nodes, pa.int32()), pa.array(blobs, pa.binary())], ["model", "node", "blob"])


def _split_row(key: tuple[int, int], total: np.ndarray, setting: Setting, sizes: np.ndarray, t: int) -> pa.RecordBatch:
    s = best_splits(total[0][None], total[1][None], offsets(sizes, drawn_columns(len(sizes), setting, t)), setting)
    values = [[key[0]], [key[1]], s.column, s.bin, s.g_left, s.h_left, s.g, s.h]
    kinds = [pa.int32()] * 4 + [pa.float64()] * 4
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in SPLIT.split(", ")])
