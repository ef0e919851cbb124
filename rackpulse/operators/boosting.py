"""Boosted trees on binned features, many models side by side in the same jobs.

* A feature value becomes a byte: its place among at most ``bins - 2`` edges, quantiles of the training rows, and a place of its own where
  it is missing. The matrix of
  bytes is written once, in blocks of rows.
* Of a matrix up to ``TASK_BYTES`` every model gets a task of its own that grows all its trees, in one job for all models: the
  jobs of single levels would take far longer than their sums. The task adds up the same parts in the same order.
* Of a larger matrix each level of all models' current trees takes one job. A task adds up gradients, hessians and rows per (model, node,
  feature, bin) over its blocks; the tasks' sums of a node meet by a shuffle, in the order of the tasks, and stay on the
  executors. Of two siblings only the one with fewer rows is added up, the other is the difference to their parent.
* The best split of a node is picked where its sums are, and the driver gets a row per model and node. Nodes of the last
  level need no split, so only one feature is added up for them. Margins stay with the blocks and are checkpointed every
  few rounds.

Folds of a cross-validation and other settings of the rows' weights are models of one run, so that they share its jobs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.operators.window_features import LABEL
from rackpulse.session import materialise, use_checkpoints

# Settings of the published classifier.
ROUNDS, DEPTH, STEP, L2, LEAST_ROWS, BINS = 200, 6, 0.05, 1.0, 20, 255
#: Rounds between checkpoints of the margins.
CHECKPOINT_ROUNDS = 25
#: Rows of a block, and blocks a task takes once every core has a task.
BLOCK_ROWS, TASK_BLOCKS = 65_536, 64
#: Largest matrix, in bytes (rows times features), that a single task reads to grow a model, and the jobs of levels that cost
#: no more than dealing the rows to the models' tasks.
TASK_BYTES, FEW_JOBS = 32 << 20, 8
#: Leaves whose shares are computed together.
PATHS = 512
#: Smallest hessian of a leaf and smallest gain of a split.
LEAST_HESSIAN, LEAST_GAIN = 1e-3, 1e-9


@dataclass
class Tree:
    """A tree in heap order: node i has the children 2 i + 1 (bin at most ``bin``) and 2 i + 2; ``feature`` is -1 at leaves."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    #: Weight of the training rows (hessians) that reached the node.
    cover: np.ndarray

    @classmethod
    def leaf(cls, depth: int) -> Tree:
        size = (2 << depth) - 1
        return cls(np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size), np.zeros(size))

    def places(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """Node of each row after ``levels`` levels; ``bins`` has a row per feature."""
        at = np.zeros(bins.shape[1], np.int32)
        rows = np.arange(bins.shape[1])
        for _ in range(levels):
            feature = self.feature[at]
            inner = feature >= 0
            right = bins[np.maximum(feature, 0), rows] > self.bin[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return at


def to_bins(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bytes per feature and row; missing values have the first bin, below all others."""
    out = np.zeros((len(edges), len(x)), np.uint8)
    for f, own in enumerate(edges):
        column = x[:, f]
        out[f] = np.where(np.isnan(column), 0, 1 + np.searchsorted(own, column, side="left"))
    return out


@dataclass
class Path:
    """A leaf: the distinct features on its path, the bins (low, high] that each allows, and what it is worth to them.

    ``shares`` has a row for each pattern of satisfied intervals (bit i: feature i) with the Shapley values of the
    features; ``mean`` is the leaf's part of the tree's mean.
    """

    features: list[int]
    low: list[int]
    high: list[int]
    shares: np.ndarray
    mean: float


def _shapley_shares(kept: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Shapley values of products of factors: a feature that is known gives 0 or 1, one that is not gives ``kept``.

    ``kept`` has a row per product; the result (product, pattern, feature) has all their patterns.
    """
    products, n = kept.shape
    weights = np.array([factorial(s) * factorial(n - s - 1) / factorial(n) for s in range(n)])
    inside = (np.arange(1 << n)[:, None] >> np.arange(n) & 1).astype(float)
    out = np.zeros((products, 1 << n, n))
    for i in range(n):
        # Coefficients: the product over the other features, by how many of them are known.
        worth = np.ones((products, 1 << n, 1))
        for k in range(n):
            if k != i:
                grown = np.zeros((products, 1 << n, worth.shape[2] + 1))
                grown[:, :, :-1] = worth * kept[:, k, None, None]
                grown[:, :, 1:] += worth * inside[:, k, None]
                worth = grown
        out[:, :, i] = value[:, None] * (inside[:, i] - kept[:, i, None]) * (worth * weights).sum(axis=2)
    return out


def leaf_paths(trees: Sequence[Tree]) -> list[Path]:
    """The leaves of all trees; those with equally many features get their shares together, ``PATHS`` at a time."""
    found: list[Path] = []
    factors: list[list[float]] = []
    values: list[float] = []

    def walk(tree: Tree, node: int, limits: dict[int, tuple[int, int, float]]) -> None:
        feature = int(tree.feature[node])
        if feature < 0:
            kept = [k for _, _, k in limits.values()]
            value = float(tree.value[node])
            factors.append(kept)
            values.append(value)
            found.append(Path(list(limits), [a for a, _, _ in limits.values()], [b for _, b, _ in limits.values()], np.zeros(0), value * float(np.prod(kept))))
            return
        low, high, kept = limits.get(feature, (-1, 255, 1.0))
        at = int(tree.bin[node])
        for child, bounds in ((2 * node + 1, (low, min(high, at))), (2 * node + 2, (max(low, at), high))):
            walk(tree, child, limits | {feature: (*bounds, kept * float(tree.cover[child] / tree.cover[node]))})

    for tree in trees:
        walk(tree, 0, {})
    lengths = np.array([len(kept) for kept in factors])
    for n in np.unique(lengths):
        same = np.flatnonzero(lengths == n)
        for at in np.array_split(same, -(-len(same) // PATHS)):
            shares = _shapley_shares(np.array([factors[i] for i in at]).reshape(len(at), n), np.array([values[i] for i in at]))
            for i, own in zip(at, shares, strict=True):
                found[i].shares = own.copy()
    return found


@dataclass
class BoostedTrees:
    """Trees, the bins' edges, and the log odds that the first tree starts from."""

    edges: list[np.ndarray]
    trees: list[Tree]
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = to_bins(x, self.edges)
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += tree.value[tree.places(bins, self.depth)]
        return out

    def paths(self) -> list[Path]:
        """The table of all trees' leaves."""
        return leaf_paths(self.trees)

    def attribution(self, x: np.ndarray, paths: list[Path] | None = None) -> np.ndarray:
        """Shapley values of the features for the margin, a row per row of ``x``; with :meth:`expected` they add up to it.

        What a tree is worth without a feature is its mean over both branches, weighted by the training rows' cover.
        """
        bins = to_bins(x, self.edges)
        out = np.zeros((len(x), len(self.edges)))
        for path in self.paths() if paths is None else paths:
            pattern = np.zeros(len(x), np.int64)
            for i, f in enumerate(path.features):
                pattern |= ((bins[f] > path.low[i]) & (bins[f] <= path.high[i])).astype(np.int64) << i
            for i, f in enumerate(path.features):
                out[:, f] += path.shares[pattern, i]
        return out

    def expected(self, paths: list[Path] | None = None) -> float:
        """The margin when no feature is known."""
        return self.base + sum(path.mean for path in (self.paths() if paths is None else paths))

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the vector ``probability`` of both classes, from its vector ``features``."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def probability(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in values:
                x = np.array(part.tolist(), float).reshape(len(part), len(shared.value.edges))
                yield pd.Series(1 / (1 + np.exp(-shared.value.margin(x))))

        p = probability(vector_to_array("features"))
        scored = df.withColumn("probability_of_one", p)
        return scored.withColumn("probability", array_to_vector(F.array(1 - F.col("probability_of_one"), F.col("probability_of_one")))).drop("probability_of_one")

    def write(self) -> BoostedTrees:
        return self

    def overwrite(self) -> BoostedTrees:
        return self

    def save(self, path: str) -> None:
        """A row per tree, and one with the edges."""
        spark = SparkSession.getActiveSession()
        rows = [(i, t.feature.tolist(), t.bin.tolist(), t.value.tolist(), t.cover.tolist(), None, None, None) for i, t in enumerate(self.trees)]
        rows.append((-1, None, None, None, None, [e.tolist() for e in self.edges], self.base, self.depth))
        schema = "tree int, feature array<int>, bin array<int>, value array<double>, cover array<double>, edges array<array<double>>, base double, depth int"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, path: str) -> BoostedTrees:
        rows = SparkSession.getActiveSession().read.parquet(path).orderBy("tree").collect()
        head = rows[0]
        trees = [Tree(np.array(r.feature, np.int32), np.array(r.bin, np.int32), np.array(r.value), np.array(r.cover)) for r in rows[1:]]
        return cls([np.array(e, float) for e in head.edges], trees, head.base, head.depth)


def bin_edges(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Quantiles of every feature in one pass; exact where a feature has fewer than some thousand distinct values."""
    shares = [(i + 1) / (bins - 1) for i in range(bins - 2)]
    values = rows.select(F.posexplode("x").alias("f", "v")).filter("v is not null and not isnan(v)")
    found = values.groupBy("f").agg(F.percentile_approx("v", shares, 20_000).alias("q")).collect()
    edges = {r["f"]: np.unique(np.array(r["q"], float)) for r in found}
    return [edges.get(f, np.zeros(0)) for f in range(width)]


def _blocks(rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """Rows (n, bins, label, weights) of binary blocks from rows (x, label, weights)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            x, y, w = (np.concatenate([h[i] for h in held], axis=-1) for i in range(3))
            held.clear()
            return pa.record_batch([pa.array([v], t) for v, t in ((len(y), pa.int64()), (x.tobytes(), pa.binary()), (y.tobytes(), pa.binary()), (w.tobytes(), pa.binary()))], names=["n", "bins", "label", "weights"])

        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(len(batch), len(edges))
            weights = np.array(batch.column(2).to_pylist(), float).T
            held.append((to_bins(x, edges), batch.column(1).to_numpy().astype(float), weights))
            if sum(len(h[1]) for h in held) >= BLOCK_ROWS:
                yield block()
        if held:
            yield block()

    return rows.select("x", F.col("label").cast("double"), "weights").mapInArrow(pack, "n long, bins binary, label binary, weights binary")


def _unpack(row) -> tuple:
    """(bins, label, weights, margins) of a block, margins at zero."""
    label = np.frombuffer(row["label"])
    weights = np.frombuffer(row["weights"]).reshape(-1, row["n"])
    return np.frombuffer(row["bins"], np.uint8).reshape(-1, row["n"]), label, weights, np.zeros(weights.shape)


@dataclass
class Split:
    """What the driver learns of a node: its gradients, its hessians and its split, if it has one."""

    model: int
    node: int
    gradient: float
    hessian: float
    feature: int = -1
    bin: int = 0
    #: The child with fewer rows.
    fewer: int = 0


def _slopes(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and hessians of rows."""
    p = 1 / (1 + np.exp(-margin))
    return weight * (p - label), weight * p * (1 - p)


def _add(total: np.ndarray, slot: np.ndarray, matrix: np.ndarray, own: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, widths: list[int]) -> None:
    """Adds the rows ``own`` of a block, at the nodes ``slot``, to the sums (3, node, bins of all features side by side)."""
    base, start = slot.astype(np.int64), 0
    for f, width in enumerate(widths):
        cell = base * width + matrix[f, own]
        for i, values in enumerate((gradient, hessian, None)):
            total[i, :, start : start + width] += np.bincount(cell, values, minlength=total.shape[1] * width).reshape(-1, width)
        start += width


def _sums(part: int, blocks: Iterator[tuple], trees: list[Tree], wanted: list[tuple[int, int]], level: int, widths: list[int]) -> Iterator[tuple]:
    """Rows ((model, node), (part, sums)) of a task: gradients, hessians and rows, of all features' bins side by side."""
    slots = np.full((len(trees), len(trees[0].feature)), -1, np.int32)
    for slot, (m, node) in enumerate(wanted):
        slots[m, node] = slot
    total = np.zeros((3, len(wanted), sum(widths)))
    for matrix, label, weights, margins in blocks:
        for m, tree in enumerate(trees):
            if slots[m].max() < 0:
                continue
            slot = slots[m][tree.places(matrix, level)]
            own = np.flatnonzero((slot >= 0) & (weights[m] > 0))
            if len(own):
                gradient, hessian = _slopes(margins[m, own], label[own], weights[m, own])
                first, last = int(slots[m][slots[m] >= 0].min()), int(slots[m].max()) + 1
                _add(total[:, first:last], slot[own] - first, matrix, own, gradient, hessian, widths)
    for slot, key in enumerate(wanted):
        if total[2, slot].any():
            yield key, (part, total[:, slot].copy())


def _met(rows: Iterator[tuple], widths: list[int], last: bool, l2: float, least_rows: int) -> Iterator[tuple[Split, np.ndarray | None]]:
    """The nodes of one reducer, siblings included, with their splits and, where they are split, their sums.

    The sums of a node's parent come along under the node's key, as part -1.
    """
    held: dict[tuple[int, int], list] = {}
    for key, own in rows:
        held.setdefault(key, []).append(own)
    for (m, node), found in held.items():
        # A fixed order, so that equal runs give equal sums.
        found.sort(key=lambda own: own[0])
        whole = found.pop(0)[1] if found[0][0] < 0 else None
        total = np.zeros((3, sum(widths)))
        for _, own in found:
            total += own
        nodes = [(node, total)]
        if whole is not None:
            nodes.append((node + 1 if node % 2 else node - 1, whole - total))
        for at, sums in nodes:
            split = _split(m, at, sums, widths, last, l2, least_rows)
            yield split, (sums if split.feature >= 0 else None)


def _split(model: int, node: int, sums: np.ndarray, widths: list[int], last: bool, l2: float, least_rows: int) -> Split:
    square = np.zeros((len(widths), max(widths), 3))
    for f, end in enumerate(np.cumsum(widths)):
        square[f, : widths[f]] = sums[:, end - widths[f] : end].T
    g, h, rows = square[0].sum(axis=0)
    split = Split(model, node, float(g), float(h))
    if last:
        return split
    gain, feature, at = _best_split(square, l2, least_rows)
    if gain > LEAST_GAIN:
        left = square[feature, : at + 1, 2].sum()
        split.feature, split.bin, split.fewer = feature, at, 2 * node + (1 if 2 * left <= rows else 2)
    return split


def _moved(block: tuple, trees: list[Tree], depth: int) -> tuple:
    matrix, label, weights, margins = block
    return matrix, label, weights, margins + np.stack([t.value[t.places(matrix, depth)] for t in trees])


def _best_split(sums: np.ndarray, l2: float, least_rows: int) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best split of one node's sums (feature, bin, 3); of equal ones the first."""
    left = np.cumsum(sums, axis=1)
    whole = left[:, -1:, :]
    right = whole - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + l2 + 1e-300)
    gain = score(left) + score(right) - score(whole)
    allowed = (left[..., 2] >= least_rows) & (right[..., 2] >= least_rows) & (left[..., 1] >= LEAST_HESSIAN) & (right[..., 1] >= LEAST_HESSIAN)
    gain = np.where(allowed, gain, -np.inf)
    at = int(np.argmax(gain))
    return float(gain.flat[at]), at // gain.shape[1], at % gain.shape[1]


class _Block:
    """A block in the task of its model: the rows with weight, their margins, slopes and nodes of the current tree."""

    def __init__(self, matrix: np.ndarray, label: np.ndarray, weight: np.ndarray, margin: float):
        self.matrix, self.label, self.weight, self.margin = matrix, label, weight, np.full(len(label), margin)

    def begin(self) -> None:
        self.at = np.zeros(len(self.label), np.int32)
        self.gradient, self.hessian = _slopes(self.margin, self.label, self.weight)

    def add(self, total: np.ndarray, slots: np.ndarray, widths: list[int]) -> None:
        slot = slots[self.at]
        own = np.flatnonzero(slot >= 0)
        if len(own):
            _add(total, slot[own], self.matrix, own, self.gradient[own], self.hessian[own], widths)

    def descend(self, tree: Tree) -> None:
        feature = tree.feature[self.at]
        inner = np.flatnonzero(feature >= 0)
        at = self.at[inner]
        self.at[inner] = 2 * at + 1 + (self.matrix[feature[inner], inner] > tree.bin[at])

    def end(self, tree: Tree) -> None:
        self.margin += tree.value[self.at]


class HistogramTrees:
    """Estimator with the published settings; nodes grow level by level."""

    def __init__(self, rounds: int = ROUNDS, depth: int = DEPTH, step: float = STEP, l2: float = L2, least_rows: int = LEAST_ROWS, bins: int = BINS):
        self.rounds, self.depth, self.step, self.l2, self.least_rows, self.bins = rounds, depth, step, l2, least_rows, bins

    def fit(self, rows: DataFrame) -> BoostedTrees:
        """One model of rows (features, label, weight)."""
        table = rows.select(vector_to_array("features").alias("x"), F.col(LABEL).alias("label"), F.array(F.col("weight").cast("double")).alias("weights"))
        return self.fit_side_by_side(table)[0]

    def fit_side_by_side(self, rows: DataFrame) -> list[BoostedTrees]:
        """A model for each place of the array ``weights`` of rows (x, label, weights).

        Rows with weight zero take no part in a model. Without rows, or with rows of one class, a model has no trees. Missing values
        are below all others.
        """
        spark = rows.sparkSession
        use_checkpoints(spark)
        first = rows.select(F.size("x").alias("width"), F.size("weights").alias("models")).first()
        if first is None:
            return [BoostedTrees([], [], 0.0, self.depth)]
        models = first["models"]
        edges = bin_edges(rows, first["width"], self.bins)
        packed = materialise(_blocks(rows, edges), "binned")
        start = rows.select(F.posexplode("weights").alias("m", "w"), "label").groupBy("m").agg(
            F.sum(F.col("w") * (F.col("label") == 1).cast("double")).alias("ones"), F.sum("w").alias("all")
        )
        shares = {r["m"]: (r["ones"], r["all"]) for r in start.collect()}
        odds = np.zeros(models)
        alive = np.zeros(models, bool)
        for m, (ones, whole) in shares.items():
            share = ones / whole if whole else 0.5
            alive[m] = whole > 0 and 0 < share < 1
            share = min(max(share, 1e-6), 1 - 1e-6)
            odds[m] = np.log(share / (1 - share))
        widths = [len(own) + 2 for own in edges]
        size = packed.agg(F.sum("n")).first()[0] or 0
        tasks = max(spark.sparkContext.defaultParallelism, size // (TASK_BLOCKS * BLOCK_ROWS))
        blocks = packed.rdd if packed.rdd.getNumPartitions() <= tasks else packed.rdd.coalesce(tasks)
        small = size * len(edges) <= TASK_BYTES and self.rounds * (self.depth + 1) > FEW_JOBS
        grown = (self._grow_in_tasks if small else self._grow_by_levels)(blocks, odds, alive, widths)
        return [BoostedTrees(edges, grown[m], float(odds[m]), self.depth) for m in range(models)]

    def _grow_in_tasks(self, blocks, odds: np.ndarray, alive: np.ndarray, widths: list[int]) -> list[list[Tree]]:
        """The trees of all models, each grown by a task that has the model's rows in the parts they come in."""
        place = {m: i for i, m in enumerate(np.flatnonzero(alive).tolist())}

        def own(part: int, rows: Iterator) -> Iterator[tuple]:
            for number, row in enumerate(rows):
                matrix, label, weights, _ = _unpack(row)
                for m in place:
                    mine = np.flatnonzero(weights[m] > 0)
                    if len(mine):
                        yield m, (part, number, matrix[:, mine], label[mine], weights[m, mine])

        def grow(rows: Iterator[tuple]) -> Iterator[tuple[int, list[Tree]]]:
            held: dict[int, list[tuple]] = {}
            for m, block in rows:
                held.setdefault(m, []).append(block)
            for m, found in held.items():
                found.sort(key=lambda block: block[:2])
                parts: dict[int, list[_Block]] = {}
                for part, _, *block in found:
                    parts.setdefault(part, []).append(_Block(*block, odds[m]))
                yield m, self._grow_here(parts, widths)

        grown = dict(blocks.mapPartitionsWithIndex(own).partitionBy(len(place), place.get).mapPartitions(grow).collect()) if place else {}
        return [grown.get(m, []) for m in range(len(alive))]

    def _grow_here(self, parts: dict[int, list[_Block]], widths: list[int]) -> list[Tree]:
        """The trees of one model; a part's sums are added up on their own, as a task of :meth:`_grow_by_levels` does it."""
        blocks = [block for own in parts.values() for block in own]

        def level(known: list[tuple] | None, trees: list[Tree], wanted: list[tuple[int, int]], level: int) -> tuple[list[Split], list[tuple]]:
            last, own = level == self.depth, widths[:1] if level == self.depth else widths
            slots = np.full(len(trees[0].feature), -1, np.int32)
            for slot, (_, node) in enumerate(wanted):
                slots[node] = slot
            rows = [((0, split.fewer), (-1, sums[:, : sum(own)])) for split, sums in known or [] if sums is not None]
            for block in blocks:
                block.descend(trees[0]) if level else block.begin()
            for part, held in parts.items():
                total = np.zeros((3, len(wanted), sum(own)))
                for block in held:
                    block.add(total, slots, own)
                rows += [(key, (part, total[:, slot])) for slot, key in enumerate(wanted) if total[2, slot].any()]
            known = list(_met(iter(rows), own, last, self.l2, self.least_rows))
            return [split for split, _ in known], known

        grown: list[Tree] = []
        while len(grown) < self.rounds and (not grown or grown[-1].feature[0] >= 0):
            (tree,) = self._round(level, np.ones(1, bool))
            for block in blocks:
                block.end(tree)
            grown.append(tree)
        return grown

    def _grow_by_levels(self, blocks, odds: np.ndarray, alive: np.ndarray, widths: list[int]) -> list[list[Tree]]:
        """The trees of all models, a job for each level of all models' current trees."""
        alive, models = alive.copy(), len(alive)

        def level(known, trees: list[Tree], wanted: list[tuple[int, int]], level: int) -> tuple:
            nodes = self._level(state, known, trees, wanted, level, widths)
            splits = nodes.keys().collect()
            if known is not None:
                known.unpersist()
            return splits, nodes

        state = blocks.map(_unpack).map(lambda b: (*b[:3], b[3] + odds[:, None])).persist(StorageLevel.MEMORY_AND_DISK)
        grown: list[list[Tree]] = [[] for _ in range(models)]
        old = None
        for number in range(self.rounds):
            if not alive.any():
                break
            trees = self._round(level, alive)
            if old is not None:
                old.unpersist()
            for m in np.flatnonzero(alive):
                grown[m].append(trees[m])
                # A tree without a split that changes nothing ends the model.
                alive[m] = trees[m].feature[0] >= 0
            old, state = state, state.map(lambda b, t=trees: _moved(b, t, self.depth)).persist(StorageLevel.MEMORY_AND_DISK)
            if (number + 1) % CHECKPOINT_ROUNDS == 0:
                state.checkpoint()
        for held in (old, state):
            if held is not None:
                held.unpersist()
        return grown

    def _round(self, grow_level, alive: np.ndarray) -> list[Tree]:
        """The next tree of every model that is alive; the others get a tree of one empty leaf."""
        trees = [Tree.leaf(self.depth) for _ in alive]
        wanted = [(m, 0) for m in np.flatnonzero(alive).tolist()]
        known = None
        for level in range(self.depth + 1):
            if not wanted:
                break
            splits, known = grow_level(known, trees, wanted, level)
            wanted = []
            for split in splits:
                m, node = split.model, split.node
                trees[m].value[node] = -self.step * split.gradient / (split.hessian + self.l2 + 1e-300)
                trees[m].cover[node] = split.hessian
                if split.feature >= 0:
                    trees[m].feature[node], trees[m].bin[node] = split.feature, split.bin
                    wanted.append((m, split.fewer))
            wanted.sort()
        if hasattr(known, "unpersist"):
            known.unpersist()
        return trees

    def _level(self, state, known, trees: list[Tree], wanted: list[tuple[int, int]], level: int, widths: list[int]):
        """(split, sums) of the wanted nodes and, below the root, of their siblings."""
        l2, least_rows, last = self.l2, self.least_rows, level == self.depth
        if last:
            widths = widths[:1]
        rows = state.mapPartitionsWithIndex(lambda part, blocks: _sums(part, blocks, trees, wanted, level, widths))
        if known is not None:
            size = sum(widths)
            parents = known.filter(lambda n: n[1] is not None).map(lambda n: ((n[0].model, n[0].fewer), (-1, n[1][:, :size])))
            rows = rows.union(parents)
        place = {key: i for i, key in enumerate(wanted)}
        dealt = rows.partitionBy(min(len(wanted), state.getNumPartitions()), lambda key: place[key])
        return dealt.mapPartitions(lambda own: _met(own, widths, last, l2, least_rows)).persist(StorageLevel.MEMORY_AND_DISK)
