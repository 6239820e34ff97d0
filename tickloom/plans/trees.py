"""Bagged entropy trees, grown a level at a time for all trees and all folds in one pass over the data.

Features are cut into at most ``BINS`` bins at approximate quantiles. A row's bootstrap
weight in a tree is a Poisson number drawn from a hash of its ``pos`` and the tree, so
that a lost task draws it again and rows that a tree left out are known. Each pass sums
(tree, node, feature, bin, class) weights within partitions, then by node; only the
chosen splits reach the driver. Nulls and NaN go to the last bin.

Rows: pos long, label 0/1, weight double and a vector ``features``. Trees of different
folds see the rows that train in their fold; the histograms of a pass are bounded by
``HELD`` bytes, and more nodes take more passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.contracts import require
from tickloom.operators.joins import with_position
from tickloom.storage import materialise

BINS = 32
HELD = 48 << 20


def _uniform(pos: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in [0, 1) from row numbers and a seed (rounds of multiply and shift)."""
    x = pos.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(float) / 2.0**53


def bag_weights(pos: np.ndarray, seed: int, sample: float) -> np.ndarray:
    """Poisson numbers of mean ``sample``."""
    steps = np.cumsum([math.exp(-sample) * sample**k / math.factorial(k) for k in range(30)])
    return np.searchsorted(steps, _uniform(pos, seed), side="right").astype(float)


@dataclass
class Tree:
    fold: int  # -1: all rows
    columns: np.ndarray  # features that it may use
    seed: int
    item: int = 0  # models of one fold
    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])  # bins up to this one go left
    left: list[int] = field(default_factory=lambda: [0])
    p1: list[float] = field(default_factory=lambda: [0.5])
    total: float = 0.0
    balance: tuple[float, float] = (1.0, 1.0)
    gain: dict[int, float] = field(default_factory=dict)

    def packed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.feature), np.array(self.cut), np.array(self.left), np.array(self.p1)


def _leaves(packed: tuple, bins: np.ndarray) -> np.ndarray:
    feature, cut, left, _ = packed
    node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while True:
        f = feature[node]
        if (f < 0).all():
            return node
        node = np.where(f < 0, node, left[node] + (bins[rows, np.maximum(f, 0)] > cut[node]))


def _batch(batch: pa.RecordBatch, column: str = "bins") -> tuple[np.ndarray, ...]:
    get = lambda c: batch.column(batch.schema.get_field_index(c))
    bins = np.frombuffer(b"".join(get(column).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    return (bins, *(get(c).to_numpy(zero_copy_only=False) for c in ("pos", "label", "weight", "train", "test")))


@dataclass
class Ensemble:
    """Fitted trees; ``cuts`` are the values between the bins of each feature."""

    trees: list[Tree]
    cuts: list[np.ndarray]
    sample: float

    def chance(self, bins: np.ndarray, fold: int = -1, item: int = 0) -> np.ndarray:
        """Mean share of label 1 in the leaves of one model's trees."""
        votes = [x[3][_leaves(x, bins)] for x in (t.packed() for t in self.trees if (t.fold, t.item) == (fold, item))]
        return np.mean(votes, axis=0) if votes else np.full(len(bins), 0.5)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` plus prediction and p1."""
        shared = df.sparkSession.sparkContext.broadcast(self)
        names = [c for c in df.columns if c != "features"]
        source = df.select(*names, vector_to_array("features").alias("features"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for b in batches:
                if b.num_rows:
                    p = model.chance(binned(b.column(len(names)).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), model.cuts))
                    yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array((p > 0.5).astype(float)), pa.array(p)], [*names, "prediction", "p1"])

        kinds = [f for f in source.schema.fields if f.name != "features"]
        return source.mapInArrow(run, T.StructType([*kinds, T.StructField("prediction", T.DoubleType()), T.StructField("p1", T.DoubleType())]))

    def importances(self) -> np.ndarray:
        """Share of each feature in a tree's decrease of impurity: trees x features; a tree without a split has none."""
        out = np.zeros((len(self.trees), len(self.cuts)))
        for row, tree in zip(out, self.trees, strict=True):
            for f, g in tree.gain.items():
                row[f] += g
        return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-300)


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], axis=1).astype(np.uint8) if cuts else np.zeros((len(x), 0), np.uint8)


def entropy(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Entropy of two classes times their weight."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return -sum(np.nan_to_num(x * np.log2(x / (a + b))) for x in (a, b))


def best_split(hist: np.ndarray, least: float) -> tuple[float, int, int] | None:
    """(gain, row, bin) of the best cut of a (features, bins, classes) histogram with ``least`` weight on either side."""
    low = np.cumsum(hist, axis=1)[:, :-1]
    high = hist.sum(axis=1, keepdims=True) - low
    whole = hist[0].sum(axis=0)
    gain = entropy(whole[0], whole[1]) - entropy(low[..., 0], low[..., 1]) - entropy(high[..., 0], high[..., 1])
    gain = np.where((low.sum(axis=2) > least) & (high.sum(axis=2) > least), gain, -1.0)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return (float(gain[f, b]), int(f), int(b)) if gain[f, b] > 1e-9 else None


def prepare(df: DataFrame, splits: DataFrame | None = None) -> tuple[DataFrame, list[np.ndarray]]:
    """The binned rows, written once, and the cuts. ``train`` and ``test`` are bits of the splits (split, pos, role)."""
    wide = df.select("pos", F.col("label").cast("int").alias("label"), F.col("weight").cast("double").alias("weight"), vector_to_array("features").alias("x"))
    size = wide.select(F.max(F.size("x"))).first()[0] or 0
    shares = [i / BINS for i in range(1, BINS)]
    solid = lambda i: F.nanvl(F.get("x", F.lit(i)), F.lit(None).cast("double"))
    row = wide.agg(*(F.percentile_approx(solid(i), shares, 2000).alias(str(i)) for i in range(size))).first() if size else []
    cuts = [np.unique(np.array(x if x is not None else [], float)) for x in row]
    if splits is None:
        wide = wide.withColumns({"train": F.lit(0).cast("long"), "test": F.lit(0).cast("long")})
    else:
        bit = F.expr("shiftleft(1L, split)")
        role = lambda r: F.coalesce(F.bit_or(F.when(F.col("role") == r, bit)), F.lit(0).cast("long")).alias(r)
        wide = wide.join(splits.groupBy("pos").agg(role("train"), role("test")), "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = binned(b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), cuts)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([r.tobytes() for r in x], pa.binary()), *b.columns[4:]], ["pos", "label", "weight", "bins", "train", "test"])

    return materialise(wide.mapInArrow(run, "pos long, label int, weight double, bins binary, train long, test long"), "binned"), cuts


@dataclass
class Trees:
    """Estimator. ``per_tree``: share of features drawn for a tree; ``per_node``: "all", "sqrt", "1" or a number drawn for a
    node. ``balance``: "balanced" weighs classes alike over the rows, "subsample" over a tree's own sample."""

    trees: int = 1000
    sample: float = 1.0
    per_tree: float = 1.0
    per_node: str | int = "all"
    balance: str = "balanced"
    min_leaf: float = 0.0
    depth: int = 5
    seed: int = 0

    def specs(self, features: list[int], fold: int = -1, item: int = 0) -> list[Tree]:
        out = []
        for i in range(self.trees):
            seed = self.seed * 1_000_003 + i
            many = max(1, round(self.per_tree * len(features)))
            out.append(Tree(fold, np.sort(np.random.default_rng([1, seed]).choice(features, many, replace=False)), seed, item))
        return out

    def fit(self, df: DataFrame) -> Ensemble:
        rows, cuts = prepare(df)
        return self.grow(rows, cuts, self.specs(list(range(len(cuts)))))

    def grow(self, rows: DataFrame, cuts: list[np.ndarray], trees: list[Tree]) -> Ensemble:
        require(bool(cuts) and all(len(t.columns) for t in trees), "trees need features")
        self._weigh(rows, trees)
        frontier = [(t, 0) for t, x in enumerate(trees) if 0 < x.p1[0] < 1]
        for _ in range(self.depth):
            found, group, held = [], [], 0
            for t, node in frontier:
                group.append((t, node))
                held += len(trees[t].columns) * BINS * 16
                if held > HELD:
                    found, group, held = found + self._splits(rows, trees, group), [], 0
            found += self._splits(rows, trees, group) if group else []
            frontier = []
            for r in sorted(found):
                t, node, gain, f, b, *sides = r
                tree = trees[t]
                tree.feature[node], tree.cut[node], tree.left[node] = f, b, len(tree.feature)
                tree.gain[f] = tree.gain.get(f, 0.0) + gain
                for a, c in (sides[:2], sides[2:]):
                    frontier += [(t, len(tree.feature))] if a > 0 and c > 0 else []
                    tree.feature.append(-1)
                    tree.cut.append(0)
                    tree.left.append(0)
                    tree.p1.append(c / (a + c))
        return Ensemble(trees, cuts, self.sample)

    def _used(self, tree: Tree, pos, label, weight, train) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows that a tree sees, their bootstrap numbers and their weights."""
        rows = np.arange(len(pos)) if tree.fold < 0 else np.flatnonzero((train >> tree.fold) & 1)
        bag = bag_weights(pos[rows], tree.seed, self.sample)
        rows, bag = rows[bag > 0], bag[bag > 0]
        return rows, bag, weight[rows] * bag

    def _weigh(self, rows: DataFrame, trees: list[Tree]) -> None:
        """Class balance and root of each tree: a row of sums a tree."""
        shared = rows.sparkSession.sparkContext.broadcast((self, trees))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            est, specs = shared.value
            sums = np.zeros((len(specs), 3, 2))  # rows, bootstrap rows, weights by class
            for b in batches:
                _, pos, label, weight, train, _ = _batch(b)
                for t, tree in enumerate(specs):
                    mine, bag, w = est._used(tree, pos, label, weight, train)
                    every = np.arange(len(pos)) if tree.fold < 0 else np.flatnonzero((train >> tree.fold) & 1)
                    sums[t] += [np.bincount(label[every], minlength=2), np.bincount(label[mine], bag, 2), np.bincount(label[mine], w, 2)]
            flat = sums.reshape(len(specs), 6)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(specs))), *(pa.array(flat[:, i]) for i in range(6))], ["t", *"abcdef"])

        sums = rows.mapInArrow(run, "t long, a double, b double, c double, d double, e double, f double").groupBy("t").agg(*(F.sum(c).alias(c) for c in "abcdef"))
        for r in sums.collect():  # a row a tree
            tree, counts = trees[r["t"]], ((r["a"], r["b"]) if self.balance == "balanced" else (r["c"], r["d"]))
            if self.balance in ("balanced", "subsample"):
                tree.balance = tuple(sum(counts) / (2 * c) if c else 1.0 for c in counts)
            w0, w1 = r["e"] * tree.balance[0], r["f"] * tree.balance[1]
            tree.total, tree.p1[0] = w0 + w1, w1 / (w0 + w1) if w0 + w1 > 0 else 0.5

    def _splits(self, rows: DataFrame, trees: list[Tree], group: list[tuple[int, int]]) -> list[tuple]:
        """(tree, node, gain, feature, bin, weights left by class, right by class) of the nodes that can be split."""
        spark = rows.sparkSession
        slots: dict[int, np.ndarray] = {}
        for t, node in group:
            mine = slots.setdefault(t, np.full(len(trees[t].feature), -1))
            mine[node] = np.count_nonzero(mine >= 0)
        shared = spark.sparkContext.broadcast((self, trees, slots))

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            est, specs, at = shared.value
            held = {t: np.zeros(int((x >= 0).sum()) * len(specs[t].columns) * BINS * 2) for t, x in at.items()}
            for b in batches:
                bins, pos, label, weight, train, _ = _batch(b)
                for t, out in held.items():
                    tree = specs[t]
                    mine, _, w = est._used(tree, pos, label, weight, train)
                    slot = at[t][_leaves(tree.packed(), bins[mine])]
                    mine, w, slot = mine[slot >= 0], w[slot >= 0], slot[slot >= 0]
                    y, many = label[mine], len(tree.columns)
                    w = w * np.array(tree.balance)[y]
                    place = ((slot[:, None] * many + np.arange(many)) * BINS + bins[mine][:, tree.columns]) * 2 + y[:, None]
                    out += np.bincount(place.ravel(), np.repeat(w, many), len(out))
            for t, out in held.items():
                nodes = np.flatnonzero(at[t] >= 0)
                parts = out.reshape(len(nodes), -1)[at[t][nodes]]
                some = np.flatnonzero(parts.any(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), t)), pa.array(nodes[some]), pa.array([parts[i].tobytes() for i in some], pa.binary())], ["t", "node", "hist"])

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            est, specs, _ = shared.value
            total: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                for t, node, hist in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    part = np.frombuffer(hist)
                    total[t, node] = total[t, node] + part if (t, node) in total else part
            out = []
            for (t, node), hist in total.items():
                tree = specs[t]
                hist = hist.reshape(len(tree.columns), BINS, 2)
                drawn = np.sort(np.random.default_rng([2, tree.seed, node]).permutation(len(hist))[: est.node_features(len(tree.columns))])
                found = best_split(hist[drawn], est.min_leaf * tree.total)
                if found:
                    gain, f, cut = found
                    low = hist[drawn[f], : cut + 1].sum(axis=0)
                    high = hist[drawn[f], cut + 1 :].sum(axis=0)
                    out.append({"t": t, "node": node, "gain": gain, "f": int(tree.columns[drawn[f]]), "cut": cut, "a": low[0], "b": low[1], "c": high[0], "d": high[1]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("t", pa.int64()), ("node", pa.int64()), ("gain", pa.float64()), ("f", pa.int64()), ("cut", pa.int64()), *((c, pa.float64()) for c in "abcd")]))

        parts = rows.mapInArrow(sums, "t long, node long, hist binary").repartition("t", "node")
        done = parts.mapInArrow(choose, "t long, node long, gain double, f long, cut long, a double, b double, c double, d double")
        return [tuple(r) for r in done.collect()]  # a row a node

    def node_features(self, n: int) -> int:
        return n if self.per_node == "all" else max(1, int(math.sqrt(n))) if self.per_node == "sqrt" else min(n, int(self.per_node))


def out_of_bag(model: Ensemble, rows: DataFrame) -> float:
    """Accuracy over the rows that some tree's sample left out, by the mean of those trees."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for b in batches:
            bins, pos, label, *_ = _batch(b)
            votes, known = np.zeros(len(pos)), np.zeros(len(pos))
            for tree in (t for t in fitted.trees if t.fold < 0):
                left_out = bag_weights(pos, tree.seed, fitted.sample) == 0
                packed = tree.packed()
                votes[left_out] += packed[3][_leaves(packed, bins[left_out])]
                known += left_out
            some = known > 0
            right = (votes[some] / known[some] > 0.5) == (label[some] == 1)
            yield pa.RecordBatch.from_arrays([pa.array([int(some.sum())]), pa.array([int(right.sum())])], ["n", "right"])

    row = rows.mapInArrow(run, "n long, right long").agg(F.sum("n").alias("n"), F.sum("right").alias("r")).first()
    return row["r"] / row["n"] if row["n"] else 0.0


_PREDICTED = "split int, item int, label int, weight double, prediction double, p1 double"


def predict_folds(model: Ensemble, rows: DataFrame, folds: int, items: int = 1) -> DataFrame:
    """(split, item, label, weight, prediction, p1): each row in each split that tests it, by each of that split's ``items`` models."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for b in batches:
            bins, _, label, weight, _, test = _batch(b)
            for k in range(folds):
                mine = np.flatnonzero((test >> k) & 1)
                for item in range(items if len(mine) else 0):
                    yield _scored(k, item, label[mine], weight[mine], fitted.chance(bins[mine], k, item))

    return rows.mapInArrow(run, _PREDICTED)


def _scored(k: int, item: int, label: np.ndarray, weight: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
    n = len(label)
    columns = [pa.array(np.full(n, k, np.int32)), pa.array(np.full(n, item, np.int32)), pa.array(label.astype(np.int32)), pa.array(weight), pa.array((p > 0.5).astype(float)), pa.array(p)]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _PREDICTED.split(", ")])


def predict_permuted(model: Ensemble, rows: DataFrame, folds: int, features: int, seed: int = 0) -> DataFrame:
    """``predict_folds`` with item 0 as it is and item i + 1 with feature i taken from another test row of the split: the
    next one in a random order, so each value is used once."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    split = F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: F.getbit("test", k) == 1))
    tested = rows.withColumn("k", split)
    placed = with_position(tested.withColumn("h", F.xxhash64("pos", F.lit(seed))), ["k", "h", "pos"], name="q")
    sizes = placed.groupBy("k").agg(F.min("q").alias("first"), F.count("*").alias("n"))
    placed = placed.join(F.broadcast(sizes), "k").withColumn("from", F.col("first") + F.pmod(F.col("q") - F.col("first") + 1, F.col("n")))
    both = placed.join(placed.select(F.col("q").alias("from"), F.col("bins").alias("other")), "from").select("pos", "label", "weight", "bins", "train", "test", "other", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for b in batches:
            bins, _, label, weight, _, _ = _batch(b)
            other, split = _batch(b, "other")[0], b.column(7).to_numpy()
            for k in np.unique(split):
                mine = np.flatnonzero(split == k)
                x = bins[mine].copy()
                yield _scored(int(k), 0, label[mine], weight[mine], fitted.chance(x, int(k)))
                for i in range(features):
                    kept = x[:, i].copy()
                    x[:, i] = other[mine, i]
                    yield _scored(int(k), i + 1, label[mine], weight[mine], fitted.chance(x, int(k)))
                    x[:, i] = kept

    return both.mapInArrow(run, _PREDICTED)
