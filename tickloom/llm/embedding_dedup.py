"""Operator 2: near-duplicate embeddings by a random-projection tree forest.

Each tree splits unit vectors recursively by random directions; a vector within
``margin`` of a split goes to both sides (spill). Two vectors of cosine 0.98 are at most
0.2 apart, and so their projections differ by 0.2 times a number of deviation
1/sqrt(dimensions); the margin covers 1.5 deviations on either side, so a split parts a
pair at the limit with a probability under 1 %, and closer ones less. Trees are
independent, so a pair is missed only if every tree parts it.

Vectors of each length have a forest of their own. Its splits are medians of a bounded
sample (``sample`` vectors, those of the least id hashes), its depth follows the size of
the largest label, as far as the sample can be halved; where one leaf holds them all, one
tree is enough. Every vector is indexed. Vectors are compared within leaves of one label,
in blocks of at most ``block`` rows; a leaf grown large is cut into pairs of blocks, so no
task holds a whole large leaf. A pair counts only in the first leaf that both vectors
share; blocks return sums and spanning edges, not pairs.

Equal vectors of a label form one class with a multiplicity. Vectors that are null, zero
or hold null or non-finite components, and rows with a null label or id, link with
nothing. Vectors of different lengths aren't compared. Rows that repeat an id and its
vector count as separate rows of one vertex.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import common


class Forest:
    """Trees as heaps: node i has children 2i+1 and 2i+2; all leaves are ``depth`` deep."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, margin: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.trees, self.depth, self.margin = trees, depth, margin
        inner, dims = (1 << depth) - 1, sample.shape[1]
        self.directions = rng.standard_normal((trees, inner, dims)).astype(np.float32)
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        self.cuts = np.zeros((trees, inner))
        for t in range(trees):
            inside = {0: np.arange(len(sample))}
            for node in range(inner):
                rows = inside.pop(node)
                shade = sample[rows] @ self.directions[t, node].astype(float)
                self.cuts[t, node] = np.median(shade) if len(rows) else 0.0
                if 2 * node + 2 < inner:
                    inside[2 * node + 1], inside[2 * node + 2] = rows[shade <= self.cuts[t, node]], rows[shade > self.cuts[t, node]]

    def leaves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf of every tree that a row reaches; leaf numbers differ between trees."""
        found = []
        for t in range(self.trees):
            row, node = np.arange(len(unit)), np.zeros(len(unit), np.int64)
            for _ in range(self.depth):
                shade = np.einsum("ij,ij->i", unit[row], self.directions[t, node].astype(float)) - self.cuts[t, node]
                left, right = shade <= self.margin, shade > -self.margin
                row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
            found.append((row, node + (np.int64(t) << 32)))
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def _least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            return label


def _compare(table: pa.Table, cosine: float) -> pa.Table:
    """One block pair: how many rows each class links with, for pairs that belong to this leaf, and spanning edges."""
    cid = table["cid"].to_numpy()
    mult = table["mult"].to_numpy()
    side = table["side"].to_numpy()
    leaf = table["leaf"][0].as_py()
    flat = table["vector"].combine_chunks().flatten().to_numpy().astype(np.float64)
    x = flat.reshape(len(cid), -1)
    size = np.sqrt((x * x).sum(axis=1))
    paths = table["leaves"].combine_chunks()
    counts = np.diff(paths.offsets.to_numpy())
    path = np.full((len(cid), max(counts)), np.iinfo(np.int64).max)
    path[np.repeat(np.arange(len(cid)), counts), np.concatenate([np.arange(c) for c in counts])] = paths.flatten().to_numpy()
    a, b = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if (side == 1).any() else (np.flatnonzero(side == 0),) * 2
    same = not (side == 1).any()
    total = np.zeros(len(cid), np.int64)
    links: list[tuple[np.ndarray, np.ndarray]] = []
    for start in range(0, len(a), 256):
        rows = a[start : start + 256]
        near = (x[rows] @ x[b].T) / (size[rows][:, None] * size[b][None, :]) >= cosine
        i, j = np.nonzero(near)
        i, j = rows[i], b[j]
        if same:
            i, j = i[i < j], j[i < j]
        links.append((i, j))
        for k in range(0, len(i), 20_000):
            p, q = i[k : k + 20_000], j[k : k + 20_000]
            earlier = ((path[p][:, :, None] == path[q][:, None, :]) & (path[p] < leaf)[:, :, None]).any(axis=(1, 2))
            p, q = p[~earlier], q[~earlier]
            np.add.at(total, p, mult[q])
            np.add.at(total, q, mult[p])
    i, j = (np.concatenate([x[k] for x in links]) if links else np.zeros(0, np.int64) for k in (0, 1))
    label = _least_labels(len(cid), i, j)
    linked = np.unique(np.concatenate([i, j]))
    return pa.table({"cid": pa.array(cid[linked], pa.int64()), "n": pa.array(total[linked], pa.int64()), "root": pa.array(cid[label[linked]], pa.int64())})


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, trees: int = 6, leaf: int = 1024, block: int = 1024, sample: int = 20_000) -> DataFrame:
    """One row a row: ``id_col``, ``n_links`` long, ``component_id`` long, ``kept`` boolean."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    good = F.col("label").isNotNull() & F.col("id").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    # Sums of squares must be neither 0 nor infinite: scale by the largest component, which leaves cosines as they are.
    rows = rows.withColumn("good", good)
    sound = rows.where("good").select("id", "label", "v")
    classes = common.materialise(sound.groupBy("label", "v").agg(F.min("id").alias("cid"), F.count("*").alias("mult")), "vector-classes")
    by_size = classes.groupBy("label", F.size("v").alias("dims")).agg(F.count("*").alias("n")).groupBy("dims").agg(F.max("n").alias("n"))

    def forest(dims: int, largest: int) -> Forest:
        depth = min(max(0, math.ceil(math.log2(max(1, largest) / leaf))), int(math.log2(sample)))
        if not depth:
            return Forest(np.zeros((0, dims)), 1, 0, 0.0)
        drawn = classes.where(F.size("v") == dims).select("v").orderBy(F.xxhash64("cid"), "cid").limit(sample)
        unit = np.array([v for (v,) in drawn.toLocalIterator()], float)
        unit = unit / np.abs(unit).max(axis=1, keepdims=True)
        reach = math.sqrt(max(0.0, 2 - 2 * cosine))
        return Forest(unit / np.linalg.norm(unit, axis=1, keepdims=True), trees, depth, 1.5 * reach / math.sqrt(dims))

    shared = spark.sparkContext.broadcast({r["dims"]: forest(r["dims"], r["n"]) for r in by_size.collect()})  # a row a length

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                vectors = common.column(batch, "v")
                lengths = vectors.value_lengths().to_numpy()
                for dims in np.unique(lengths):
                    mine = np.flatnonzero(lengths == dims)
                    part = batch.take(pa.array(mine))
                    x = common.column(part, "v").flatten().to_numpy().reshape(len(mine), -1)
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    row, found = shared.value[int(dims)].leaves(x / np.linalg.norm(x, axis=1, keepdims=True))
                    order = np.lexsort((found, row))
                    row, found = row[order], found[order]
                    counts = np.bincount(row, minlength=len(mine))
                    lists = common.list_array(found, counts, pa.int64())
                    yield pa.RecordBatch.from_arrays([common.column(part, "cid"), common.column(part, "mult"), common.column(part, "label"), common.list_array(x.ravel(), np.full(len(mine), dims), pa.float64()), lists], ["cid", "mult", "label", "vector", "leaves"])

    kind = classes.schema["label"].dataType.simpleString()
    routed = common.arrow_map(classes, route, f"cid long, mult long, label {kind}, vector array<double>, leaves array<long>")
    routed = common.materialise(routed.withColumn("dims", F.size("vector")), "vector-leaves")
    spread = routed.select("*", F.explode("leaves").alias("leaf"))
    counts = routed.select("label", "dims", F.explode("leaves").alias("leaf")).groupBy("label", "dims", "leaf").agg(F.count("*").alias("m")).where("m > 1")
    told = spread.join(counts, ["label", "dims", "leaf"]).withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    mine = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j"), F.when(F.col("own") > o, 1).otherwise(0).alias("side")))
    dealt = told.withColumn("own", mine).select("*", F.explode(pairs).alias("p")).select("cid", "mult", "label", "dims", "leaf", "vector", "leaves", "p.i", "p.j", "p.side")
    found = dealt.groupBy("label", "dims", "leaf", "i", "j").applyInArrow(lambda t: _compare(t, cosine), "cid long, n long, root long")
    found = common.materialise(found, "vector-links")
    common.discard(routed)
    sums = found.groupBy("cid").agg(F.sum("n").alias("n"))
    parts = common.components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")), "vector-components")
    named = classes.join(sums, "cid", "left").join(parts, classes["cid"] == parts["id"], "left").select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component_id"))
    answer = rows.select("id", F.when(F.col("good"), F.col("label")).alias("label"), F.when(F.col("good"), F.col("v")).alias("v")).join(named, ["label", "v"], "left")
    component = F.coalesce("component_id", "id")
    return answer.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
