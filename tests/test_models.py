"""Model selection against plain computations and on tables whose informative features are known."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from tickloom.operators import validation
from tickloom.plans import models, trees


@pytest.fixture(scope="module")
def table(spark):
    df = models.classification_data(spark, 6, 2, 2, 400, seed=3)
    return df, [c for c in df.columns if c[:2] in ("I_", "R_", "N_")]


def plain_split(x, y, w):
    """Best cut of one feature by trying each."""

    def entropy(m):
        p = np.array([w[m & (y == c)].sum() for c in (0, 1)])
        p = p[p > 0]
        return -(p * np.log2(p / p.sum())).sum()

    every = np.ones(len(x), bool)
    return max((entropy(every) - entropy(x <= c) - entropy(x > c), -c) for c in np.unique(x)[:-1])


def test_best_split():
    rng = np.random.default_rng(0)
    x, y, w = rng.integers(0, trees.BINS, (300, 2)), rng.integers(0, 2, 300), rng.random(300)
    x[:, 1] = np.clip(x[:, 1] + 9 * y, 0, trees.BINS - 1)
    hist = np.zeros((2, trees.BINS, 2))
    for f in range(2):
        np.add.at(hist[f], (x[:, f], y), w)
    gain, f, cut = trees.best_split(hist, 0.0)
    want = [plain_split(x[:, i], y, w) for i in range(2)]
    assert gain == pytest.approx(max(want)[0]) and f == 1 and cut == -want[1][1]
    assert trees.best_split(hist, 1e9) is None and trees.best_split(hist * [1, 0], 0.0) is None


def test_bag_weights():
    pos = np.arange(200_000)
    w = trees.bag_weights(pos, 5, 1.0)
    assert w.mean() == pytest.approx(1.0, abs=0.02) and (w == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)
    assert (trees.bag_weights(pos[::-1], 5, 1.0)[::-1] == w).all() and (trees.bag_weights(pos, 6, 1.0) != w).any()


def test_one_tree_against_plain_growth(spark):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 12, (200, 3)).astype(float), rng.integers(0, 2, 200)
    y[x[:, 2] > 6] = 1
    df = models.assemble(spark.createDataFrame([(i, *map(float, r), int(c), 1.0) for i, (r, c) in enumerate(zip(x, y))], "pos long, a double, b double, c double, label int, weight double"), ["a", "b", "c"])
    est = trees.Trees(1, balance="none", depth=2, seed=4)
    got = {r.pos: r.p1 for r in est.fit(df.repartition(5)).transform(df).select("pos", "p1").collect()}
    bag = trees.bag_weights(np.arange(200), 4 * 1_000_003, 1.0)

    def grow(rows, depth):
        w = bag[rows]
        p = (w * y[rows]).sum() / w.sum()
        best = max((plain_split(x[rows, f], y[rows], w), -f) for f in range(3) if len(np.unique(x[rows, f])) > 1) if 0 < p < 1 and depth else None
        if best is None or best[0][0] <= 1e-9:
            return lambda r: p
        f, cut = -best[1], -best[0][1]
        low, high = grow(rows[x[rows, f] <= cut], depth - 1), grow(rows[x[rows, f] > cut], depth - 1)
        return lambda r: (low if r[f] <= cut else high)(r)

    tree = grow(np.flatnonzero(bag > 0), 2)
    assert [got[i] for i in range(200)] == pytest.approx([tree(x[i]) for i in range(200)])


def test_importance_ranks_features(spark, table):
    df, names = table
    for method in ("MDI", "MDA", "SFI"):
        got, oob, oos = models.feature_importance(df, names, 20, 3, method=method, seed=1)
        mean = {r.feature: r["mean"] for r in got.collect()}
        assert set(mean) == set(names) and 0.5 < oob <= 1 and 0.5 < oos <= 1
        assert max(mean, key=mean.get)[0] != "N"
        chart = models.importance_chart(got, oob, oos, method).orderBy("place").collect()
        assert [r.place for r in chart] == list(range(6)) and chart[-1].feature == max(mean, key=mean.get)
        assert {r.baseline for r in chart} == {1 / 6 if method == "MDI" else None}
    with pytest.raises(ValueError):
        models.feature_importance(df, names, 2, 2, method="other")
    shares = {r.type: r.importance for r in models.importance_experiment(spark, 4, 2, 1, 5, 200, 2, ("MDI",)).collect()}
    assert sum(shares.values()) == pytest.approx(1.0)


def test_ensembles(spark, table):
    df, names = table
    whole = models.assemble(df, names)
    for est in (models.random_forest(10), models.bagging(10, 0.8, 0.5), models.Boosting(rounds=5)):
        told = models.predict(est.fit(whole), whole)
        assert told.count() == 400 and models.score(told, "accuracy") > 0.6
        assert told.where("p1 < 0 or p1 > 1 or p1 is null").count() == 0
    few = models.bagging(30, 1.0, 0.34).fit(whole)
    assert all(len(set(t.feature) - {-1}) <= 2 and len(t.columns) == 2 for t in few.trees) and len({tuple(t.columns) for t in few.trees}) > 3
    with pytest.raises(ValueError):
        models.cross_validate(models.random_forest(2), whole, "other")


def test_cross_validation_is_the_fold_by_fold_loop(spark, table):
    df, names = table
    whole = models.assemble(df, names)
    est = models.bagging(5, seed=2)
    together = models.cross_validate(est, whole, "accuracy", 3)
    splits = validation.purged_kfold(whole.select("pos", "t0", "t1"), 3)
    for k in range(3):
        train, test = models._parts(whole, splits, k)
        alone = models.score(models.predict(est.fit(train), test), "accuracy")
        assert together[k] == pytest.approx(alone, abs=0.06)  # cuts between bins are of all rows, not of the fold's


def test_search_and_bagging(spark, table):
    df, names = table
    whole = models.assemble(df, names)
    model, best, told = models.search(whole, lambda reg: LogisticRegression(labelCol="label", weightCol="weight", regParam=reg), {"reg": [0.001, 100.0]}, 2, bagging=(3, 0.7, 0.5))
    assert told.count() == 2 and best["reg"] == 0.001 and len(model.models) == 3 and all(len(c) == 3 for c, _ in model.models)
    out = models.predict(model, whole)
    assert set(whole.columns) <= set(out.columns) and models.score(out, "accuracy") > 0.6
    with pytest.raises(ValueError):
        models.bag(models.random_forest(1), whole, 0)


def test_weights_reach_the_last_step(spark, table):
    df, names = table
    whole = models.assemble(df, names)
    one = whole.withColumn("weight", F.col("label").cast("double"))
    told = models.predict(models.weighted_pipeline(LogisticRegression()).fit(one), whole)
    assert told.where("p1 < 0.99").count() == 0  # rows of label 0 weigh nothing
    with pytest.raises(ValueError):
        models.weighted_pipeline()


def test_permutation_keeps_values(spark):
    df = spark.range(50).select(F.col("id").alias("pos"), (F.col("id") * 2).alias("x"))
    got = models.permuted(df, "x", 1).collect()
    assert sorted(r.x for r in got) == list(range(0, 100, 2)) and all(r.x != 2 * r.pos for r in got)
