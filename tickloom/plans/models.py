"""Weighted, purged model selection: ensembles, scores, search and feature importance. Bagged trees are our own (module
``trees``), linear models and boosted stumps MLlib's.

Feature tables hold pos, t0, t1, label (0/1), weight and feature columns.
"""

from __future__ import annotations

import itertools
import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.contracts import require
from tickloom.functions.columns import log_uniform_at
from tickloom.operators.bars import eigen
from tickloom.operators.joins import with_position
from tickloom.operators.validation import purged_kfold
from tickloom.plans.trees import Ensemble, Trees, out_of_bag, predict_folds, predict_permuted, prepare
from tickloom.storage import materialise

RAW = ("rawPrediction", "probability", "prediction")


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(df)


def parallel(f, items: list, workers: int = 8) -> list:
    """``f`` of each item; independent Spark jobs run side by side."""
    with ThreadPoolExecutor(workers) as pool:
        return list(pool.map(inheritable_thread_target(SparkSession.active())(f), items))


def random_forest(trees: int = 1000, features: str | int = "sqrt", min_leaf: float = 0.0, seed: int = 0, depth: int = 5) -> Trees:
    """Entropy trees that draw ``features`` at each node; classes weigh alike in each tree's sample."""
    return Trees(trees, per_node=features, balance="subsample", min_leaf=min_leaf, seed=seed, depth=depth)


def bagging(trees: int = 1000, sample: float = 1.0, features: float = 1.0, min_leaf: float = 0.0, seed: int = 0, depth: int = 5, per_node: str | int = "all") -> Trees:
    """Bagged entropy trees that see a share ``features`` of the columns each; classes weigh alike."""
    return Trees(trees, sample, features, per_node, "balanced", min_leaf, depth, seed)


@dataclass
class Boosted:
    """SAMME over weighted trees."""

    trees: list[Model] = field(default_factory=list)
    shares: list[float] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        votes = None
        out = df
        for i, (tree, share) in enumerate(zip(self.trees, self.shares, strict=True)):
            out = tree.transform(out).drop("rawPrediction", "probability").withColumnRenamed("prediction", f"__p{i}")
            vote = F.when(F.col(f"__p{i}") == 1, share).otherwise(-share)
            votes = vote if votes is None else votes + vote
        p = 1 / (1 + F.exp(-2 * votes / max(sum(self.shares), 1e-12)))
        out = out.withColumn("__v", votes).withColumn("prediction", (F.col("__v") > 0).cast("double")).withColumn("p1", p)
        return out.drop("__v", *(f"__p{i}" for i in range(len(self.trees))))


@dataclass
class Boosting:
    rounds: int = 100
    rate: float = 1.0
    depth: int = 1
    seed: int = 0

    def fit(self, df: DataFrame) -> Boosted:
        out, data = Boosted(), df
        for i in range(self.rounds):
            tree = DecisionTreeClassifier(maxDepth=self.depth, weightCol="weight", labelCol="label", seed=self.seed + i).fit(data)
            told = tree.transform(data).withColumn("__wrong", F.col("prediction") != F.col("label")).drop(*RAW)
            row = told.agg(F.sum("weight").alias("w"), F.sum(F.when(F.col("__wrong"), F.col("weight")).otherwise(0.0)).alias("e")).first()
            error = row["e"] / row["w"]
            if error >= 0.5:
                break
            share = self.rate * math.log((1 - error) / max(error, 1e-10))
            out.trees.append(tree)
            out.shares.append(share)
            if error <= 1e-10:
                break
            data = told.withColumn("weight", F.when(F.col("__wrong"), F.col("weight") * math.exp(share)).otherwise(F.col("weight"))).drop("__wrong")
            if i % 10 == 9 and df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
                data = data.checkpoint()
        require(bool(out.trees), "no tree is better than chance")
        return out


def predict(model, df: DataFrame) -> DataFrame:
    """``df`` with prediction and p1, the probability of label 1."""
    out = model.transform(df)
    return out if "p1" in out.columns else out.withColumn("p1", vector_to_array("probability")[1])


def score_of(scoring: str) -> Column:
    """Weighted accuracy, negative log-loss or F1 as an aggregate over predictions."""
    w = F.col("weight")
    if scoring == "neg_log_loss":
        p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("p1")))
        value = F.sum(w * F.when(F.col("label") == 1, F.ln(p)).otherwise(F.ln(1 - p))) / F.sum(w)
    elif scoring == "accuracy":
        value = F.sum(w * (F.col("prediction") == F.col("label")).cast("double")) / F.sum(w)
    elif scoring == "f1":
        both = F.sum(w * F.col("prediction") * F.col("label"))
        value = F.try_divide(2 * both, F.sum(w * F.col("prediction")) + F.sum(w * F.col("label")))
    else:
        raise ValueError("scoring is neg_log_loss, accuracy or f1")
    return F.coalesce(value, F.lit(0.0)).alias("s")


def score(predicted: DataFrame, scoring: str) -> float:
    """One row to the driver."""
    return float(predicted.agg(score_of(scoring)).first()["s"])


def _by_fold(predicted: DataFrame, scoring: str, folds: int, items: int = 1) -> np.ndarray:
    """folds x items scores from (split, item) predictions; a row each to the driver."""
    out = np.zeros((folds, items))
    for r in predicted.groupBy("split", "item").agg(score_of(scoring)).collect():
        out[r["split"], r["item"]] = r["s"]
    return out


def _parts(df: DataFrame, splits: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Training and test rows of a split."""
    return tuple(df.join(splits.where((F.col("split") == k) & (F.col("role") == r)).select("pos"), "pos") for r in ("train", "test"))


def cross_validate(estimator, df: DataFrame, scoring: str = "neg_log_loss", folds: int = 3, embargo: float = 0.0, splits: DataFrame | None = None) -> list[float]:
    """A score for each purged fold; ``df`` has features, label, weight, pos, t0, t1. ``Trees`` grow for all folds at once;
    other estimators are fitted side by side."""
    require(scoring in ("neg_log_loss", "accuracy", "f1"), "scoring is neg_log_loss, accuracy or f1")
    splits = materialise(purged_kfold(df.select("pos", "t0", "t1"), folds, embargo), "splits") if splits is None else splits
    folds = splits.agg(F.max("split")).first()[0] + 1
    if isinstance(estimator, Trees):
        rows, cuts = prepare(df, splits)
        model = estimator.grow(rows, cuts, [t for k in range(folds) for t in estimator.specs(list(range(len(cuts))), k)])
        return _by_fold(predict_folds(model, rows, folds), scoring, folds)[:, 0].tolist()

    def one(k: int) -> float:
        train, test = _parts(df, splits, k)
        return score(predict(estimator.fit(train), test), scoring)

    return parallel(one, list(range(folds)))


def weighted_pipeline(*stages) -> Pipeline:
    """A pipeline whose last step, an estimator, gets the labels and weights of the table."""
    require(bool(stages) and stages[-1].hasParam("weightCol"), "the last step has to take weights")
    return Pipeline(stages=[*stages[:-1], stages[-1].copy({stages[-1].weightCol: "weight", stages[-1].labelCol: "label"})])


def scaled_logistic(reg: float = 0.01) -> Pipeline:
    """Scaling, then a weighted logistic regression."""
    return weighted_pipeline(StandardScaler(inputCol="features", outputCol="scaled", withMean=True), LogisticRegression(featuresCol="scaled", regParam=reg))


@dataclass
class Bagged:
    """Models of Poisson-weighted samples and shares of the features; probabilities are averaged."""

    models: list[tuple[list[int], object]]

    def transform(self, df: DataFrame) -> DataFrame:
        out, votes = df, []
        for i, (columns, model) in enumerate(self.models):
            cut = VectorSlicer(inputCol="__all", outputCol="features", indices=columns).transform(out.withColumnRenamed("features", "__all"))
            whole = (F.col("__all").alias("features") if c == "features" else F.col(c) for c in df.columns)
            out = predict(model, cut).select(*whole, *votes, F.col("p1").alias(f"__p{i}"))
            votes.append(f"__p{i}")
        p = sum((F.col(v) for v in votes), F.lit(0.0)) / len(votes)
        return out.withColumn("p1", p).withColumn("prediction", (F.col("p1") > 0.5).cast("double")).drop(*votes)


def bag(estimator, df: DataFrame, models: int, sample: float = 1.0, features: float = 1.0, seed: int = 0) -> Bagged:
    """``models`` fits of ``estimator`` on rows weighted by Poisson numbers of mean ``sample``, each on a share of the features."""
    require(models > 0 and sample > 0 and 0 < features <= 1, "models and samples must be positive")
    size = len(df.select("features").first()["features"])

    def one(i: int) -> tuple[list[int], object]:
        columns = sorted(int(x) for x in np.random.default_rng([seed, i]).choice(size, max(1, round(features * size)), replace=False))
        u = F.pmod(F.xxhash64("pos", F.lit(seed), F.lit(i)), F.lit(1 << 30)) / float(1 << 30)
        steps = np.cumsum([math.exp(-sample) * sample**k / math.factorial(k) for k in range(20)])
        times = sum(((u >= float(x)).cast("int") for x in steps), F.lit(0))
        rows = df.withColumn("weight", F.col("weight") * times).where("weight > 0").withColumnRenamed("features", "__all")
        return columns, estimator.fit(VectorSlicer(inputCol="__all", outputCol="features", indices=columns).transform(rows))

    return Bagged(parallel(one, list(range(models))))


def search(df: DataFrame, build, grid: dict[str, list] | dict[str, tuple[float, float]], folds: int = 3, embargo: float = 0.0, draws: int = 0, seed: int = 0, scoring: str | None = None, bagging: tuple[int, float, float] = (0, 0.0, 1.0)):
    """(best model fitted on all of ``df``, best parameters, table of mean scores). ``build(**parameters)`` makes an
    estimator. ``draws`` > 0: so many random points, log-uniform where a value is a (low, high) tuple. ``bagging``: number
    of models, their sample and share of features; with a positive sample the best estimator is bagged."""
    if scoring is None:
        classes = {r["label"] for r in df.select("label").distinct().limit(3).collect()}
        scoring = "f1" if classes == {0, 1} else "neg_log_loss"
    if draws:
        rng = np.random.default_rng(seed)
        pick = lambda v: log_uniform_at(v[0], v[1], rng.random()) if isinstance(v, tuple) else v[int(rng.integers(len(v)))]
        points = [{k: pick(v) for k, v in grid.items()} for _ in range(draws)]
    else:
        points = [dict(zip(grid, v, strict=True)) for v in itertools.product(*grid.values())]
    splits = materialise(purged_kfold(df.select("pos", "t0", "t1"), folds, embargo), "splits")
    means = [float(np.mean(cross_validate(build(**p), df, scoring, splits=splits))) for p in points]
    best = points[int(np.argmax(means))]
    table = df.sparkSession.createDataFrame([(str(p), m) for p, m in zip(points, means, strict=True)], "parameters string, score double")
    model = bag(build(**best), df, bagging[0], bagging[1], bagging[2], seed) if bagging[1] else build(**best).fit(df)
    return model, best, table


def _spread(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the rows and its standard error."""
    return x.mean(axis=0), x.std(axis=0, ddof=1) * len(x) ** -0.5


def _importance_table(spark: SparkSession, features: list[str], mean: np.ndarray, std: np.ndarray) -> DataFrame:
    rows = [(f, float(m), float(s)) for f, m, s in zip(features, mean, std, strict=True)]
    return spark.createDataFrame(rows, "feature string, mean double, std double")


def mdi(model: Ensemble, features: list[str], spark: SparkSession) -> DataFrame:
    """(feature, mean, std): mean decrease in impurity; a tree that ignores a feature doesn't count for it."""
    x = model.importances()
    x[x == 0] = np.nan
    known = (~np.isnan(x)).sum(axis=0)
    mean = np.array([np.nanmean(c) if k else 0.0 for c, k in zip(x.T, known, strict=True)])
    std = np.array([np.nanstd(c, ddof=1) if k > 1 else 0.0 for c, k in zip(x.T, known, strict=True)]) * len(x) ** -0.5
    total = mean.sum() or 1.0
    return _importance_table(spark, features, mean / total, std / total)


def permuted(df: DataFrame, column: str, seed: int) -> DataFrame:
    """``df`` with one column shuffled over its rows: each takes the value of the next one in a random order."""
    placed = with_position(df.withColumn("__h", F.xxhash64("pos", F.lit(seed))), ["__h", "pos"], name="__q")
    n = placed.count()
    other = placed.select(F.pmod(F.col("__q") + 1, F.lit(n)).alias("__q"), column)
    return placed.drop(column).join(other, "__q").drop("__q", "__h")


def mda(estimator, df: DataFrame, features: list[str], folds: int = 3, embargo: float = 0.0, scoring: str = "neg_log_loss", seed: int = 0) -> tuple[DataFrame, float]:
    """((feature, mean, std), mean score): loss of score when a feature is shuffled in the test rows of each purged fold."""
    splits = materialise(purged_kfold(df.select("pos", "t0", "t1"), folds, embargo), "splits")
    if isinstance(estimator, Trees):
        rows, cuts = prepare(assemble(df, features), splits)
        model = estimator.grow(rows, cuts, [t for k in range(folds) for t in estimator.specs(list(range(len(cuts))), k)])
        told = _by_fold(predict_permuted(model, rows, folds, len(features), seed), scoring, folds, len(features) + 1)
        s0, s1 = told[:, :1], told[:, 1:]
    else:
        base, after = [], []
        for k in range(folds):
            train, test = _parts(df, splits, k)
            test = materialise(test, "test-rows")
            model = estimator.fit(assemble(train, features))
            base.append(score(predict(model, assemble(test, features)), scoring))
            one = lambda i, model=model, test=test: score(predict(model, assemble(permuted(test, features[i], seed + i), features)), scoring)
            after.append(parallel(one, list(range(len(features)))))
        s0, s1 = np.array(base)[:, None], np.array(after)
    scale = -s1 if scoring == "neg_log_loss" else 1 - s1
    loss = np.divide(s0 - s1, scale, out=np.zeros_like(s1), where=scale != 0)
    return _importance_table(df.sparkSession, features, *_spread(loss)), float(s0.mean())


def sfi(estimator, df: DataFrame, features: list[str], folds: int = 3, embargo: float = 0.0, scoring: str = "neg_log_loss") -> DataFrame:
    """(feature, mean, std) of purged scores of each feature alone."""
    splits = materialise(purged_kfold(df.select("pos", "t0", "t1"), folds, embargo), "splits")
    if isinstance(estimator, Trees):
        rows, cuts = prepare(assemble(df, features), splits)
        model = estimator.grow(rows, cuts, [t for k in range(folds) for f in range(len(cuts)) for t in estimator.specs([f], k, f)])
        scores = _by_fold(predict_folds(model, rows, folds, len(cuts)), scoring, folds, len(cuts))
    else:
        scores = np.array(parallel(lambda f: cross_validate(estimator, assemble(df, [f]), scoring, folds, embargo, splits), features)).T
    return _importance_table(df.sparkSession, features, *_spread(scores))


def eigen_components(gram: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """The first eigenvalues and vectors whose sum reaches ``share`` of all."""
    values, vectors = eigen(gram)
    keep = int(np.searchsorted(np.cumsum(values) / values.sum(), share)) + 1
    return values[:keep], vectors[:, :keep]


def orthogonal_features(df: DataFrame, features: list[str], share: float = 0.95) -> DataFrame:
    """``df`` plus pc_0, pc_1, ...: standardised features projected on their leading components."""
    stats = df.agg(*(f(c).alias(f"{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_samp)))).first()
    z = {c: (F.col(c) - stats[f"m_{c}"]) / (stats[f"s_{c}"] or 1.0) for c in features}
    sums = df.agg(*(F.sum(z[a] * z[b]).alias(f"g_{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if i <= j)).first()
    gram = np.array([[sums[f"g_{min(i, j)}_{max(i, j)}"] for j in range(len(features))] for i in range(len(features))], float)
    _, vectors = eigen_components(gram, share)
    return df.select("*", *(sum((z[c] * float(vectors[i, k]) for i, c in enumerate(features)), F.lit(0.0)).alias(f"pc_{k}") for k in range(vectors.shape[1])))


def classification_data(spark: SparkSession, features: int = 40, informative: int = 10, redundant: int = 10, rows: int = 10_000, seed: int = 0) -> DataFrame:
    """(pos, t0, t1, label, weight, I_*, R_*, N_*): informative, redundant (mixtures of those) and noise columns; daily."""
    require(informative + redundant <= features, "more parts than features")
    rng = np.random.default_rng(seed)
    day = F.timestamp_seconds(F.lit(946684800) + F.col("id") * 86400)
    base = spark.range(rows).select(F.col("id").alias("pos"), day.alias("t0"), F.timestamp_seconds(F.lit(946684800) + F.least(F.col("id") + 1, F.lit(rows - 1)) * 86400).alias("t1"), (F.rand(seed) < 0.5).cast("int").alias("label"), F.lit(1.0).alias("weight"))
    side = F.col("label") * 2 - 1
    base = base.select("*", *((F.randn(seed + 1 + i) + side * float(rng.uniform(0.3, 1.0))).alias(f"I_{i}") for i in range(informative)))
    mixes = rng.normal(0, 1, (redundant, max(1, informative)))
    base = base.select("*", *(sum((F.col(f"I_{i}") * float(mixes[r, i]) for i in range(informative)), F.lit(0.0)).alias(f"R_{r}") for r in range(redundant)))
    return base.select("*", *(F.randn(seed + 1000 + i).alias(f"N_{i}") for i in range(features - informative - redundant)))


def feature_importance(df: DataFrame, features: list[str], trees: int = 1000, folds: int = 10, sample: float = 1.0, embargo: float = 0.0, scoring: str = "accuracy", method: str = "SFI", min_leaf: float = 0.0, seed: int = 0, depth: int = 5) -> tuple[DataFrame, float, float]:
    """(importance table, out-of-bag score, out-of-sample score) by MDI, MDA or SFI, with trees that see one feature a node.
    The trees of the whole table and of all folds grow together."""
    require(method in ("MDI", "MDA", "SFI"), "method is MDI, MDA or SFI")
    estimator = bagging(trees, sample, 1.0, min_leaf, seed, depth, per_node=1)
    splits = materialise(purged_kfold(df.select("pos", "t0", "t1"), folds, embargo), "splits")
    rows, cuts = prepare(assemble(df, features), splits)
    every = list(range(len(cuts)))
    model = estimator.grow(rows, cuts, [t for k in range(-1, folds) for t in estimator.specs(every, k)])
    whole = Ensemble([t for t in model.trees if t.fold < 0], cuts, sample)
    oob = out_of_bag(whole, rows)
    if method == "MDA":
        table, oos = mda(estimator, df, features, folds, embargo, scoring, seed)
        return table, oob, oos
    oos = float(_by_fold(predict_folds(model, rows, folds), scoring, folds).mean())
    return mdi(whole, features, df.sparkSession) if method == "MDI" else sfi(estimator, df, features, folds, embargo, scoring), oob, oos


def importance_chart(table: DataFrame, oob: float, oos: float, method: str, tag: str = "") -> DataFrame:
    """What a bar chart of importances shows: (place, feature, mean, std, baseline, title), the least important first; the
    baseline of MDI is an equal share."""
    w = Window.partitionBy(F.lit(0))  # one row a feature
    baseline = F.when(F.lit(method == "MDI"), 1.0 / F.count("*").over(w))
    title = f"tag={tag} | method={method} | oob={oob:.4f} | oos={oos:.4f}"
    return table.select((F.row_number().over(w.orderBy("mean", "feature")) - 1).alias("place"), "feature", "mean", "std", baseline.alias("baseline"), F.lit(title).alias("title"))


def importance_experiment(spark: SparkSession, features: int = 40, informative: int = 10, redundant: int = 10, trees: int = 1000, rows: int = 10_000, folds: int = 10, methods: tuple[str, ...] = ("MDI", "MDA", "SFI"), scoring: str = "accuracy", seed: int = 0) -> DataFrame:
    """(method, type, importance, oob, oos): shares of importance of informative, redundant and noise features."""
    df = classification_data(spark, features, informative, redundant, rows, seed).cache()
    names = [c for c in df.columns if c[:2] in ("I_", "R_", "N_")]
    out = None
    for method in methods:
        table, oob, oos = feature_importance(df, names, trees, folds, scoring=scoring, method=method, seed=seed)
        total = F.sum(F.abs("mean")).over(Window.partitionBy(F.lit(0)))  # one row a feature
        kinds = table.withColumn("__t", total).groupBy(F.substring("feature", 1, 1).alias("type")).agg(F.sum(F.try_divide(F.col("mean"), F.col("__t"))).alias("importance"))
        part = kinds.select(F.lit(method).alias("method"), "type", "importance", F.lit(oob).alias("oob"), F.lit(oos).alias("oos"))
        out = part if out is None else out.union(part)
    return out
