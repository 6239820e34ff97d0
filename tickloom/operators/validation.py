"""Purged and embargoed splits as tables. Labels are intervals (pos, t0, t1): pos dense from 0 in order of t0.

``*_splits`` return (split, pos, role), role being "train" or "test".
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.contracts import require, require_columns, require_none
from tickloom.operators.joins import running_maxima, with_position


def intervals(df: DataFrame, t0: str = "t0", t1: str = "t1") -> DataFrame:
    """Checked labels with positions: no null ends, no end before its start, unique starts, not empty."""
    require_columns(df, t0, t1)
    placed = with_position(df, [t0])
    none = F.col(t0).isNull() | F.col(t1).isNull()
    row = placed.agg(F.count("*").alias("n"), F.count_if(none).alias("none"), F.count_if(F.col(t1) < F.col(t0)).alias("back"), F.count_distinct(t0).alias("starts")).first()
    require(row["n"] > 0, "no labels")
    require(row["none"] == 0, "null interval bound")
    require(row["back"] == 0, "an interval ends before it starts")
    require(row["starts"] == row["n"], f"repeated {t0}")
    return placed


def train_times(labels: DataFrame, test: DataFrame) -> DataFrame:
    """Labels that overlap no test interval (low, high); all bounds count as inside. One scan in order of time: a label
    overlaps a test interval if the largest high of those that begin by its t1 reaches its t0."""
    row = labels.select(F.struct("*").alias("__row")).schema["__row"].dataType
    tests = test.where("low <= high").select(F.col("low").alias("__t"), F.lit(0).alias("__kind"), F.col("high").alias("__high"), F.lit(None).cast(row).alias("__row"))
    rows = labels.select(F.col("t1").alias("__t"), F.lit(1).alias("__kind"), F.lit(None).cast(test.schema["high"].dataType).alias("__high"), F.struct("*").alias("__row"))
    met = running_maxima(tests.unionByName(rows), ["__t", "__kind"], {"__reach": F.col("__high")})
    return met.where("__kind = 1").select("__row.*", "__reach").where(~F.coalesce(F.col("__reach") >= F.col("t0"), F.lit(False))).drop("__reach")


def embargo_times(times: DataFrame, share: float, time: str = "t0") -> DataFrame:
    """(time, embargo): the time int(n * share) places later, the last one at the end."""
    placed = with_position(times.select(time).distinct(), [time])
    n = placed.count()
    step = int(n * share)
    later = placed.select((F.col("pos") - step).alias("pos"), F.col(time).alias("embargo"))
    last = placed.agg(F.max(time).alias("__last"))
    return placed.join(later, "pos", "left").join(F.broadcast(last)).select(time, F.coalesce("embargo", "__last").alias("embargo"))


def fold_bounds(n: int, folds: int) -> list[tuple[int, int]]:
    """Contiguous folds; the first n % folds ones get one more."""
    size, more = divmod(n, folds)
    starts = [i * size + min(i, more) for i in range(folds + 1)]
    return list(zip(starts[:-1], starts[1:], strict=True))


def purged_kfold(labels: DataFrame, folds: int = 3, embargo: float = 0.0, strict_parity: bool = False) -> DataFrame:
    """(split, pos, role). Train: labels that end by the test's first start, and those from the first start at or after the
    test's last end plus int(n * embargo) places. Test rows never train unless ``strict_parity``."""
    require(folds >= 2, "two folds at least")
    spark, n = labels.sparkSession, labels.count()
    require(n >= folds, "fewer labels than folds")
    gap = int(n * embargo)
    bounds = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(fold_bounds(n, folds))], "split int, low long, high long")
    rows = labels.select("pos", "t0", "t1")
    tests = rows.join(F.broadcast(bounds), F.col("pos").between(F.col("low"), F.col("high") - 1))
    ends = tests.groupBy("split", "low", "high").agg(F.min("t0").alias("begin"), F.max("t1").alias("end"))
    after = rows.select(F.col("t0").alias("s")).join(F.broadcast(ends), F.col("s") < F.col("end"), "right").groupBy("split", "low", "high", "begin").agg(F.count("s").alias("first"))
    met = rows.crossJoin(F.broadcast(after))  # one row a fold on the right
    test = F.col("pos").between(F.col("low"), F.col("high") - 1)
    train = (F.col("t1") <= F.col("begin")) | ((F.col("first") < n) & (F.col("pos") >= F.col("first") + gap))
    if not strict_parity:
        train = train & ~test
    role = F.filter(F.array(F.when(test, "test"), F.when(train, "train")), lambda x: x.isNotNull())
    return met.select("split", "pos", F.explode(role).alias("role"))


def group_bounds(n: int, groups: int) -> list[tuple[int, int]]:
    """Contiguous groups of n // groups; the last one takes the rest."""
    size = n // groups
    return [(i * size, (i + 1) * size if i < groups - 1 else n) for i in range(groups)]


def combinatorial_splits(labels: DataFrame, groups: int, tested: int, embargo: float = 0.0) -> DataFrame:
    """(split, pos, role) for each choice of ``tested`` groups in lexicographic order; training labels that overlap a test
    label go, and ceil(n * embargo) positions after each tested group.

    One scan in order of time gives each label the groups that it overlaps; what a label does in each split follows from
    its own group and those, by expressions."""
    n = labels.count()
    require(2 <= groups <= n, "groups between 2 and the number of labels")
    require(1 <= tested < groups, "test groups between 1 and groups - 1")
    require(0 <= embargo < 1, "embargo in [0, 1)")
    gap, size = math.ceil(n * embargo), n // groups
    mine = F.least(F.floor(F.col("pos") / size), F.lit(groups - 1)).cast("int")
    rows = labels.select("pos", "t0", "t1").withColumn("g", mine)
    begins = rows.select("pos", "g", F.col("t0").alias("t"), F.lit(0).alias("kind"), F.col("t1").alias("high"), F.lit(None).cast(labels.schema["t0"].dataType).alias("t0"))
    ends = rows.select("pos", "g", F.col("t1").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast(labels.schema["t1"].dataType).alias("high"), "t0")
    reach = {f"r{g}": F.when(F.col("g") == g, F.col("high")) for g in range(groups)}
    met = running_maxima(begins.unionByName(ends), ["t", "kind", "pos"], reach).where("kind = 1")
    bounds = group_bounds(n, groups)
    bars = [F.coalesce(F.col(f"r{g}") >= F.col("t0"), F.lit(False)) | F.col("pos").between(b, b + gap - 1) for g, (_, b) in enumerate(bounds)]
    barred = F.filter(F.array(*(F.when(x, F.lit(g)) for g, x in enumerate(bars))), lambda g: g.isNotNull())
    met = met.select("pos", "g", barred.alias("barred"))
    choices = [(i, list(c)) for i, c in enumerate(combinations(range(groups), tested))]
    splits = F.broadcast(labels.sparkSession.createDataFrame(choices, "split int, tested array<int>"))  # a row a split, as many as each label has roles
    role = F.when(F.array_contains("tested", F.col("g")), "test").when(~F.arrays_overlap("barred", "tested"), "train")
    return met.crossJoin(splits).select("split", "pos", role.alias("role")).where("role is not null")


def split_table(splits: DataFrame, groups: int, tested: int) -> DataFrame:
    """One row a split: train_groups, test_groups, train_indices, test_indices as sorted arrays."""
    spark = splits.sparkSession
    names = [(i, list(c), [g for g in range(groups) if g not in c]) for i, c in enumerate(combinations(range(groups), tested))]
    named = spark.createDataFrame(names, "split int, test_groups array<int>, train_groups array<int>")
    held = splits.groupBy("split").agg(F.sort_array(F.collect_list(F.when(F.col("role") == "train", F.col("pos")))).alias("train_indices"), F.sort_array(F.collect_list(F.when(F.col("role") == "test", F.col("pos")))).alias("test_indices"))
    return named.join(held, "split")


def backtest_paths(splits: DataFrame, groups: int) -> DataFrame:
    """(path, grp, split): the k-th split that tests a group belongs to path k. ``splits`` has split and test_groups."""
    require_columns(splits, "split", "test_groups")
    flat = splits.select("split", F.explode("test_groups").alias("grp"))
    bad = F.size("test_groups") != F.size(F.array_distinct("test_groups"))
    require_none(splits, bad | F.exists("test_groups", lambda g: (g < 0) | (g >= groups)), "repeated or unknown test group")
    paths = flat.select((F.row_number().over(Window.partitionBy("grp").orderBy("split")) - 1).alias("path"), F.col("grp"), "split")
    counts = {r["n"] for r in paths.groupBy("grp").agg(F.count("*").alias("n")).limit(groups + 1).collect()}
    require(len(counts) == 1 and paths.select("grp").distinct().count() == groups, "every group must be tested equally often")
    return paths
