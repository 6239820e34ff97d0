"""As-of and range joins, interval counts and sums, dense positions, running maxima."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.storage import materialise


def asof(left: DataFrame, right: DataFrame, keys: tuple[str, ...], on: str, value: str, forward: bool = False, strict: bool = False, alias: str | None = None) -> DataFrame:
    """``left`` plus the value (and time, ``<alias>_at``) of the nearest ``right`` row before (or after) ``on``.

    One union and one window, whatever the distance; ``strict`` leaves out equal times. Ties in ``right``: its largest value.
    """
    alias = alias or value
    rights = right.groupBy(*keys, on).agg(F.max(value).alias("__v")).select(*keys, on, "__v", F.col(on).alias("__t"), F.lit(1).alias("__r"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("__row"))
    lefts = left.select(*keys, on, F.lit(None).cast(rights.schema["__v"].dataType).alias("__v"), F.lit(None).cast(rights.schema["__t"].dataType).alias("__t"), F.lit(0).alias("__r"), F.struct("*").alias("__row"))
    # Rights come first at equal times where they count, in the direction of the scan.
    tie = F.col("__r").asc() if strict else F.col("__r").desc()
    time = F.col(on).desc() if forward else F.col(on).asc()
    w = Window.partitionBy(*keys).orderBy(time, tie).rowsBetween(Window.unboundedPreceding, 0)
    both = lefts.unionByName(rights).withColumns({"__v": F.last("__v", ignorenulls=True).over(w), "__t": F.last("__t", ignorenulls=True).over(w)})
    return both.where("__r = 0").select("__row.*", F.col("__v").alias(alias), F.col("__t").alias(f"{alias}_at"))


def range_join(points: DataFrame, intervals: DataFrame, keys: tuple[str, ...], point: str, low: str, high: str, width: float | None = None) -> DataFrame:
    """Points with low <= point <= high: an equi-join on buckets of ``width`` and the exact condition. Numbers or timestamps
    (in seconds); names must differ apart from the keys. Without ``width`` buckets are as wide as the mean interval: all
    intervals together then take at most two bucket rows each, and a bucket holds about the points of one interval."""
    number = lambda df, c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6 if df.schema[c].dataType.typeName().startswith("timestamp") else F.col(c).cast("double")
    if width is None:
        span = F.avg(number(intervals, high) - number(intervals, low))
        width = max(intervals.where(F.col(low) <= F.col(high)).agg(span.alias("w")).first()["w"] or 1.0, 1e-6)
    p = points.withColumn("__b", F.floor(number(points, point) / width))
    i = intervals.where(F.col(low) <= F.col(high)).withColumn("__b", F.explode(F.sequence(F.floor(number(intervals, low) / width), F.floor(number(intervals, high) / width))))
    return p.join(i, [*keys, "__b"]).where(F.col(point).between(F.col(low), F.col(high))).drop("__b")


def with_position(df: DataFrame, order: list[str], keys: tuple[str, ...] = (), name: str = "pos") -> DataFrame:
    """Dense positions from 0 within keys; ties stand in any order. Without keys: rows are range-partitioned, sorted and
    written once with their partition and place, so that counts, offsets and positions are of the same rows; the result
    is that table and a broadcast of one row a partition."""
    if keys:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)
    spread, start = _placed(df, order, {"__s": F.count("*")})
    at = F.coalesce("__s", F.lit(0)) + F.col("__i").bitwiseAND(F.lit(_PLACE))
    return spread.join(F.broadcast(start), "__p").withColumn(name, at.cast("long")).drop("__p", "__i", "__s")


#: A row id is a partition number above 33 bits of a place in the partition.
_PLACE = (1 << 33) - 1


def _placed(df: DataFrame, order: list[str], totals: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """``df`` in order with a partition ``__p`` and a row id ``__i``, and for each partition sums (counts, maxima) of the
    partitions before it: a row a partition."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__i", F.monotonically_increasing_id())
    placed = materialise(placed, "placed").withColumn("__p", F.shiftright("__i", 33))
    parts = placed.groupBy("__p").agg(*(f.alias(k) for k, f in totals.items()))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    return placed, parts.select("__p", *((F.max(k) if k.startswith("__max") else F.sum(k)).over(before).alias(k) for k in totals))


def running_maxima(df: DataFrame, order: list[str], values: dict[str, Column]) -> DataFrame:
    """``df`` plus, for each name, the maximum of its expression over all rows up to this one in ``order``, which has to be
    without ties. Over the whole table but not in one task: maxima within range partitions and of those before."""
    rows = df.select("*", *(v.alias(f"__max_{k}") for k, v in values.items()))
    placed, start = _placed(rows, order, {f"__max_{k}": F.max(f"__max_{k}") for k in values})
    within = Window.partitionBy("__p").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    start = start.select("__p", *(F.col(f"__max_{k}").alias(f"__before_{k}") for k in values))
    out = placed.select("*", *(F.max(f"__max_{k}").over(within).alias(f"__in_{k}") for k in values)).join(F.broadcast(start), "__p")
    return out.select(*df.columns, *(F.greatest(f"__in_{k}", f"__before_{k}").alias(k) for k in values))


def interval_sums(times: DataFrame, intervals: DataFrame, keys: tuple[str, ...], time: str, low: str, high: str, values: dict[str, str], closed: bool = True) -> DataFrame:
    """For each time, sums over the intervals that hold it (high included if ``closed``, open-ended if null): a
    difference array and running sums. ``values`` maps output names to expressions over ``intervals``."""
    zero = [F.lit(0.0).alias(k) for k in values]
    grid = times.select(*keys, F.col(time).alias("__t"), F.lit(1).alias("__at"), *zero)
    begin = intervals.select(*keys, F.col(low).alias("__t"), F.lit(0).alias("__at"), *(F.expr(v).cast("double").alias(k) for k, v in values.items()))
    end = intervals.where(F.col(high).isNotNull()).select(*keys, F.col(high).alias("__t"), F.lit(2 if closed else 0).alias("__at"), *((-F.expr(v)).cast("double").alias(k) for k, v in values.items()))
    w = Window.partitionBy(*keys).orderBy("__t", "__at").rangeBetween(Window.unboundedPreceding, 0)
    rows = grid.unionByName(begin).unionByName(end)
    return rows.select(*keys, "__t", "__at", *(F.sum(k).over(w).alias(k) for k in values)).where("__at = 1").select(*keys, F.col("__t").alias(time), *values)
