"""Exact quantiles of each key by refined histograms, so that no task holds the values of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinage.functions.lineage import cut, few

#: Buckets that a range of values is divided into at each turn.
BUCKETS = 256
#: The bucket of the greatest value, beyond all others; its negative is that of the least one.
ENDS = 5000
RANGE = ["key", "low", "high"]


def _bucket(first: bool) -> Column:
    """The bucket of x in its range: in order of x, and the least value's is the first one and the greatest's the last one.

    The first turn divides by sign and binary exponent, so later ones divide ranges of a factor of two into equal parts
    and a value is found in about eight turns, however widely values are spread.
    """
    if first:
        size = F.least(F.lit(1100.0), F.log2(F.abs("x"))) + 1100
        inner = F.when(F.col("x") == 0, 0.0).otherwise(F.signum("x") * F.floor(size))
    else:
        inner = F.greatest(F.lit(0.0), F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * BUCKETS))
    return F.when(F.col("x") == F.col("low"), -ENDS).when(F.col("x") == F.col("high"), ENDS).otherwise(inner.cast("int"))


def order_statistics(df: DataFrame, key: str, value: str, wanted: DataFrame) -> DataFrame:
    """key, rank, x: the value of each wanted (key, rank), the rank counted from 0 among the key's values in order.

    Values are doubles without nulls; NaN is the greatest. Each turn counts the rows of the ranges that wanted ranks lie
    in by buckets, and goes on in the bucket of the rank with its least and greatest value, until these are one.
    """
    counts = df.groupBy(F.col(key).alias("key"), F.col(value).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    counts = cut(counts)
    ends = counts.groupBy("key").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    open_ = cut(wanted.select(F.col(key).alias("key"), "rank").join(ends, "key").withColumn("left", F.col("rank")))
    closed, first = None, True
    while True:
        final = open_.filter("low = high").select("key", "rank", F.col("low").alias("x"))
        closed = final if closed is None else closed.unionByName(final)
        open_ = open_.filter("low < high")
        ranges = cut(open_.select(*RANGE).distinct())
        if ranges.isEmpty():
            return closed.withColumnRenamed("key", key)
        inside = counts.join(few(ranges), "key").filter("x >= low and x <= high").withColumn("bucket", _bucket(first))
        parts = inside.groupBy(*RANGE, "bucket").agg(F.sum("n").alias("n"), F.min("x").alias("new_low"), F.max("x").alias("new_high"))
        before = Window.partitionBy(*RANGE).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
        parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        met = open_.join(parts, RANGE).filter("before <= left and left < before + n")
        first = False
        open_ = cut(met.select("key", "rank", F.col("new_low").alias("low"), F.col("new_high").alias("high"), (F.col("left") - F.col("before")).alias("left")))


def quantiles(df: DataFrame, key: str, value: str, points: dict[str, float]) -> DataFrame:
    """key and a column for each point (a share from 0 to 1), linearly interpolated between values; null without values.

    Nulls don't count among values, nor do rows whose key is null.
    """
    rows = df.filter(F.col(key).isNotNull()).select(key, F.col(value).cast("double").alias("_x"))
    sizes = cut(rows.groupBy(key).agg(F.count("_x").alias("_n")))
    spot = lambda p: (F.col("_n") - 1) * F.lit(float(p))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(spot(p)), F.ceil(spot(p))) for p in points.values()])))
    wanted = sizes.filter("_n > 0").select(key, F.explode(ranks).alias("rank"))
    found = order_statistics(rows.filter("_x is not null"), key, "_x", wanted)
    known = found.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("_at"))  # two a point
    out = sizes.join(known, key, "left")

    def between(p: float) -> Column:
        low, high = F.col("_at")[F.floor(spot(p))], F.col("_at")[F.ceil(spot(p))]
        return F.when(low == high, low).otherwise(low + (high - low) * (spot(p) - F.floor(spot(p))))

    return out.select(key, *[between(p).alias(name) for name, p in points.items()])
