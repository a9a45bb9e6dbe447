"""Reproducible samples, splits and balanced sets. Chance is a hash of a seed and the id, so any engine draws the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinage.functions.hashing import text_hash


def drawn(seed: int | str, *ids: str) -> Column:
    return text_hash(F.lit(str(seed)), *map(F.col, ids))


def placed(df: DataFrame, at: Column, ties: list[str], *within: str) -> DataFrame:
    """``df`` with place (1, 2, ...) in order of the 32-bit hash ``at`` and total, in each group of ``within``.

    Places come from hash buckets whose sizes are summed up by group, so no task sorts all rows of a group.
    """
    rows = df.withColumn("_at", at).withColumn("_bucket", F.shiftright("_at", 20))
    sizes = rows.groupBy(*within, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*within)
    before = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("total", F.sum("_n").over(group))
    sizes = sizes.select(*[F.col(c).alias(f"_of_{c}") for c in within], F.col("_bucket").alias("_of"), "_before", "total")
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in within] + [F.col("_bucket") == F.col("_of")]
    place = F.col("_before") + F.row_number().over(Window.partitionBy(*within, "_bucket").orderBy("_at", *ties))
    return rows.join(sizes, same).withColumn("place", place).select(*df.columns, "place", "total")


def ranked(df: DataFrame, key: str, seed: int | str, *within: str) -> DataFrame:
    """``df`` with place and total in shuffled order of the keys, in each group of ``within``."""
    return placed(df, drawn(seed, key), [key], *within)


def first_of_each(df: DataFrame, group: str, most: Column, *order: Column) -> DataFrame:
    """The first rows in order of each group, at most ``most`` (an expression of the row's columns) of them.

    Ranked in parts by a hash first: what is not among the first of its part isn't of the group either. So one task
    holds the first rows of the parts, not the group.
    """
    part = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if "map" not in dict(df.dtypes)[c]]), F.lit(64))
    inner = Window.partitionBy(group, "_part").orderBy(*order)
    rows = df.withColumn("_part", part).withColumn("_place", F.row_number().over(inner)).filter(F.col("_place") <= most)
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_place") <= most).drop("_part", "_place")


def bipartition(df: DataFrame, key: str, relative_size: float = 0.7, seed: int | str = 0) -> DataFrame:
    """``df`` with part: 0 for exactly int(n * relative_size) rows, 1 for the rest."""
    return ranked(df, key, seed).withColumn("part", F.when(F.col("place") <= F.floor(F.col("total") * relative_size), 0).otherwise(1)).drop("place", "total")


def train_test_split(df: DataFrame, key: str, label: str, test_proportion: float = 0.3, seed: int | str = 2) -> DataFrame:
    """``df`` with is_test, true for int(n * test_proportion) rows of each class."""
    return ranked(df, key, seed, label).withColumn("is_test", F.col("place") <= F.floor(F.col("total") * test_proportion)).drop("place", "total")


def subsample(df: DataFrame, key: str, label: str, size: int = 100) -> DataFrame:
    """The first rows by key of each class, size // number of classes of them."""
    classes = df.agg(F.countDistinct(label).alias("_classes"))
    rows = df.crossJoin(F.broadcast(classes))  # one row
    return first_of_each(rows, label, F.floor(size / F.greatest("_classes", F.lit(1))), F.col(key)).drop("_classes")


def balance(df: DataFrame, key: str, label: str, margin: str, ratio: float = 2.0) -> DataFrame:
    """All rows of the smallest class and, of each other one, the int(its size * ratio) rows of the smallest |margin|; ties by key."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_first", F.row_number().over(Window.orderBy("_n", label)) == 1).withColumn("_least", F.min("_n").over(Window.partitionBy()))
    rows, extra = df.join(F.broadcast(sizes), label), ("_n", "_first", "_least")  # one row a class
    others = first_of_each(rows.filter(~F.col("_first")), label, F.floor(F.col("_least") * ratio), F.abs(F.col(margin)), F.col(key))
    return rows.filter("_first").unionByName(others).drop(*extra)


def selected(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among the ids."""
    return df.join(ids.select(key), key, "left_semi")


def pre_processed(df: DataFrame, processes: list[Callable[[DataFrame], DataFrame]], weights: list[float]) -> DataFrame:
    """The rows of all processes of ``df``, with the number of the process and its weight."""
    if len(processes) != len(weights):
        raise ValueError(f"{len(processes)} processes and {len(weights)} weights")
    parts = [p(df).withColumns({"process": F.lit(k), "process_weight": F.lit(float(w))}) for k, (p, w) in enumerate(zip(processes, weights, strict=True))]
    return reduce(DataFrame.unionByName, parts)


def data_matrix(positive: DataFrame, negative: DataFrame | None = None, key: str = "graph_id") -> DataFrame:
    """key, y, feature, value: positives over negatives; without negatives, the positives mirrored through the origin."""
    first = positive.select(key, F.lit(1).alias("y"), "feature", "value")
    if negative is None:
        return first.unionByName(positive.select(key, F.lit(-1).alias("y"), "feature", (-F.col("value")).alias("value")))
    return first.unionByName(negative.select(key, F.lit(-1).alias("y"), "feature", "value"))


def intervals(size: int, n_blocks: int | None = None, block_size: int | None = None) -> list[tuple[int, int]]:
    """Ranges (begin, end) of blocks of ``block_size`` or of size // n_blocks; a rest of one joins the last block."""
    block = block_size or max(1, size // (n_blocks or 1))
    edges = [(k, k + block) for k in range(0, size - block + 1, block)]
    done = edges[-1][1] if edges else 0
    if size - done == 1 and edges:
        edges[-1] = (edges[-1][0], size)
    elif size > done:
        edges.append((done, size))
    return edges
