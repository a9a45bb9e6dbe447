"""k-means of sparse vectors in long rows: distances come from a join on the feature, centres from grouped sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinage.functions.lineage import cut, few
from vicinage.operators.sampling import drawn

#: Places that count of a squared distance, so that equal ones stay equal in any order of summing.
PLACES = 9


def _norms(features: DataFrame, keys: list[str]) -> DataFrame:
    return features.groupBy(*keys).agg(F.sum(F.col("value") * F.col("value")).alias("norm"))


def _squared(dot: Column, norm: float) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.col("norm") - 2 * dot + norm), PLACES)


def first_centers(features: DataFrame, keys: list[str], n_clusters: int, seed: int | str = 1) -> DataFrame:
    """center, feature, value: rows drawn as first centres, each with a chance by its squared distance to those before.

    Chance is a hash of seed, number and key: the row of the least -ln(u) / distance comes next, the first one of all by
    hash alone. Fewer centres where all rows equal one.
    """
    away = cut(_norms(features, keys).withColumn("away", F.lit(1.0)))
    centers = None
    for k in range(n_clusters):
        chance = (F.pmod(drawn(f"{seed}c{k}", *keys), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
        pick = away.filter("away > 0").select(*keys, "norm", (-F.ln(chance) / F.col("away")).alias("_at")).orderBy("_at", *keys).limit(1).drop("_at")
        pick = cut(pick)
        one = pick.first()
        if one is None:
            break
        new = cut(features.join(F.broadcast(pick.drop("norm")), keys, "left_semi").select("feature", F.col("value").alias("of")))
        dots = features.join(few(new, 100_000), "feature").groupBy(*keys).agg(F.sum(F.col("value") * F.col("of")).alias("dot"))
        far = _squared(F.coalesce("dot", F.lit(0.0)), one["norm"])
        own = far if k == 0 else F.least("away", far)
        away = cut(away.join(dots, keys, "left").select(*keys, "norm", own.alias("away")))
        part = new.select(F.lit(k).alias("center"), "feature", F.col("of").alias("value"))
        centers = part if centers is None else centers.unionByName(part)
    return centers if centers is not None else features.select(F.lit(0).alias("center"), "feature", "value").limit(0)


def _wide(centers: DataFrame, k: int) -> DataFrame:
    """feature, c: the centres' values of a feature as an array of k."""
    sums = [F.coalesce(F.sum(F.when(F.col("center") == j, F.col("value"))), F.lit(0.0)) for j in range(k)]
    return centers.groupBy("feature").agg(F.array(*sums).alias("c"))


def _assigned(features: DataFrame, norms: DataFrame, wide: DataFrame, keys: list[str], k: int) -> DataFrame:
    """keys, cluster, squares: squared distances to all centres, the number of the least one, ties to the lower."""
    sizes = wide.agg(*[F.sum(F.col("c")[j] * F.col("c")[j]) for j in range(k)]).first()  # k numbers
    dots = features.join(few(wide, 100_000), "feature").groupBy(*keys).agg(*[F.sum(F.col("value") * F.col("c")[j]).alias(f"_dot{j}") for j in range(k)])
    far = F.array(*[_squared(F.coalesce(f"_dot{j}", F.lit(0.0)), sizes[j] or 0.0) for j in range(k)])
    rows = norms.join(dots, keys, "left").select(*keys, far.alias("squares"))
    return rows.select(*keys, (F.array_position("squares", F.array_min("squares")) - 1).cast("int").alias("cluster"), "squares")


def kmeans(features: DataFrame, keys: list[str], n_clusters: int = 16, seed: int | str = 1, iterations: int = 10, start: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(keys, cluster, distances) of each vector and (center, feature, value) of the centres they are measured to.

    features: keys, feature, value; a feature comes once a key. start: centres 0, 1, ... to begin with, each with a row
    at least; else first_centers(). Rounds end when the sum of squares falls no more. A centre without members stays.
    distances has one entry a centre, which may be fewer than asked for where there are fewer different vectors.
    """
    features = cut(features.select(*keys, "feature", F.col("value").cast("double").alias("value")))
    centers = cut(first_centers(features, keys, n_clusters, seed) if start is None else start.select("center", "feature", "value"))
    k = (centers.agg(F.max("center")).first()[0] or 0) + 1
    norms = cut(_norms(features, keys))
    wide = cut(_wide(centers, k))
    last = None
    for turn in range(iterations + 1):
        rows = cut(_assigned(features, norms, wide, keys, k))
        sums = {r["cluster"]: r for r in rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(F.array_min("squares")).alias("cost")).collect()}  # a row a centre
        cost = sum(r["cost"] for r in sums.values())
        if turn == iterations or (last is not None and cost >= last - 1e-9 * max(1.0, last)):
            break
        last, n = cost, [sums[j]["n"] if j in sums else 0 for j in range(k)]
        means = features.join(rows.select(*keys, "cluster"), keys).groupBy("feature", "cluster").agg(F.sum("value").alias("value"))
        new = _wide(means.withColumnRenamed("cluster", "center"), k).withColumnRenamed("c", "new")
        value = [(F.coalesce(F.col("new")[j], F.lit(0.0)) / n[j] if n[j] else F.coalesce(F.col("c")[j], F.lit(0.0))) for j in range(k)]
        wide = cut(new.join(wide, "feature", "full").select("feature", F.array(*value).alias("c")))
    found = rows.select(*keys, "cluster", F.transform("squares", F.sqrt).alias("distances"))
    return found, wide.select("feature", F.posexplode("c").alias("center", "value")).filter("value <> 0").select("center", "feature", "value")
