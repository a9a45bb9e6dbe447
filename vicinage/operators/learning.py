"""Models over sparse features: linear classifiers and regressors, clusters, validation. Built on pyspark.ml."""

from __future__ import annotations

import random

from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinage.functions.lineage import cut
from vicinage.operators import clusters, graph_vectorizer, metrics, training
from vicinage.operators.options import GraphOptions


def as_vectors(features: DataFrame, keys: list[str], nbits: int) -> DataFrame:
    """keys, features: sparse vectors of 2 ** nbits + 1 places from long rows (feature, value)."""
    size = (1 << nbits) + 1
    make = F.udf(lambda entries: SparseVector(size, [int(e["feature"]) for e in entries], [float(e["value"]) for e in entries]), VectorUDT())
    lists = features.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("feature", "value"))).alias("entries"))  # of one instance
    return lists.select(*keys, make("entries").alias("features"))


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """``df`` with weight n / (classes * n of the class)."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    every = Window.partitionBy()
    sizes = sizes.withColumn("weight", F.sum("_n").over(every) / (F.count(F.lit(1)).over(every) * F.col("_n"))).drop("_n")
    return df.join(F.broadcast(sizes), label)  # one row a class


def fit(vectors: DataFrame, label: str = "label", regularization: float = 1e-3, iterations: int = 30):
    """A linear support vector classifier with balanced class weights over (features, label 0 or 1)."""
    return LinearSVC(labelCol=label, weightCol="weight", regParam=regularization, maxIter=iterations, standardization=False).fit(balanced(vectors, label))


def decision(model, vectors: DataFrame) -> DataFrame:
    """``vectors`` with margin and prediction."""
    return model.transform(vectors).withColumn("margin", vector_to_array("rawPrediction")[1]).drop("rawPrediction")


def regress(vectors: DataFrame, target: str = "label", regularization: float = 1e-2, mix: float = 0.5, iterations: int = 30):
    """A linear regression with elastic-net penalty."""
    return LinearRegression(labelCol=target, regParam=regularization, elasticNetParam=mix, maxIter=iterations, standardization=False).fit(vectors)


def cluster(features: DataFrame, keys: list[str], n_clusters: int = 16, seed: int = 1, iterations: int = 10) -> DataFrame:
    """keys, cluster, distances to all centres of the vectors of long rows (keys, feature, value)."""
    return clusters.kmeans(features, keys, n_clusters, seed, iterations)[0]


def auto_label(features: DataFrame, n_clusters: int = 16, seed: int = 1) -> DataFrame:
    """graph_id, vid, label, vec: the cluster of each vertex's vector and its distances to all centres."""
    found = cluster(features, ["graph_id", "vid"], n_clusters, seed)
    return found.select("graph_id", "vid", F.col("cluster").cast("string").alias("label"), F.col("distances").alias("vec"))


def vector_relabel(vertices: DataFrame, n_clusters: int = 8, seed: int = 1) -> DataFrame:
    """``vertices`` with the cluster of each one's own vec as its label, and 1 / (1 + distance) to all centres as vec.

    Vectors have one length and no nulls. A vertex whose vec is null or empty gets a null label and vec.
    """
    features = vertices.select("graph_id", "vid", F.posexplode("vec").alias("feature", "value"))
    found = auto_label(features, n_clusters, seed).withColumn("vec", F.transform("vec", lambda x: 1 / (1 + x)))
    return vertices.drop("label", "vec").join(found, ["graph_id", "vid"], "left")


def auto_relabel(vertices: DataFrame, edges: DataFrame, options: GraphOptions, n_clusters: int = 16, seed: int = 1) -> DataFrame:
    """``vertices`` with the cluster of each one as its label and the distances to all centres as vec; edges stay as they are."""
    found = auto_label(graph_vectorizer.vertex_vectorize(vertices, edges, options), n_clusters, seed)
    return vertices.drop("label", "vec").join(found, ["graph_id", "vid"], "left")


def estimated(scored: DataFrame, label: str = "label") -> DataFrame:
    """One row for (label, margin) of any model: accuracy, auc, average_precision."""
    said = (F.col("margin") > 0).cast("int") == F.col(label)
    curves = metrics.ranking_summary(scored.withColumn(label, F.col(label).cast("double")), label, "margin")
    return scored.agg(F.avg(said.cast("double")).alias("accuracy")).crossJoin(curves)  # one row each


def estimate_model(model, vectors: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """How a given model does on vectors: the row of :func:`estimated`, and the report of its classes."""
    scored = cut(decision(model, vectors).select(label, "margin", F.col("prediction").cast("int").alias("prediction")))
    return estimated(scored, label), metrics.class_report(scored, label, "prediction")


def model_selection(vertices: DataFrame, edges: DataFrame, targets: DataFrame, options: GraphOptions, label: str = "label", n_iter: int = 30, radii: tuple[int, ...] = tuple(range(1, 5)), distances: tuple[int, ...] = tuple(range(10)), count: int = 5, seed: int = 1) -> tuple[GraphOptions, DataFrame]:
    """The best options and (r, d, auc) of n_iter drawn settings, by the mean area over folds; ties go to the smaller setting.

    targets: graph_id, label. A setting that is drawn again is scored once.
    """
    draw = random.Random(seed)
    settings = sorted({(draw.choice(radii), draw.choice(distances)) for _ in range(n_iter)})
    scores = []
    for r, d in settings:
        features = graph_vectorizer.vectorize(vertices, edges, options.set_params(r=r, d=d))
        rows = cut(training.examples(features, targets.select("graph_id", F.col(label).alias("label")), "graph_id"))
        scores.append((r, d, training.cross_validated_auc(rows, "graph_id", options.nbits, count, seed).agg(F.avg("auc")).first()[0]))  # one number a setting
    r, d, _ = max(scores, key=lambda s: (s[2], -s[0], -s[1]))
    return options.set_params(r=r, d=d), vertices.sparkSession.createDataFrame(scores, "r int, d int, auc double")
